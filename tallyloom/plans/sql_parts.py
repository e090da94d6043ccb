"""Parts of oracles in SQL that several modules use."""

from __future__ import annotations

from tallyloom.operators.cards import ROLES


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x0B ]+|[\\s\\x0B ]+$', '', 'g')"


def heading_sql(field: str) -> str:
    """The text of a heading, for use between single quotes."""
    role = "an instruction put into the chat 4 messages from its end" if field == "character_note" else ROLES[field]
    return f"### {field} — {role}".replace("'", "''")
