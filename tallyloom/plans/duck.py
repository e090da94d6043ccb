"""DuckDB forms of the bindings: common table expressions that the oracles start with."""

from __future__ import annotations

from .bindings import ERRORS

_CELLS = ", ".join(f"coalesce(string_split(coalesce(text,''), chr(10))[{k}], '') AS f{k}" for k in range(1, 9))
_CELLS += ", coalesce(array_to_string((string_split(coalesce(text,''), chr(10)))[9:], chr(10)), '') AS f9"
_HASH = "sha256(name || chr(0) || " + " || chr(0) || ".join(f"f{k}" for k in (1, 2, 3, 4, 5, 6, 7, 9)) + ")"
_TOKENS = "CAST(" + " + ".join(f"ceil(length(f{k})/4.0)" for k in range(1, 10)) + " AS BIGINT)"
_ERRORS = "[" + ", ".join(f"'{e}'" for e in ERRORS) + "]"

CTES = {
    "cards": f"""SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.json' AS id, substr(sha1(source),1,10) AS library_id,
        'doc-' || doc_id AS name, doc_id, n_chars, {_CELLS} FROM documents""",
    "ledger": f"""SELECT id, library_id, name, doc_id, CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE {_HASH} END AS hash, {_TOKENS} AS tokens,
        CASE WHEN toxic <> 1 THEN raw END AS score, CASE WHEN toxic = 1 THEN {_ERRORS}[doc_id % 12 + 1] END AS error,
        (toxic <> 1 AND quality = 0) AS brief, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'now' END AS prompt_hash,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS scored_at,
        CASE WHEN toxic <> 1 AND doc_id % 3 = 0 AND quality <> 0
             THEN floor(least(10.0::DOUBLE, greatest(1.0::DOUBLE, raw + ((doc_id % 31) - 15) / 10.0::DOUBLE)) * 10 + 0.5) / 10.0 END AS fast_score,
        doc_id % 7 = 0 AS fast_stale, CASE WHEN doc_id % 8 <> 0 THEN 'p' || (doc_id % 3) END AS provider
        FROM (SELECT *, (10 + (doc_id * 37 + n_chars) % 91) / 10.0::DOUBLE AS raw FROM cards JOIN labels USING (doc_id))""",
    "log": """SELECT event_id AS log_id, 'doc-' || user_id AS item, 'p' || (user_id % 3) AS provider, ts, CAST(floor(value * 100) AS BIGINT) AS took_ms,
        CASE WHEN event_type <> 'error' THEN 200 WHEN k = 0 THEN 429 WHEN k = 1 THEN 503 WHEN k = 2 THEN 500 WHEN k = 4 THEN 401 END AS status,
        CASE WHEN event_type = 'error' THEN CASE k WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'HTTP 503' WHEN 2 THEN 'HTTP 500' WHEN 4 THEN 'HTTP 401' ELSE 'Request timed out' END END AS error,
        CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 50 = 0 AND user_id % 3 > 0 THEN 'length' ELSE 'stop' END END AS finish_reason, CAST(100 + event_id % 900 AS BIGINT) AS tokens_in, CASE WHEN event_type <> 'error' THEN CAST(10 + event_id % 350 AS BIGINT) END AS tokens_out
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS k FROM events)""",
    "names": r"""SELECT doc_id AS id, w[1] || CASE WHEN len(w) > 1 THEN ' ' || w[2] ELSE '' END AS name, (n_chars % 100) / 10.0::DOUBLE AS score
        FROM (SELECT *, regexp_split_to_array(coalesce(text,''), '[ \n\t\r\x0B\f]+') AS w FROM documents)""",
    "replies": "SELECT conv_id * 1000 + turn AS id, length(coalesce(text, '')) AS n, conv_id % 8 AS v, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'",
}
for _n, _step, _days, _src in (("ledger_b", 2, 3, 1), ("ledger_c", 5, -3, 2)):
    CTES[_n] = f"""SELECT id, CASE WHEN doc_id % 6 = 0 THEN coalesce(score, 5.0) ELSE score END AS score, scored_at + to_days({_days}) AS scored_at, {_src} AS source_ord
        FROM ledger WHERE doc_id % {_step} = 0 UNION ALL SELECT 'ghost-' || range, 6.0, TIMESTAMP '2024-01-01', {_src} FROM range(10)"""


def sql(body: str, *names: str) -> str:
    """``body`` after the bindings that it names, and those they need."""
    need = [n for n in CTES if n in names or (n in ("cards", "ledger") and any(x.startswith("ledger") for x in names))]
    if not need and not body.lstrip().startswith("+"):
        return body
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in body else ''}{head}{', ' if body.lstrip().startswith('+') and head else ''}{body.lstrip().removeprefix('+').replace('RECURSIVE ', '')}"
