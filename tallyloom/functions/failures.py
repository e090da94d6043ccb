"""Kinds and scopes of scorer failures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in order, and the label of each; a label may hold the matched code.
ERROR_KINDS = (
    ("timed out|aborted", "Request timed out (model too slow)"),
    ("cut off", "Answer cut off by a response-length limit"),
    ("parseable JSON|did not return", "Model returned unusable/incomplete JSON"),
    (r"\b429\b|rate limit", "Rate limited by the provider (429)"),
    (r"\b401\b|\b403\b|unauthor|forbidden|api key", "Auth rejected (401/403) — check your API key"),
    (r"\b4\d\d\b", "Provider rejected the request ({})"),
    (r"\b5\d\d\b", "Provider server error ({})"),
    ("no non-empty scorable fields", "Card has no scorable text"),
    ("ENOTFOUND|ECONNREFUSED|EAI_AGAIN|fetch failed|network", "Network/connection problem"),
)
MONEY = "insufficient (balance|funds|credit)|out of credits|no credits|balance is (too low|empty)|billing|payment required|exceeded your current quota"
PER_PERIOD = "per (second|minute|hour)|requests per|rpm|tpm|try again in"
AUTH = "invalid api key|incorrect api key|unauthori[sz]ed|authentication"
CONNECTION = "fetch failed|socket hang up|network|other side closed"


def error_kind(message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    out = F.lit("Other")
    for pattern, label in reversed(ERROR_KINDS):
        a, found, b = label.partition("{}")
        text = F.concat(F.lit(a), F.regexp_extract(m, pattern, 0), F.lit(b)) if found else F.lit(label)
        out = F.when(m.rlike(f"(?i){pattern}"), text).otherwise(out)
    return out


# Socket errors that mean that the provider can't be reached.
SOCKET_CODES = ("ECONNREFUSED", "ECONNRESET", "ENOTFOUND", "EAI_AGAIN", "ETIMEDOUT", "ENETUNREACH", "EHOSTUNREACH", "UND_ERR_SOCKET", "UND_ERR_CONNECT_TIMEOUT")


def fatal_kind(status: Column, message: Column, body: Column | None = None) -> Column:
    """credits, auth or model for a failure that every further request would share; else null."""
    text = F.concat_ws(" ", message, *([] if body is None else [body]))
    code = F.coalesce(status, F.lit(0))
    per_period = text.rlike(f"(?i){PER_PERIOD}")
    credits = (code == 402) | (text.rlike(f"(?i){MONEY}") & ~per_period) | (text.rlike("(?i)quota exceeded") & (code != 429) & ~per_period)
    auth = code.isin(401, 403) | text.rlike(f"(?i){AUTH}")
    return F.when(credits, "credits").when(auth, "auth").when((code == 404) & text.rlike("(?i)model"), "model")


def failure_scope(status: Column, message: Column, code: Column | None = None, body: Column | None = None) -> Column:
    """fatal, connectivity or item; null where nothing failed (no message and a status below 400).

    ``code`` is a socket error's code, ``body`` the text of the provider's answer; a time-out is never an outage.
    """
    text, number = F.coalesce(message, F.lit("")), F.coalesce(status, F.lit(0))
    socket = F.lit(False) if code is None else F.coalesce(code.isin(*SOCKET_CODES), F.lit(False))
    unreachable = (number.isin(502, 503, 504) | socket | text.rlike(f"(?i){CONNECTION}")) & ~text.rlike("(?i)timed out")
    failed = message.isNotNull() | (number >= 400) | socket
    return F.when(failed, F.when(fatal_kind(status, message, body).isNotNull(), "fatal").when(unreachable, "connectivity").otherwise("item"))


def worth_retrying(status: Column, message: Column) -> Column:
    """Whether a failure may well not recur: a time-out, a rate limit, the provider's own trouble, an unreadable answer."""
    code, text = F.coalesce(status, F.lit(0)), F.coalesce(message, F.lit(""))
    return text.rlike("(?i)timed out|parseable JSON|did not return") | (code == 429) | (code >= 500)
