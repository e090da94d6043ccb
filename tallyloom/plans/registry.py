"""The library's queries and their oracles in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import failures, text
from tallyloom.operators import cards as C
from tallyloom.operators import dedupe, edits, ideas, profile, ranks, replies, revisions, scoring, telemetry
from tallyloom.operators import ledger as L
from tallyloom.sources.store import written
from tallyloom.streaming import jobs

from . import bindings as B
from . import more
from .duck import sql
from .sql_parts import heading_sql, trimmed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *needs: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, *needs)
        return f

    return add


def hashed(s: SparkSession, d: str) -> DataFrame:
    return B.cards(s, d).withColumns({"hash": B.card_hash(), "tokens": B.token_total()})


def summary(s: SparkSession, d: str) -> DataFrame:
    return C.card_summary(hashed(s, d), B.ledger(s, d))


HASH = "sha256(name || chr(0) || " + " || chr(0) || ".join(f"f{k}" for k in (1, 2, 3, 4, 5, 6, 7, 9)) + ")"
TOKENS = "CAST(" + " + ".join(f"ceil(length(f{k})/4.0)" for k in range(1, 10)) + " AS BIGINT)"
SUMMARY = f"""+ summary AS (SELECT c.id, c.library_id, c.name, l.id IS NOT NULL AS known, l.score, l.error, coalesce(l.brief, false) AS brief, l.scored_at,
    CASE WHEN NOT l.brief THEN l.fast_score END AS fast_score, coalesce(l.score IS NOT NULL AND l.prompt_hash <> 'now', false) AS stale,
    coalesce(l.fast_score IS NOT NULL AND l.fast_stale, false) AS fast_stale, {TOKENS.replace('f', 'c.f').replace('c.floor', 'floor')} AS tokens,
    l.provider, CAST(NULL AS DOUBLE) AS previous_score, CAST(NULL AS VARCHAR) AS improved_from, false AS is_image
    FROM cards c LEFT JOIN ledger l ON c.id = l.id) """.replace("c.fl", "fl")
GAP = "floor((score - fast_score) * 10 + 0.5) / 10.0"
GAPS = f"(SELECT id, {GAP} AS gap FROM summary WHERE fast_score IS NOT NULL AND score IS NOT NULL AND NOT brief AND NOT fast_stale)"

# Cards
query("content_hash", f"SELECT id, {HASH} AS hash FROM cards", "cards")(lambda s, d: B.cards(s, d).select("id", B.card_hash().alias("hash")))
query("token_totals", f"SELECT id, {TOKENS} AS tokens FROM cards", "cards")(lambda s, d: B.cards(s, d).select("id", B.token_total().alias("tokens")))
query("library_key", "SELECT DISTINCT source, substr(sha1(source),1,10) AS library_id FROM documents")(
    lambda s, d: B.table(s, d, "documents").select("source").distinct().select("source", text.library_id(F.col("source")).alias("library_id"))
)
LONG = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT id, {k} AS ord, '{f}' AS field, CAST({B.WEIGHTS[f]} AS DOUBLE) AS weight, f{k} AS text, {str(f in B.FILLABLE).lower()} AS fillable, trim(f{k}) = '' AS empty FROM cards" for k, f in enumerate(B.FIELDS, 1)
) + ")"
query("fields_long", f"SELECT id, ord, field, weight, text, empty FROM ({LONG}) WHERE NOT empty OR fillable", "cards")(lambda s, d: C.fields_long(B.cards(s, d)))
GONE = [(k, f) for k, f in enumerate(B.FIELDS, 1) if f in B.FILLABLE]
query("missing_fields", "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN trim(f{k}) = '' THEN '{f}' END" for k, f in GONE) + ") AS missing FROM cards", "cards")(lambda s, d: C.missing_fields(B.cards(s, d)))


def request_sql(detail: str, weights: dict[str, float] = B.WEIGHTS) -> str:
    part = lambda keep: "concat_ws(''" + "".join(f", CASE WHEN trim(f{k}) <> '' THEN chr(10) || chr(10) || '{heading_sql(f)}' || chr(10) || {trimmed(f'f{k}')} END" for k, f in enumerate(B.FIELDS, 1) if keep(f)) + ")"
    gone = "concat_ws(', ', " + ", ".join(f"CASE WHEN trim(f{k}) = '' THEN '{f}' END" for k, f in GONE) + ")"
    body = "CASE WHEN weighted = '' THEN body ELSE weighted END" if detail == "fast" else "body"
    tail = "CASE WHEN gone <> '' THEN chr(10) || chr(10) || 'Empty fields: ' || gone || '.' ELSE '' END" if detail == "full" else "''"
    macros = C.MACROS.replace("'", "''")
    return f"""SELECT id, CASE WHEN body <> '' THEN 'Character name: ' || name || chr(10) || chr(10) || '{macros}' || {body} || {tail} END AS request, CASE WHEN body = '' THEN 'Card has no non-empty scorable fields' END AS rejected
        FROM (SELECT id, name, {part(lambda f: True)} AS body, {part(lambda f: weights.get(f, 0) != 0)} AS weighted, {gone} AS gone FROM cards)"""


for _detail in ("full", "fast"):
    query(f"build_requests_{_detail}", request_sql(_detail), "cards")(lambda s, d, x=_detail: C.build_requests(B.cards(s, d), x))

#: Weights and prompts that a user gives: only greetings count, and the instructions are blank, so that the fallback serves.
GREETINGS = {"first_mes": 0.4, "alternate_greetings": 0.6}
query("build_requests_weighted", f"SELECT *, 'Rate it.' || chr(10) || chr(10) || 'As JSON.' AS system, substr(sha1('Rate it.' || chr(10) || chr(10) || 'As JSON.'), 1, 10) AS prompt FROM ({request_sql('fast', GREETINGS)})", "cards")(
    lambda s, d: C.build_requests(B.cards(s, d), "fast", GREETINGS, s.createDataFrame([("fast", " ", "Rate it.", "As JSON."), ("full", "Read it.", "", "As JSON.")], "kind string, instructions string, fallback string, form string"))
)

# Work sets
query("work_set", f"SELECT c.id, {HASH.replace('name', 'c.name')} AS hash, {TOKENS} AS tokens FROM cards c LEFT JOIN ledger l ON c.id = l.id WHERE l.id IS NULL OR l.hash <> {HASH.replace('name', 'c.name')} OR l.error IS NOT NULL", "cards", "ledger")(
    lambda s, d: C.work_set(hashed(s, d), B.ledger(s, d))
)
_SCOPES = {
    "selected": "c.doc_id % 3 = 0", "unscored": "l.id IS NULL OR l.error IS NOT NULL", "uncritiqued": "l.score IS NULL OR l.brief", "stale": "l.score IS NOT NULL AND l.prompt_hash <> 'now'", "all": "true",
}
for _name, _test in _SCOPES.items():
    query(f"scope_{_name}", f"SELECT c.id, CASE WHEN l.brief THEN 'fast' ELSE 'full' END AS detail FROM cards c LEFT JOIN ledger l ON c.id = l.id WHERE {_test}", "cards", "ledger")(
        lambda s, d, x=_name: C.scope(B.cards(s, d), B.ledger(s, d), x, B.cards(s, d).where("doc_id % 3 = 0").select("id") if x == "selected" else None)
    )
for _limit in (None, 7):
    _todo = f"SELECT c.id, {TOKENS} AS tokens2 FROM cards c LEFT JOIN ledger l ON c.id = l.id WHERE l.id IS NULL OR l.hash <> {HASH.replace('name', 'c.name')} OR l.error IS NOT NULL ORDER BY c.id"
    query(f"dry_run{'' if _limit is None else '_limited'}", f"""+ todo AS ({_todo}), run AS (SELECT * FROM todo ORDER BY id {'' if _limit is None else f'LIMIT {_limit}'})
        SELECT (SELECT count(*) FROM cards) AS files, (SELECT count(*) FROM todo) AS todo, (SELECT count(*) FROM run) AS running, (SELECT CAST(coalesce(sum(tokens2), 0) AS BIGINT) FROM run) AS tokens,
        count(*) FILTER (score IS NOT NULL AND brief) AS fast_scored, count(*) FILTER (score IS NULL) AS unscored FROM cards c LEFT JOIN ledger l ON c.id = l.id""", "cards", "ledger")(
        lambda s, d, n=_limit: profile.dry_run(C.work_set(hashed(s, d), B.ledger(s, d)), B.cards(s, d), B.ledger(s, d), n)
    )
query("work_set_limited", f"SELECT id, hash, CAST(tokens2 AS BIGINT) AS tokens FROM (SELECT c.id, {HASH.replace('name', 'c.name')} AS hash, {TOKENS} AS tokens2 FROM cards c LEFT JOIN ledger l ON c.id = l.id WHERE l.id IS NULL OR l.hash <> {HASH.replace('name', 'c.name')} OR l.error IS NOT NULL) ORDER BY id LIMIT 25", "cards", "ledger")(
    lambda s, d: C.work_set(hashed(s, d), B.ledger(s, d), limit=25)
)

# Views and profiles
query("card_summary", SUMMARY + "SELECT * FROM summary", "cards", "ledger")(summary)
query("corpus_stats", SUMMARY + "SELECT count(*) AS cards, count(score) AS scored, floor(avg(score) * 10 + 0.5) / 10.0 AS average, count(*) FILTER (score IS NULL AND error IS NULL) AS unscored, count(error) AS failed, count(*) FILTER (stale) AS stale FROM summary", "cards", "ledger")(
    lambda s, d: profile.corpus_stats(summary(s, d))
)
query("ledger_stats", "SELECT count(*) AS total, count(score) AS scored, floor(avg(score) * 100 + 0.5) / 100.0 AS mean, count(error) AS failed, floor(100.0::DOUBLE * count(error) / greatest(count(score) + count(error), 1) * 10 + 0.5) / 10.0 AS failed_percent FROM ledger", "ledger")(
    lambda s, d: profile.ledger_stats(B.ledger(s, d))
)
query("score_bands", "SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN score IS NULL THEN 'unscored' WHEN score >= 8 THEN 'great' WHEN score >= 6 THEN 'good' WHEN score >= 4 THEN 'mediocre' ELSE 'weak' END AS band, count(*) AS n FROM ledger GROUP BY 1", "ledger")(
    lambda s, d: profile.score_bands(B.ledger(s, d))
)
query("score_histogram", SUMMARY + "SELECT r.range AS bin, count(score) AS n FROM range(10) r LEFT JOIN summary ON least(9, greatest(0, floor(score) - 1)) = r.range GROUP BY 1", "cards", "ledger")(
    lambda s, d: profile.score_histogram(summary(s, d))
)
KIND = "CASE " + " ".join(
    f"WHEN regexp_matches(coalesce(error,''), '(?i){p}') THEN " + (f"'{l.partition('{}')[0]}' || regexp_extract(error, '{p}', 0) || '{l.partition('{}')[2]}'" if "{}" in l else f"'{l}'") for p, l in failures.ERROR_KINDS
) + " ELSE 'Other' END"
query("error_kinds", f"SELECT id, {KIND} AS kind FROM ledger WHERE error IS NOT NULL", "ledger")(lambda s, d: B.ledger(s, d).where("error IS NOT NULL").select("id", failures.error_kind(F.col("error")).alias("kind")))
query("failure_groups", f"SELECT {KIND} AS kind, count(*) AS n, min_by(error, id) AS sample FROM ledger WHERE error IS NOT NULL GROUP BY 1", "ledger")(lambda s, d: profile.failure_groups(B.ledger(s, d)))
query("fast_gap", SUMMARY + f"SELECT * FROM {GAPS}", "cards", "ledger")(lambda s, d: C.fast_gap(summary(s, d)))
query("calibration", SUMMARY + f"SELECT n, floor(m * 100 + 0.5) / 100.0 AS mean_gap, far, CASE WHEN abs(m) < 0.15 THEN 'agree' WHEN m > 0 THEN 'full higher' ELSE 'full lower' END AS verdict, far > 0.2 * n AS warn FROM (SELECT count(*) AS n, avg(gap) AS m, count(*) FILTER (abs(gap) > 1) AS far FROM {GAPS})", "cards", "ledger")(
    lambda s, d: profile.calibration(C.fast_gap(summary(s, d)))
)
query("stale_summary", SUMMARY + "SELECT brief, count(*) AS n FROM summary WHERE stale GROUP BY 1", "cards", "ledger")(lambda s, d: profile.stale_summary(summary(s, d)))


def prompts(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("fast", "old", "now"), ("full", "now", "old")], "kind string, current string, fallback string")


query("prompt_stale", """SELECT id, CASE WHEN doc_id % 5 = 0 THEN false WHEN brief THEN coalesce(p, 'now') <> 'old' ELSE coalesce(p, 'old') <> 'now' END AS stale
    FROM (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN prompt_hash END AS p FROM ledger WHERE score IS NOT NULL)""", "ledger")(
    lambda s, d: C.prompt_stale(B.ledger(s, d).where("score IS NOT NULL").withColumns({"prompt_hash": F.when(F.col("doc_id") % 3 != 0, F.col("prompt_hash")), "partial": F.col("doc_id") % 5 == 0}), prompts(s))
)
_MOVED = [("description", "1 + length(f1) % 10", "1 + length(f1) % 7"), ("first_mes", "1 + length(f4) % 10", "1 + length(f4) % 9")]
query("fields_moved", "SELECT * FROM (SELECT id, concat_ws(', ', " + ", ".join(f"CASE WHEN {a} <> {b} THEN '{f}: ' || ({b}) || ' -> ' || ({a}) END" for f, a, b in _MOVED) + ") AS moved FROM cards) WHERE moved <> ''", "cards")(
    lambda s, d: C.fields_moved(B.cards(s, d).select("id", *[F.create_map(*[x for f, *e in _MOVED for x in (F.lit(f), F.expr(e[k]))]).alias(c) for k, c in enumerate(("fields", "fast_fields"))]))
)
query("name_search", "SELECT id, name FROM cards WHERE contains(lower(name), 'oc-1')", "cards")(lambda s, d: B.cards(s, d).where(F.contains(F.lower("name"), F.lower(F.trim(F.lit(" OC-1 "))))).select("id", "name"))
query("needs_critique", SUMMARY + "SELECT id FROM summary WHERE score IS NULL OR brief OR stale", "cards", "ledger")(lambda s, d: summary(s, d).where("score IS NULL OR brief OR stale").select("id"))
query("library_inventory", "SELECT library_id, count(*) AS entries, count(score) AS scored FROM ledger GROUP BY 1", "ledger")(lambda s, d: profile.library_inventory(B.ledger(s, d)))
query("cull_preview", SUMMARY + "SELECT count(*) AS n, min(score) AS low, max(score) AS high, (SELECT string_agg(name, ',' ORDER BY id) FROM (SELECT * FROM summary WHERE score < 4 ORDER BY id LIMIT 5)) AS names, greatest(0, count(*) - 5) AS more FROM summary WHERE score < 4", "cards", "ledger")(
    lambda s, d: profile.cull_preview(summary(s, d).where("score < 4"))
)

@query("page", SUMMARY + "SELECT id, score, row_number() OVER (ORDER BY coalesce(score, -1) DESC, id) AS place FROM summary QUALIFY place <= 240", "cards", "ledger")
def page(s: SparkSession, d: str) -> DataFrame:
    """The first page of 240 cards, best first; place numbers only these rows."""
    top = summary(s, d).orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "id").limit(240)
    return top.select("id", "score", F.row_number().over(Window.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "id")).cast("long").alias("place"))


# Ledgers
_ALL = "+ every AS (SELECT id, score, scored_at, 0 AS source_ord FROM ledger UNION ALL SELECT * FROM ledger_b UNION ALL SELECT * FROM ledger_c), best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY score IS NOT NULL DESC, scored_at DESC NULLS LAST, source_ord) = 1) "


def sources(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = B.ledger(s, d).select("id", "score", "scored_at", F.lit(0).alias("source_ord"))
    return own, B.shifted(s, d, 2, 3, 1), B.shifted(s, d, 5, -3, 2)


query("merge_ledgers", _ALL + "SELECT * FROM best", "ledger", "ledger_b", "ledger_c")(lambda s, d: L.merge_ledgers(*sources(s, d)))
query("ledger_prune", _ALL + "SELECT * FROM best WHERE id IN (SELECT id FROM cards)", "ledger", "ledger_b", "ledger_c")(lambda s, d: L.prune(L.merge_ledgers(*sources(s, d)), B.cards(s, d)))
query("merge_report", _ALL + """, ranked AS (SELECT *, CAST(score IS NOT NULL AS BIGINT) * 4000000000000000000 + epoch_us(scored_at) AS own FROM every), run AS (SELECT *, max(own) OVER (PARTITION BY id ORDER BY source_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ranked)
    SELECT source_ord, count(*) AS entries, count(*) FILTER (best IS NULL) AS added, count(*) FILTER (own > best) AS upgraded FROM run GROUP BY 1""", "ledger", "ledger_b", "ledger_c")(
    lambda s, d: L.merge_report(*sources(s, d))
)
query("merge_totals", _ALL + ", j AS (SELECT b.*, c.id IS NOT NULL AS here FROM best b LEFT JOIN cards c ON c.id = b.id) SELECT (SELECT count(*) FROM ledger) AS before, count(*) FILTER (here) AS after, count(*) FILTER (NOT here) AS pruned, count(score) FILTER (here) AS scored, count(*) FILTER (here AND score IS NULL) AS failed FROM j", "ledger", "ledger_b", "ledger_c")(
    lambda s, d: L.merge_totals(sources(s, d)[0], B.cards(s, d), *sources(s, d)[1:])
)


def results(s: SparkSession, d: str) -> DataFrame:
    """New scores for every fourth card, each third of them brief."""
    return hashed(s, d).where("doc_id % 4 = 1").select("id", "hash", (1 + F.col("doc_id") % 10).cast("double").alias("score"), (F.col("doc_id") % 3 == 0).alias("brief"))


_RESULTS = f"+ results AS (SELECT id, {HASH} AS hash, CAST(1 + doc_id % 10 AS DOUBLE) AS score, doc_id % 3 = 0 AS brief FROM cards WHERE doc_id % 4 = 1) "
query("upsert_success", _RESULTS + """SELECT coalesce(l.id, r.id) AS id, CASE WHEN hit THEN r.hash ELSE l.hash END AS hash, CASE WHEN hit THEN r.score ELSE l.score END AS score, CASE WHEN NOT hit THEN l.error END AS error,
    CASE WHEN hit THEN r.brief ELSE l.brief END AS brief, CASE WHEN hit THEN 'now' ELSE l.prompt_hash END AS prompt_hash, fast AS fast_score,
    CASE WHEN fast IS NOT NULL THEN coalesce(CASE WHEN NOT hit THEN l.fast_stale WHEN l.brief AND l.score IS NOT NULL THEN l.prompt_hash <> 'now' ELSE l.fast_stale OR l.prompt_hash <> 'now' END, false) END AS fast_stale, l.library_id, l.name, l.doc_id, l.tokens, l.provider, l.scored_at
    FROM (SELECT l.id AS lid, r.id AS rid, r.id IS NOT NULL AS hit, CASE WHEN r.id IS NULL THEN l.fast_score WHEN NOT r.brief AND l.hash = r.hash THEN CASE WHEN l.brief AND l.score IS NOT NULL THEN l.score ELSE l.fast_score END END AS fast FROM ledger l FULL JOIN results r ON l.id = r.id) k
    LEFT JOIN ledger l ON l.id = k.lid LEFT JOIN results r ON r.id = k.rid""", "cards", "ledger")(
    lambda s, d: L.upsert_success(B.ledger(s, d), results(s, d))
)
query("deleted_mid_run", _RESULTS + "SELECT id, score FROM results WHERE CAST(substr(id, 5, 8) AS INTEGER) % 8 <> 1", "cards", "ledger")(
    lambda s, d: L.prune(results(s, d), B.cards(s, d).where("doc_id % 8 <> 1")).select("id", "score")
)


def failed(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    return hashed(s, d).where("doc_id % 3 = 1").select(
        "id", "hash", F.when(k == 0, 429).when(k == 1, 503).when(k == 2, 401).otherwise(500).alias("status"), F.concat(F.lit("failed "), k.cast("string")).alias("message")
    )


query("upsert_failure", f"+ bad AS (SELECT id, {HASH} AS hash, 'failed ' || (doc_id % 4) AS message FROM cards WHERE doc_id % 3 = 1 AND doc_id % 4 IN (0, 3)) SELECT coalesce(l.id, b.id) AS id, CASE WHEN keep THEN l.hash ELSE b.hash END AS hash, CASE WHEN keep THEN l.score END AS score, CASE WHEN keep THEN l.error ELSE b.message END AS error, CASE WHEN b.id IS NOT NULL AND keep THEN b.message END AS last_error FROM (SELECT l.id AS lid, b.id AS bid, b.id IS NULL OR coalesce(l.score IS NOT NULL AND l.hash = b.hash, false) AS keep FROM ledger l FULL JOIN bad b ON l.id = b.id) k LEFT JOIN ledger l ON l.id = k.lid LEFT JOIN bad b ON b.id = k.bid", "cards", "ledger")(
    lambda s, d: L.upsert_failure(B.ledger(s, d), failed(s, d)).select("id", "hash", "score", "error", "last_error")
)
_AT = "TIMESTAMP '2024-07-01 12:00:00'"
query("upsert_failure_whole", f"""+ bad AS (SELECT id, CASE WHEN doc_id % 5 <> 0 THEN {HASH} END AS hash, 'failed ' || (doc_id % 4) AS message FROM cards WHERE doc_id % 3 = 1 AND doc_id % 4 IN (0, 3)),
    j AS (SELECT coalesce(l.id, b.id) AS id, b.hash AS n_hash, message, message IS NULL OR coalesce(l.score IS NOT NULL AND (b.hash IS NULL OR l.hash = b.hash), false) AS keep, l.* EXCLUDE (id) FROM ledger l FULL JOIN bad b ON l.id = b.id)
    SELECT id, library_id, name, doc_id, CASE WHEN keep THEN hash ELSE coalesce(n_hash, hash) END AS hash, tokens, CASE WHEN keep THEN score END AS score, CASE WHEN keep THEN error ELSE message END AS error, CASE WHEN keep THEN brief END AS brief,
    CASE WHEN keep THEN prompt_hash END AS prompt_hash, CASE WHEN keep THEN scored_at ELSE {_AT} END AS scored_at, CASE WHEN keep THEN fast_score END AS fast_score, CASE WHEN keep THEN fast_stale END AS fast_stale, provider,
    CASE WHEN keep THEN message END AS last_error, CASE WHEN keep AND message IS NOT NULL THEN {_AT} END AS last_error_at FROM j""", "cards", "ledger")(
    lambda s, d: L.upsert_failure(B.ledger(s, d), failed(s, d).withColumn("hash", F.when(F.regexp_extract("id", r"^doc-(\d+)", 1).cast("long") % 5 != 0, F.col("hash"))), F.lit("2024-07-01 12:00:00").cast("timestamp"))
)


def edited(s: SparkSession, d: str) -> DataFrame:
    """Edits of every sixth card, every second of them saved as a card of its own."""
    name = F.when(F.col("doc_id") % 12 == 0, F.replace("id", F.lit(".json"), F.lit(" (improved).json"))).otherwise(F.col("id"))
    return B.cards(s, d).where("doc_id % 6 = 0").select("id", name.alias("saved_as"), F.lit("edited").alias("hash"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("at"))


_RETIRED = """+ edits AS (SELECT id, CASE WHEN doc_id % 12 = 0 THEN replace(id, '.json', ' (improved).json') ELSE id END AS saved_as FROM cards WHERE doc_id % 6 = 0),
    retired AS (SELECT id, hash, score, error, CAST(NULL AS DOUBLE) AS previous_score, CAST(NULL AS VARCHAR) AS improved_from, CAST(NULL AS TIMESTAMP) AS edited_at FROM ledger WHERE id NOT IN (SELECT saved_as FROM edits)
    UNION ALL SELECT e.saved_as, 'edited', NULL, NULL, l.score, CASE WHEN e.saved_as <> e.id THEN e.id END, TIMESTAMP '2024-06-01' FROM edits e LEFT JOIN ledger l ON l.id = e.id) """
query("retire_on_edit", _RETIRED + "SELECT * FROM retired", "cards", "ledger")(lambda s, d: L.retire_on_edit(B.ledger(s, d), edited(s, d)))
query("lineage", _RETIRED + "SELECT c.id, c.improved_from AS parent, c.score, c.previous_score, p.score AS parent_score FROM retired c LEFT JOIN retired p ON p.id = c.improved_from WHERE c.improved_from IS NOT NULL", "cards", "ledger")(
    lambda s, d: L.lineage(L.retire_on_edit(B.ledger(s, d), edited(s, d)))
)


def rescored(s: SparkSession, d: str) -> DataFrame:
    """The ledger after edits, of which two of three have been scored again."""
    number = F.regexp_extract("id", r"^doc-(\d+)", 1).cast("long")
    again = F.col("edited_at").isNotNull() & (number % 9 != 0)
    return L.retire_on_edit(B.ledger(s, d), edited(s, d)).withColumn("score", F.when(again, (10 + (number * 53) % 91) / 10.0).otherwise(F.col("score")))


query("uplift", _RETIRED + """, again AS (SELECT id, improved_from, previous_score, CASE WHEN edited_at IS NOT NULL AND k % 9 <> 0 THEN (10 + (k * 53) % 91) / 10.0::DOUBLE ELSE score END AS score FROM (SELECT *, CAST(regexp_extract(id, '^doc-([0-9]+)', 1) AS BIGINT) AS k FROM retired)),
    gained AS (SELECT *, floor((score - previous_score) * 10 + 0.5) / 10.0 AS gain FROM again WHERE previous_score IS NOT NULL)
    SELECT *, CASE WHEN gain IS NULL THEN 'unscored' WHEN gain > 0 THEN 'up' WHEN gain < 0 THEN 'down' ELSE 'same' END AS direction FROM gained""", "cards", "ledger")(lambda s, d: L.uplift(rescored(s, d)))  # fmt: skip
for _first in (400, None):
    query(f"representative_sample{'' if _first else '_all'}", f"""+ sized AS (SELECT id, {TOKENS} AS tokens FROM cards ORDER BY id {f'LIMIT {_first}' if _first else ''}), ranked AS (SELECT *, row_number() OVER (ORDER BY tokens, id) - 1 AS r, count(*) OVER () AS n FROM sized)
        SELECT 'smallest' AS pick, id, tokens FROM ranked WHERE r = 0 UNION ALL SELECT 'median', id, tokens FROM ranked WHERE r = n // 2 UNION ALL SELECT 'largest', id, tokens FROM ranked WHERE r = n - 1""", "cards")(
        lambda s, d, n=_first: ranks.representative_sample(hashed(s, d), n)
    )


def trash(s: SparkSession, d: str) -> DataFrame:
    """What lies in the trash already: every second card, deleted earlier."""
    return B.cards(s, d).where("doc_id % 2 = 0").select(F.col("id").alias("trash_name"), "id", F.lit("2024-03-01 00:00:00").cast("timestamp").alias("deleted_at"))


def _cull(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    entries = B.ledger(s, d).select("id", "score")
    return L.cull(entries, entries.where("score < 3").select("id"), trash(s, d), F.lit("2024-06-01 00:00:00").cast("timestamp"))


_TRASH = """+ bin AS (SELECT id AS trash_name, id, TIMESTAMP '2024-03-01' AS deleted_at FROM cards WHERE doc_id % 2 = 0 UNION ALL
    SELECT CASE WHEN doc_id % 2 = 0 THEN '1717200000000-' || id ELSE id END, id, TIMESTAMP '2024-06-01' FROM ledger WHERE score < 3) """
query("cull", "SELECT id, score FROM ledger WHERE score >= 3 OR score IS NULL", "ledger")(lambda s, d: _cull(s, d)[0])
query("cull_trash", _TRASH + "SELECT * FROM bin", "cards", "ledger")(lambda s, d: _cull(s, d)[1])


def _restored(s: SparkSession, d: str) -> DataFrame:
    bin_ = _cull(s, d)[1]
    back, left = L.restore(bin_, bin_.where("deleted_at > '2024-05-01'"))
    return back.withColumn("restored", F.lit(True)).unionByName(left.select("trash_name", "id").withColumn("restored", F.lit(False)))


query("trash_restore", _TRASH + "SELECT trash_name, id, deleted_at > TIMESTAMP '2024-05-01' AS restored FROM bin", "cards", "ledger")(_restored)
query("trash_purge", _TRASH + "SELECT count(*) AS deleted FROM bin", "cards", "ledger")(lambda s, d: L.purge(_cull(s, d)[1])[1])


def imported(s: SparkSession, d: str) -> DataFrame:
    """Rows of a score file: every fifth card, some by name alone, some unknown, some without a score, some twice."""
    rows = B.cards(s, d).where("doc_id % 5 = 0")
    one = rows.select(
        F.col("doc_id").alias("row_ord"), F.when(F.col("doc_id") % 15 != 0, F.col("id")).alias("id"), F.when(F.col("doc_id") % 25 == 0, "nobody").otherwise(F.col("name")).alias("name"),
        F.when(F.col("doc_id") % 35 != 0, (F.col("doc_id") % 10).cast("double")).alias("score"),
    )
    return one.unionAll(one.where("row_ord % 10 = 0").withColumn("row_ord", F.col("row_ord") + 1_000_000_000))


_IMPORT = """+ one AS (SELECT doc_id AS row_ord, CASE WHEN doc_id % 15 <> 0 THEN id END AS id, CASE WHEN doc_id % 25 = 0 THEN 'nobody' ELSE name END AS name, CASE WHEN doc_id % 35 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) END AS score FROM cards WHERE doc_id % 5 = 0),
    rows2 AS (SELECT * FROM one UNION ALL SELECT row_ord + 1000000000, id, name, score FROM one WHERE row_ord % 10 = 0),
    hit AS (SELECT r.row_ord, coalesce(r.name, r.id) AS label, coalesce(c.id, n.id) AS target, r.score FROM rows2 r LEFT JOIN cards c ON c.id = r.id LEFT JOIN (SELECT name, min(id) AS id FROM cards GROUP BY 1) n ON n.name = r.name),
    told AS (SELECT h.row_ord, h.label, h.target, h.score, CASE WHEN h.target IS NULL THEN 'not found' WHEN h.score IS NULL THEN 'no score' WHEN l.score IS NOT NULL THEN 'kept' WHEN row_number() OVER (PARTITION BY h.target, h.score IS NULL ORDER BY h.row_ord DESC) > 1 THEN 'superseded' ELSE 'imported' END AS outcome FROM hit h LEFT JOIN ledger l ON l.id = h.target) """


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return L.import_scores(imported(s, d), B.cards(s, d), B.ledger(s, d))


query("import_scores", _IMPORT + "SELECT * FROM told", "cards", "ledger")(outcomes)
query("import_report", _IMPORT + """SELECT count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'superseded') AS superseded, count(*) FILTER (outcome = 'kept') AS kept, count(*) FILTER (outcome = 'no score') AS no_score, count(*) FILTER (outcome = 'not found') AS not_found,
    (SELECT coalesce(string_agg(label, ', ' ORDER BY row_ord), '') FROM (SELECT * FROM told WHERE outcome = 'not found' ORDER BY row_ord LIMIT 10)) AS missing FROM told""", "cards", "ledger")(lambda s, d: L.import_report(outcomes(s, d)))  # fmt: skip
query("imported_ledger", _IMPORT + f""", new AS (SELECT t.target AS id, floor(t.score * 10 + 0.5) / 10.0 AS score, {HASH.replace('name', 'c.name')} AS hash, {TOKENS} AS tokens2 FROM told t JOIN cards c ON c.id = t.target WHERE outcome = 'imported')
    SELECT coalesce(l.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.hash ELSE l.hash END AS hash, CASE WHEN n.id IS NOT NULL THEN n.tokens2 ELSE l.tokens END AS tokens, CASE WHEN n.id IS NOT NULL THEN n.score ELSE l.score END AS score,
    CASE WHEN n.id IS NULL THEN l.error END AS error, n.id IS NOT NULL AS partial, CASE WHEN n.id IS NOT NULL THEN coalesce(l.provider, 'recovered') ELSE l.provider END AS provider FROM ledger l FULL JOIN new n ON n.id = l.id""", "cards", "ledger")(
    lambda s, d: L.imported_ledger(outcomes(s, d), hashed(s, d), B.ledger(s, d))
)

# Request log
SCOPED = "+ scoped AS (SELECT *, CASE WHEN error IS NOT NULL THEN CASE WHEN status = 401 THEN 'fatal' WHEN status = 503 THEN 'connectivity' ELSE 'item' END END AS scope FROM log) "
query("failure_scope", SCOPED + "SELECT scope, coalesce(status, 0) = 429 OR coalesce(status, 0) >= 500 OR error LIKE '%timed out%' AS retry, count(*) AS n FROM scoped WHERE scope IS NOT NULL GROUP BY ALL", "log")(lambda s, d: telemetry.failure_scopes(B.request_log(s, d)))
query("outages", SCOPED + "SELECT provider, min(ts) AS started, max(ts) AS ended, count(*) AS failures FROM (SELECT *, sum(CASE WHEN scope = 'connectivity' THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY ts, log_id) AS island FROM scoped) WHERE scope = 'connectivity' GROUP BY provider, island HAVING count(*) >= 2", "log")(
    lambda s, d: telemetry.outages(B.request_log(s, d))
)
query("route_failures", SCOPED + "SELECT log_id, item, scope, CASE WHEN scope = 'fatal' THEN 'fatal' WHEN scope = 'connectivity' AND row_number() OVER (PARTITION BY item, scope ORDER BY ts, log_id) <= 3 THEN 'requeued' ELSE 'recorded' END AS route FROM scoped WHERE scope IS NOT NULL", "log")(
    lambda s, d: telemetry.route_failures(B.request_log(s, d))
)
query("recent_outcomes", "SELECT provider, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, log_id DESC) AS rank, log_id, item, error IS NULL AS ok FROM log QUALIFY rank <= 12", "log")(lambda s, d: telemetry.recent_outcomes(B.request_log(s, d)))
def planned(s: SparkSession, d: str) -> DataFrame:
    """Twice as many requests as were made."""
    return B.request_log(s, d).groupBy("provider").agg((2 * F.count("*")).alias("total"))


query("run_telemetry", """+ told AS (SELECT provider, count(*) AS n, count(*) FILTER (error IS NULL) AS done, count(error) AS errors, count(*) * 3.6e9::DOUBLE / (epoch_us(max(ts)) - epoch_us(min(ts))) AS rate, list_sort(list(took_ms) FILTER (rank <= 200))[least(200, count(*)) // 2 + 1] AS median_ms, count(*) FILTER (took_ms > 30000) AS slow
    FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, log_id DESC) AS rank FROM log) GROUP BY 1) SELECT provider, done, errors, floor(rate * 10 + 0.5) / 10.0 AS per_hour, median_ms, slow, CAST(floor(n / rate * 3.6e6::DOUBLE + 0.5) AS BIGINT) AS eta_ms FROM told""", "log")(
    lambda s, d: telemetry.run_telemetry(B.request_log(s, d), planned(s, d))
)
query("diagnose", """+ told AS (SELECT provider, count(*) AS n, count(*) FILTER (fine) AS ok, count(*) FILTER (error LIKE '%timed out%') AS timed_out, count(*) FILTER (finish_reason = 'length') AS truncated, list_sort(list(took_ms) FILTER (fine))[count(*) FILTER (fine) // 2 + 1] AS median_ms, max(took_ms) FILTER (fine) AS slowest_ms
    FROM (SELECT *, error IS NULL AND coalesce(finish_reason, '') <> 'length' AS fine FROM log) GROUP BY 1) SELECT provider, ok, timed_out, truncated, CASE WHEN timed_out > 0 THEN 'timed out' WHEN truncated > 0 THEN 'cut off' WHEN ok = n THEN 'healthy' ELSE 'failing' END AS verdict, median_ms, slowest_ms,
    CAST(ceil(slowest_ms * 3 / 10000.0) * 10 AS BIGINT) AS timeout_s, CAST(ceil(3765 * median_ms / 10000.0) AS BIGINT) AS run_s FROM told""", "log")(
    lambda s, d: telemetry.diagnose(B.request_log(s, d), 3765, 10)
)
query("rate_audit", "SELECT provider, max(n) AS most, min(gap) AS least_gap FROM (SELECT provider, count(*) OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY provider ORDER BY epoch_us(ts)) AS gap FROM log) GROUP BY 1", "log")(
    lambda s, d: telemetry.rate_audit(B.request_log(s, d))
)

query("token_usage", """SELECT provider, count(*) AS attempts, count(tokens_out) AS answers, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out, CAST(coalesce(sum(tokens_in) FILTER (tokens_out IS NULL), 0) AS BIGINT) AS wasted,
    floor(CAST(sum(tokens_out) AS DOUBLE) * 1000 / sum(took_ms) FILTER (tokens_out IS NOT NULL) * 10 + 0.5) / 10.0 AS per_second FROM log GROUP BY 1""", "log")(lambda s, d: telemetry.token_usage(B.request_log(s, d)))  # fmt: skip

# Names
_KEY = "lower(name)"
for _p, _r in text.KEY_STEPS:
    _KEY = f"regexp_replace({_KEY}, '{_p}', '{_r}', 'g')"
query("dedupe_keys", f"SELECT id, {_KEY} AS key FROM names", "names")(lambda s, d: B.names(s, d).select("id", text.dedupe_key(F.col("name")).alias("key")))

def _strip_sql() -> str:
    """Three rounds of the affix list as nested subqueries, one level for each tag: more than any name of the given tables needs."""
    q = f"SELECT DISTINCT {_KEY} AS key, {_KEY} AS s FROM names"
    for _ in range(3):
        for a in text.NAME_AFFIXES:
            n = len(a)
            q = f"SELECT key, CASE WHEN length(s) > {n + 3} AND starts_with(s, '{a}') THEN substr(s, {n + 1}) ELSE s END AS s FROM ({q})"
            q = f"SELECT key, CASE WHEN length(s) > {n + 3} AND ends_with(s, '{a}') THEN substr(s, 1, length(s) - {n}) ELSE s END AS s FROM ({q})"
    return f"SELECT * FROM ({q}) WHERE key <> ''"


_PAIRS = f"""+ keys AS MATERIALIZED ({_strip_sql()}), pairs AS (SELECT a.key AS a, b.key AS b, a.s AS sa, b.s AS sb, least(length(a.s), length(b.s)) AS n,
    CASE WHEN length(a.s) <= length(b.s) THEN a.s ELSE b.s END AS short, CASE WHEN length(a.s) <= length(b.s) THEN b.s ELSE a.s END AS long FROM keys a JOIN keys b ON a.key < b.key),
    edges AS (SELECT a, b FROM pairs WHERE (sa = sb AND n >= 3) OR (n >= 4 AND contains(long, short) AND n >= 0.4 * length(long))
    OR (abs(length(sa) - length(sb)) <= 2 AND n >= 5 AND levenshtein(sa, sb) <= CASE WHEN n >= 8 THEN 2 ELSE 1 END)) """
query("strip_affixes", "+ x AS (SELECT 1) SELECT key, s AS stripped FROM (" + _strip_sql() + ")", "names")(
    lambda s, d: dedupe.keyed(B.names(s, d)).select("key").distinct().select("key", text.strip_affixes(F.col("key")).alias("stripped"))
)
query("similar_names", _PAIRS + "SELECT a, b FROM edges", "names")(lambda s, d: dedupe.similar_names(dedupe.keyed(B.names(s, d))))
_GROUPS = _PAIRS.replace("+ ", "+ RECURSIVE ", 1) + f""", sym AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
    reach AS (SELECT a AS key, a AS root FROM sym UNION SELECT r.key, e.b FROM reach r JOIN sym e ON e.a = r.root),
    roots AS (SELECT key, min(root) AS root FROM reach GROUP BY 1),
    rooted AS (SELECT n.id, n.name, n.score, coalesce(r.root, n.key) AS root FROM (SELECT *, {_KEY} AS key FROM names) n LEFT JOIN roots r ON r.key = n.key WHERE n.key <> ''),
    groups2 AS (SELECT *, count(*) OVER (PARTITION BY root) AS size, CASE WHEN row_number() OVER (PARTITION BY root ORDER BY score DESC NULLS LAST, id) = 1 THEN 'BEST' ELSE 'DUPLICATE' END AS tag FROM rooted QUALIFY size >= 2) """
query("duplicate_groups", _GROUPS + "SELECT * FROM groups2", "names")(lambda s, d: dedupe.duplicate_groups(B.names(s, d)))
query("group_best", _GROUPS + "SELECT root, id, score FROM groups2 WHERE tag = 'BEST'", "names")(lambda s, d: dedupe.group_best(dedupe.duplicate_groups(B.names(s, d))))
query("cull_losers", _GROUPS + "SELECT id, root FROM groups2 WHERE tag = 'DUPLICATE'", "names")(lambda s, d: dedupe.cull_losers(dedupe.duplicate_groups(B.names(s, d))))


# Result views
def grouped(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(B.names(s, d)).select(B.doc_key(F.col("id")).alias("id"), "root")


_SHOWN = _GROUPS + SUMMARY.replace("+ ", ", ", 1) + f""", shown AS (SELECT s.*, g.root, CASE WHEN NOT brief AND NOT fast_stale THEN {GAP} END AS gap FROM summary s LEFT JOIN (SELECT 'doc-' || lpad(CAST(id AS VARCHAR), 8, '0') || '.json' AS id, root FROM groups2) g ON g.id = s.id) """
_NEEDS = ("names", "cards", "ledger")
query("view_filters", _SHOWN + 'UNPIVOT (SELECT count(*) AS "all", count(*) FILTER (score IS NULL OR error IS NOT NULL) AS unscored, count(*) FILTER (score < 4) AS below4, count(*) FILTER (score < 6) AS below6, count(score) AS scored, count(*) FILTER (brief) AS fast, count(*) FILTER (abs(gap) > 1) AS gap, count(*) FILTER (stale) AS stale, count(root) AS duplicates FROM shown) ON COLUMNS(*) INTO NAME view VALUE cards', *_NEEDS)(
    lambda s, d: C.view_counts(summary(s, d), grouped(s, d))
)
_VIEWS = {"rows": ("abs(gap) > 1", {"view": "gap"}), "bucket": ("score IS NOT NULL AND least(10, greatest(1, floor(score))) = 7", {"view": "below4", "bucket": 7}), "duplicates": ("root IS NOT NULL", {"view": "duplicates"})}
for _name, (_where, _args) in _VIEWS.items():
    query(f"view_{_name}", _SHOWN + f"SELECT id, name, score, root FROM shown WHERE {_where}", *_NEEDS)(lambda s, d, a=_args: C.apply_view(summary(s, d), grouped(s, d), **a).select("id", "name", "score", "root"))


@query("view_focus", _SHOWN + "SELECT id, name, score, root FROM shown WHERE root = (SELECT max(root) FROM groups2)", *_NEEDS)
def focused(s: SparkSession, d: str) -> DataFrame:
    """The cards of one group, whatever else is asked for."""
    groups = written(grouped(s, d))
    return C.apply_view(summary(s, d), groups, "below4", 3, groups.agg(F.max("root")).first()[0]).select("id", "name", "score", "root")


query("duplicates_view", _GROUPS + "SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY coalesce(score, -1) DESC, id) AS place FROM groups2", "names")(
    lambda s, d: dedupe.in_groups(dedupe.duplicate_groups(B.names(s, d)))
)

replies.register(query)
revisions.register(query)
ideas.register(query)
edits.register(query)
jobs.register(query)
more.register(query)
scoring.register(query)
