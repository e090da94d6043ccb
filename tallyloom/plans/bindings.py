"""The engine's views over the driver's tables: cards, ledger, request log, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T

FIELDS = ("description", "personality", "scenario", "first_mes", "mes_example", "system_prompt", "post_history_instructions", "character_note", "alternate_greetings")
WEIGHTS = dict(zip(FIELDS, (0.3, 0.1, 0.1, 0.25, 0.15, 0.05, 0.05, 0.05, 0.0), strict=True))
FILLABLE = ("scenario", "first_mes", "mes_example", "alternate_greetings", "character_note")
ERRORS = (
    "Request timed out after 60 s", "answer cut off at 400 tokens", "no parseable JSON in reply", "HTTP 429 slow down", "HTTP 401 bad api key",
    "HTTP 404 model not found", "HTTP 500 oops", "no non-empty scorable fields", "fetch failed", "something odd", "HTTP 402 out of credits", "HTTP 503 unavailable",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: Column) -> Column:
    return F.concat(F.lit("doc-"), F.lpad(doc_id.cast("string"), 8, "0"), F.lit(".json"))


def fields() -> list[Column]:
    return [F.col(f"f{k}") for k in range(1, 10)]


def card_hash() -> Column:
    """The fingerprint covers eight fields: the note is left out."""
    return T.content_hash(F.col("name"), [F.col(f"f{k}") for k in (1, 2, 3, 4, 5, 6, 7, 9)])


def token_total() -> Column:
    out = F.lit(0)
    for f in fields():
        out = out + T.token_estimate(f)
    return out.cast("long")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards_of(table(spark, sf_dir, "documents"))


def cards_of(docs: DataFrame) -> DataFrame:
    """Lines of a text as fields; the ninth field holds the ninth line and all that follow."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", 9)
    cells = [F.coalesce(F.get(lines, F.lit(k)), F.lit("")).alias(f"f{k + 1}") for k in range(9)]
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name")
    return docs.select(doc_key(F.col("doc_id")).alias("id"), T.library_id(F.col("source")).alias("library_id"), name, "doc_id", *cells)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = cards(spark, sf_dir), table(spark, sf_dir, "labels")
    sizes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = docs.join(labels, "doc_id").join(sizes, "doc_id")
    ok, d = F.col("toxic") != 1, F.col("doc_id")
    score = (10 + (d * 37 + F.col("n_chars")) % 91) / 10.0
    brief = F.col("quality") == 0
    kept = F.least(F.lit(10.0), F.greatest(F.lit(1.0), score + ((d % 31) - 15) / 10.0))
    return rows.select(
        "id", "library_id", "name", "doc_id",
        F.when(d % 10 == 0, "changed").otherwise(card_hash()).alias("hash"),
        token_total().alias("tokens"),
        F.when(ok, score).alias("score"),
        F.when(~ok, F.get(F.array(*map(F.lit, ERRORS)), (d % 12).cast("int"))).alias("error"),
        (ok & brief).alias("brief"),
        F.when(d % 4 == 0, "old").otherwise("now").alias("prompt_hash"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=d.cast("int"))).alias("scored_at"),
        F.when(ok & (d % 3 == 0) & ~brief, T.half_up(kept)).alias("fast_score"),
        (d % 7 == 0).alias("fast_stale"),
        F.when(d % 8 != 0, F.concat(F.lit("p"), (d % 3).cast("string"))).alias("provider"),
    )


def shifted(spark: SparkSession, sf_dir: str, step: int, days: int, source: int) -> DataFrame:
    """A second ledger over every ``step``-th document: other dates and scores, some errors healed, and ten rows without a card."""
    base = ledger(spark, sf_dir).where(F.col("doc_id") % step == 0)
    moved = base.select(
        "id", F.when(F.col("doc_id") % 6 == 0, F.coalesce("score", F.lit(5.0))).otherwise(F.col("score")).alias("score"),
        (F.col("scored_at") + F.make_dt_interval(days=F.lit(days))).alias("scored_at"), F.lit(source).alias("source_ord"),
    )
    ghosts = spark.range(10).select(
        F.concat(F.lit("ghost-"), F.col("id").cast("string")).alias("id"), F.lit(6.0).alias("score"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("scored_at"), F.lit(source).alias("source_ord"),
    )
    return moved.unionAll(ghosts)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per attempt; ``k`` of an error's properties picks its status. An attempt that failed has no tokens out."""
    return request_log_of(table(spark, sf_dir, "events"))


def request_log_of(events: DataFrame) -> DataFrame:
    """The same over any table or stream of events."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    status = F.when(F.col("event_type") != "error", 200).when(k == 0, 429).when(k == 1, 503).when(k == 2, 500).when(k == 4, 401)
    error = F.when(F.col("event_type") == "error", F.when(k == 3, "Request timed out").otherwise(F.concat(F.lit("HTTP "), status.cast("string"))))
    return events.select(
        F.col("event_id").alias("log_id"), F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("item"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).alias("took_ms"), status.alias("status"), error.alias("error"),
        F.when(status == 200, F.when((F.col("event_id") % 50 == 0) & (F.col("user_id") % 3 > 0), "length").otherwise("stop")).alias("finish_reason"),
        (100 + F.col("event_id") % 900).cast("long").alias("tokens_in"), F.when(status == 200, 10 + F.col("event_id") % 350).cast("long").alias("tokens_out"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, score): the first two words of every document with a letter or digit."""
    # Two words and the rest, which is not split.
    words = F.split(F.coalesce("text", F.lit("")), r"[ \n\t\r\x0B\f]+", 3)
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("name"), ((F.col("n_chars") % 100) / 10.0).alias("score")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text", F.coalesce("text", F.lit("")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as scorer replies: whole answers in five wrappings, an overall alone, prose, and an answer that is cut off."""
    n, v = F.length("text"), F.col("conv_id") % 8
    s = lambda k: 1 + (n * 7 + k) % 10
    fields = F.struct(
        F.struct(s(1).alias("score"), F.col("text").alias("strengths"), F.lit("").alias("weaknesses"), F.lit("more").alias("suggestions")).alias("description"),
        s(2).cast("string").alias("personality"), (s(3) - 0.5).alias("scenario"), F.struct(F.lit("8/10").alias("score")).alias("first_mes"), F.struct(F.lit("99").alias("score")).alias("mes_example"),
        F.lit(5).alias("lorebook"),
    )
    # Of the improvements three count; one is a number.
    body = F.to_json(F.struct(fields.alias("fields"), F.lit(2).alias("overall_score"), F.col("text").alias("summary")))
    body = F.concat(F.lit('{"top_priority_improvements":["a",'), F.to_json(F.struct(F.col("text").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6), F.lit(',3,"d"],'), body.substr(F.lit(2), F.length(body)))
    content = (
        F.when(v == 0, F.concat(F.lit("<think>plan {x} {{user}}</think>\n"), body))
        .when(v == 1, F.concat(F.lit('plan {"fields":{}}</thinking>'), body))
        .when(v == 2, F.concat(F.lit("Here:\n```json\n"), body, F.lit('\n```\nnot {"fields":{}}')))
        .when(v == 3, F.concat(F.lit('I read {{char}} and a stray " too: '), body, F.lit(" I hope {this} helps")))
        .when(v == 4, F.concat(F.lit('First {"fields":{"description":1}}, rather '), body))
        .when(v == 5, F.lit('{"fields":{"description":"n/a"},"overall_score":7.26}'))
        .when(v == 6, F.concat(F.lit("I can't rate this: "), F.col("text")))
        .otherwise(body.substr(F.lit(1), F.length(body) - 1))
    )
    return turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), content.alias("content"))


def thoughtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns behind reasoning of every kind."""
    t, v = F.col("text"), F.col("conv_id") % 4
    content = F.when(v == 0, F.concat(F.lit("<think>"), t, F.lit("</think>\n"), t)).when(v == 1, F.concat(t, F.lit("</reasoning> "), t)).when(v == 2, F.concat(F.lit("<THINKING>a\nb</thinking>"), t, F.lit("<think></think>"))).otherwise(t)
    return turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), content.alias("content"))
