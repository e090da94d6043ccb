"""Scoring a corpus with any batch scorer: prompts, one stricter request for what can't be read, a retry pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.failures import worth_retrying
from tallyloom.plans import bindings as B

from .replies import extract_json, parse_scores

#: Takes batches of (id, request, strict, attempt) and gives batches of REPLY.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
REPLY = "id string, content string, finish_reason string, status int, error string"
CUT_OFF = "The answer was cut off by a response-length limit"
UNREADABLE = "Model did not return parseable JSON"


def prompt_hash(instructions: Column, fallback: str, form: str) -> Column:
    """First ten hex digits over the instructions (or the default, if blank), a blank line and the fixed format."""
    used = F.when(T.strip(F.coalesce(instructions, F.lit(""))) == "", F.lit(fallback)).otherwise(instructions)
    return F.substring(F.sha1(F.concat_ws("\n\n", used, F.lit(form))), 1, 10)


def score_requests(requests: DataFrame, scorer: Scorer, strict: bool, attempt: int = 1, parallel: int | None = None) -> DataFrame:
    """Replies (REPLY). ``parallel`` is how many tasks ask at once: a number that is asked for is neither coalesced nor split at run time.

    A scorer gets batches of up to ``spark.sql.execution.arrow.maxRecordsPerBatch`` requests. One that sends them one after the other
    never has more than ``parallel`` in flight in the whole job; one that sends a batch at once multiplies that by its size.
    """
    rows = requests.select("id", "request", F.lit(strict).alias("strict"), F.lit(attempt).alias("attempt"))
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(scorer, REPLY)


def score_once(asked: DataFrame, scorer: Scorer, attempt: int, land: Callable[[DataFrame], DataFrame], parallel: int | None = None) -> DataFrame:
    """id, fields, overall, error, status, asked (1 or 2) of each request: an unreadable reply gets one stricter request.

    A reply that stays unreadable has an error, its own one if it was cut off. ``land`` writes replies before they are
    read, so that a retried task never asks the scorer again.
    """
    first = extract_json(land(score_requests(asked, scorer, False, attempt, parallel)))
    first = land(first)
    unread = first.where("error IS NULL AND answer IS NULL").select("id")
    again = land(extract_json(land(score_requests(asked.join(unread, "id", "left_semi"), scorer, True, attempt, parallel))))
    every = first.join(unread, "id", "left_anti").withColumn("asked", F.lit(1)).unionByName(again.withColumn("asked", F.lit(2)))
    read = parse_scores(every.where("answer IS NOT NULL").select("id", "answer")).select("id", "fields", "overall")
    failed = F.when(F.col("overall").isNull(), F.when(F.col("finish_reason") == "length", CUT_OFF).otherwise(UNREADABLE))
    return every.join(read, "id", "left").select("id", "fields", "overall", F.coalesce("error", failed).alias("error"), "status", "asked")


def score_corpus(requests: DataFrame, scorer: Scorer, land: Callable[[DataFrame], DataFrame] = lambda x: x, parallel: int | None = None) -> DataFrame:
    """id, fields, overall, error, asked, recovered of each request: after the run, failures that may not recur are tried once more.

    A second failure stays a failure; ``recovered`` marks scores that only the second pass brought. At most ``parallel`` tasks ask at once:
    what is landed is asked for before the next requests are made.
    """
    asked = land(requests.where("request IS NOT NULL").select("id", "request"))
    first = land(score_once(asked, scorer, 1, land, parallel))
    transient = F.col("error").isNotNull() & worth_retrying(F.col("status"), F.col("error"))
    retry = first.where(transient).select("id")
    second = land(score_once(asked.join(retry, "id", "left_semi"), scorer, 2, land, parallel))
    rows = first.join(retry, "id", "left_anti").withColumn("recovered", F.lit(False))
    return rows.unionByName(second.withColumn("recovered", F.col("error").isNull())).drop("status")


def prompt_trial(sample: DataFrame, trial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each card's change, one row of the mean change and its count): scores under a draft prompt less the current ones.

    ``sample``: id, score; ``trial``: id, overall. Cards without either score tell nothing.
    """
    rows = sample.where("score IS NOT NULL").join(trial.where("overall IS NOT NULL"), "id")
    each = rows.select("id", "score", F.col("overall").alias("draft"), T.half_up(F.col("overall") - F.col("score")).alias("change"))
    return each, each.agg(F.count("*").alias("cards"), T.half_up(F.avg("change")).alias("mean_change"))


def register(query) -> None:
    from tallyloom.plans.registry import request_sql
    from tallyloom.plans.stand_in import rubric_scorer
    from tallyloom.sources.store import written

    from .cards import build_requests

    d, m = "1 + (n * 7 + 1) % 10", "1 + (n * 7 + 2) % 10"
    overall = f"floor((0.0::DOUBLE + ({d}) * 0.3::DOUBLE + ({m}) * 0.25::DOUBLE) / (0.0::DOUBLE + 0.3::DOUBLE + 0.25::DOUBLE) * 10 + 0.5) / 10.0"
    scored = f"""SELECT id, CASE WHEN n % 13 <> 0 THEN {overall} END AS overall, CASE WHEN n % 13 = 0 THEN '{CUT_OFF}' END AS error, CASE WHEN n % 13 = 0 OR n % 5 = 0 THEN 2 ELSE 1 END AS asked, n % 7 = 0 AND n % 13 <> 0 AS recovered
        FROM (SELECT id, length(request) AS n FROM ({{}}) WHERE request IS NOT NULL)"""
    query("score_corpus", scored.format(request_sql("full")), "cards")(lambda s, p: score_corpus(build_requests(B.cards(s, p)), rubric_scorer, written, parallel=4).drop("fields"))

    def trial(s, p):
        fast = score_corpus(build_requests(B.cards(s, p), "fast"), rubric_scorer, written)
        return prompt_trial(B.ledger(s, p).select("id", "score"), fast)

    trial_sql = f"+ t AS ({scored.format(request_sql('fast'))}), each AS (SELECT l.id, l.score, t.overall AS draft, floor((t.overall - l.score) * 10 + 0.5) / 10.0 AS change FROM ledger l JOIN t ON t.id = l.id WHERE l.score IS NOT NULL AND t.overall IS NOT NULL) "
    query("prompt_trial", trial_sql + "SELECT * FROM each", "cards", "ledger")(lambda s, p: trial(s, p)[0])
    query("prompt_trial_mean", trial_sql + "SELECT count(*) AS cards, floor(avg(change) * 10 + 0.5) / 10.0 AS mean_change FROM each", "cards", "ledger")(lambda s, p: trial(s, p)[1])
    query("prompt_fingerprint", "SELECT DISTINCT source, substr(sha1(CASE WHEN length(source) = 4 THEN 'default' ELSE source END || chr(10) || chr(10) || 'json'), 1, 10) AS prompt FROM documents")(
        lambda s, p: B.table(s, p, "documents").select("source").distinct().select("source", prompt_hash(F.when(F.length("source") == 4, " ").otherwise(F.col("source")), "default", "json").alias("prompt"))
    )
