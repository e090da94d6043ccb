"""Request-log telemetry: outages, routes, rates, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.failures import failure_scope, worth_retrying
from tallyloom.functions.text import half_up


def scoped(log: DataFrame) -> DataFrame:
    return log.withColumn("scope", failure_scope(F.col("status"), F.col("error")))


def hour(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 3_600_000_000)


def connectivity_runs(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, last): every run of consecutive connectivity failures of a provider, and each provider's last other outcome.

    A run (provider, island, started, ended, failures) is named by the last other outcome before it, null if there is none.
    That is a running maximum, taken within an hour's rows and, over the hours before, in a table of one row an hour: no
    task holds all rows of a provider. A run whose island is the provider's last other outcome (``last``: provider, last_up) is open.
    """
    at = F.struct("ts", "log_id")
    rows = scoped(log).withColumns({"down": F.coalesce(F.col("scope") == "connectivity", F.lit(False)), "hour": hour(F.col("ts"))})
    up = F.when(~F.col("down"), at)
    hours = rows.groupBy("provider", "hour").agg(F.max(up).alias("last_up"))
    before = Window.partitionBy("provider").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    earlier = hours.select("provider", "hour", F.max("last_up").over(before).alias("earlier"))
    within = Window.partitionBy("provider", "hour").orderBy("ts", "log_id")
    named = rows.withColumn("own", F.max(up).over(within)).where("down").join(earlier, ["provider", "hour"])
    runs = named.groupBy("provider", F.coalesce("own", "earlier").alias("island")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("failures"))
    return runs, hours.groupBy("provider").agg(F.max("last_up").alias("last_up"))


def outages(log: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` consecutive connectivity failures of a provider."""
    runs, _ = connectivity_runs(log)
    return runs.where(F.col("failures") >= least).select("provider", "started", "ended", "failures")


def route_failures(log: DataFrame, allowance: int = 3) -> DataFrame:
    """What becomes of each failure: fatal, requeued (an item's first connectivity failures) or recorded."""
    failed = scoped(log).where("scope IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("item", "scope").orderBy("ts", "log_id"))
    route = F.when(F.col("scope") == "fatal", "fatal").when((F.col("scope") == "connectivity") & (nth <= allowance), "requeued").otherwise("recorded")
    return failed.select("log_id", "item", "scope", route.alias("route"))


def recent_outcomes(log: DataFrame, n: int = 12) -> DataFrame:
    """The latest ``n`` attempts of each provider, newest first."""
    rank = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("ts"), F.desc("log_id")))
    return log.withColumn("rank", rank).where(F.col("rank") <= n).select("provider", F.col("rank").cast("long").alias("rank"), "log_id", "item", F.col("error").isNull().alias("ok"))


def upper_middle(values: Column) -> Column:
    """Element floor(n / 2) of a bounded list."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def run_telemetry(log: DataFrame, planned: DataFrame | None = None, last: int = 200, slow_ms: int = 30_000) -> DataFrame:
    """Per provider: done, errors, rate an hour, median of the last latencies, requests slower than 30 s, time left.

    ``planned``: provider, total, the requests that the run set out to make; without it no time left is told. There is no rate
    in the first three seconds.
    """
    rank = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("ts"), F.desc("log_id")))
    # A filter on a rank is applied before the shuffle too: each task passes on ``last`` rows a provider at most.
    newest = log.withColumn("rank", rank).where(F.col("rank") <= last).groupBy("provider").agg(F.collect_list("took_ms").alias("latest"))
    one = log.groupBy("provider").agg(
        F.count_if(F.col("error").isNull()).alias("done"), F.count("error").alias("errors"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span"), F.count_if(F.col("took_ms") > slow_ms).alias("slow"),
    ).join(newest, "provider")
    one = one.withColumn("total", F.lit(None).cast("long")) if planned is None else one.join(planned.select("provider", "total"), "provider", "left")
    finished = F.col("done") + F.col("errors")
    rate = F.when(F.col("span") >= 3_000_000, finished * 3.6e9 / F.col("span"))
    left = F.floor((F.col("total") - finished) / rate * 3.6e6 + 0.5)
    return one.select("provider", "done", "errors", half_up(rate).alias("per_hour"), upper_middle(F.col("latest")).alias("median_ms"), "slow", left.alias("eta_ms"))


def middle_of(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, middle): the element at floor(n / 2) of each key's sorted values, from how often each value occurs."""
    counts = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(value))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("upto", upto).join(totals, key).where(F.col("upto") > F.floor(F.col("total") / 2))
    return ranked.groupBy(key).agg(F.min(value).alias("middle"))


def diagnose(log: DataFrame, cards: int, concurrency: int) -> DataFrame:
    """Per provider: requests that answered, timed out, were cut off; a verdict; middle and slowest success; the time a whole run would take.

    The verdict looks at time-outs first, then at cut-off answers. The suggested timeout is three times the slowest success, in
    whole tens of seconds. Without a success nothing is projected.
    """
    late = F.coalesce(F.col("error").rlike("(?i)timed out"), F.lit(False))
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    fine = F.col("error").isNull() & ~cut
    one = log.groupBy("provider").agg(
        F.count("*").alias("n"), F.count_if(fine).alias("ok"), F.count_if(late).alias("timed_out"), F.count_if(cut).alias("truncated"), F.max(F.when(fine, F.col("took_ms"))).alias("slowest_ms")
    )
    one = one.join(middle_of(log.where(fine), "provider", "took_ms").withColumnRenamed("middle", "median_ms"), "provider", "left")
    verdict = F.when(F.col("timed_out") > 0, "timed out").when(F.col("truncated") > 0, "cut off").when(F.col("ok") == F.col("n"), "healthy").otherwise("failing")
    projected = F.ceil(F.lit(cards) * F.col("median_ms") / F.lit(concurrency * 1000))
    return one.select("provider", "ok", "timed_out", "truncated", verdict.alias("verdict"), "median_ms", "slowest_ms", (F.ceil(F.col("slowest_ms") * 3 / 10000.0) * 10).alias("timeout_s"), projected.alias("run_s"))


def rate_audit(log: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per provider: most attempts in any span of ``seconds``, and the least spacing in microseconds.

    Rows are windowed in buckets of one span, each with the rows of the bucket before it as context; spacing across
    longer silences comes from a table of one row a bucket.
    """
    micros = seconds * 1_000_000
    rows = log.select("provider", F.unix_micros("ts").alias("us")).withColumn("bucket", F.floor(F.col("us") / micros))
    shown = rows.select("provider", "us", F.explode(F.array(F.struct("bucket", F.lit(True).alias("own")), F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(False).alias("own")))).alias("b")).select("provider", "us", "b.*")
    w = Window.partitionBy("provider", "bucket").orderBy("us")
    counted = shown.select("provider", "own", F.count("*").over(w.rangeBetween(-micros + 1, 0)).alias("n"), (F.col("us") - F.lag("us").over(w)).alias("gap")).where("own")
    edge = rows.groupBy("provider", "bucket").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    silence = (F.col("first") - F.lag("last").over(Window.partitionBy("provider").orderBy("bucket"))).alias("gap")
    every = counted.select("provider", "n", "gap").unionAll(edge.select("provider", F.lit(0).cast("long").alias("n"), silence))
    return every.groupBy("provider").agg(F.max("n").alias("most"), F.min("gap").alias("least_gap"))


def failure_scopes(log: DataFrame) -> DataFrame:
    rows = scoped(log).where("scope IS NOT NULL")
    return rows.groupBy("scope", worth_retrying(F.col("status"), F.col("error")).alias("retry")).agg(F.count("*").alias("n"))


def token_usage(log: DataFrame) -> DataFrame:
    """Per provider: attempts, answers, the tokens sent and received, those sent for nothing (no answer came), and tokens received a second of answers."""
    answered = F.col("tokens_out").isNotNull()
    rows = log.groupBy("provider").agg(
        F.count("*").alias("attempts"), F.count_if(answered).alias("answers"), F.sum("tokens_in").alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.coalesce(F.sum(F.when(~answered, F.col("tokens_in"))), F.lit(0)).alias("wasted"), F.sum(F.when(answered, F.col("took_ms"))).alias("ms"),
    )
    return rows.select("provider", "attempts", "answers", "tokens_in", "tokens_out", "wasted", half_up(F.when(F.col("ms") > 0, F.col("tokens_out") * 1000 / F.col("ms"))).alias("per_second"))
