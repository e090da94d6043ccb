"""Structured Streaming forms of a scoring run: counters, repeated deliveries, outages, incremental scoring."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.functions.failures import failure_scope
from tallyloom.operators import cards as C
from tallyloom.operators import ledger as L
from tallyloom.operators import scoring
from tallyloom.plans import bindings as B
from tallyloom.sources import buckets as Buckets
from tallyloom.sources import snapshots as V
from tallyloom.sources.store import fresh_path

LEDGER = "id string, hash string, score double, error string, brief boolean, prompt_hash string, fast_score double, fast_stale boolean, last_error string, last_error_at timestamp"


def folder(spark: SparkSession) -> str:
    """A fresh place in the shared checkpoint folder."""
    return fresh_path(spark, "stream")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream makes of what is there now, as a table."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def table_stream(s: SparkSession, d: str, name: str, files: int | None = None) -> DataFrame:
    """A table as a stream of its files, ``files`` a micro-batch; the pattern also names a table that is a single file."""
    reader = s.readStream.schema(B.table(s, d, name).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{d}/{name}.parque[t]")


def event_stream(s: SparkSession, d: str) -> DataFrame:
    return B.request_log_of(table_stream(s, d, "events"))


def counts_over(log: DataFrame, length: str, step: str, late: str) -> DataFrame:
    """start, done, errors, mean_ms of the attempts in windows of ``length`` that begin every ``step``.

    A window is told once, when no attempt in it can come any more: ``late`` after its end.
    """
    seen = log.withWatermark("ts", late)
    counts = seen.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("done"), F.count("error").alias("errors"), F.avg("took_ms").alias("mean_ms"))
    return counts.select(F.col("w.start").alias("start"), "done", "errors", "mean_ms")


def run_counters(s: SparkSession, d: str) -> DataFrame:
    """Attempts, errors and mean latency of each hour."""
    return drained(counts_over(event_stream(s, d), "1 hour", "1 hour", "1 hour"))


def run_rates(s: SparkSession, d: str) -> DataFrame:
    """The same over the last two hours, every hour: the sliding rate."""
    return drained(counts_over(event_stream(s, d), "2 hours", "1 hour", "1 hour")).select("start", "done")


def deduplicated(deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Deliveries (id, hash, at) of cards, each text of a card once; what was delivered is remembered for ``late``."""
    return deliveries.withWatermark("at", late).dropDuplicatesWithinWatermark(["id", "hash"])


def card_deliveries(s: SparkSession, d: str) -> DataFrame:
    """Every document delivered twice, half a minute apart."""
    docs = B.cards_of(table_stream(s, d, "documents"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    one = docs.select("id", B.card_hash().alias("hash"), at.alias("at"))
    return one.unionAll(one.withColumn("at", F.col("at") + F.expr("INTERVAL 30 SECONDS")))


def landing(spark: SparkSession, at: str):
    """Writes tables under ``at``, numbered in the order in which they are asked for. One that is whole already is read, not made again."""
    count = itertools.count()

    def land(df: DataFrame) -> DataFrame:
        path = f"{at}/{next(count):03}"
        if not V.exists(spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return land


def put_scores(entries: DataFrame, scores: DataFrame) -> DataFrame:
    """Ledger entries with the scores (id, hash, overall, error) of their cards in them; a failure leaves what it may not touch."""
    done = scores.where("error IS NULL").select("id", "hash", F.col("overall").alias("score"), F.lit(False).alias("brief"))
    failed = scores.where("error IS NOT NULL").select("id", "hash", F.lit(None).cast("int").alias("status"), F.col("error").alias("message"))
    return L.upsert_failure(L.upsert_success(entries, done), failed)


def score_stream(stream: DataFrame, root: str, checkpoint: str, scorer: scoring.Scorer, parallel: int | None = None, library: str = "stream", every: int = V.EVERY, keep: int = V.KEEP, buckets: int = Buckets.BUCKETS) -> None:
    """New and changed cards of a stream of documents are scored and put into the ledger in buckets at ``root``.

    A micro-batch selects its work by fingerprints against the entries of its own buckets; the texts of this work alone are made into requests. It
    lands replies before it reads them, rewrites the buckets that its results touch and commits under its name. A batch that is run again reads what it has landed, or finds its commit and does nothing, so
    that stopping and resuming loses nothing and asks for nothing twice. Each time that ``every`` more results are in, the ledger as
    committed is marked as a snapshot; the newest ``keep`` stay.
    """
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:10]

    def upsert(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{run}-batch-{number}"
        done = Buckets.find(spark, root, name)
        if done is None:
            land = landing(spark, f"{root}/landing/{name}")
            cards = B.cards_of(batch)
            keys = land(cards.select("id", B.card_hash().alias("hash"), B.token_total().alias("tokens")))
            work = land(C.work_set(keys, Buckets.read_for(keys, root, LEDGER)))
            asked = C.build_requests(cards.join(work.select("id"), "id", "left_semi"))
            scores = land(scoring.score_corpus(asked, scorer, land, parallel).join(work.select("id", "hash"), "id").select("id", "hash", "overall", "error"))
            before, results = Buckets.noted(spark, root, "results", 0), scores.count()
            due = V.checkpoint_due(before, results, every)
            done = Buckets.merge(scores, root, LEDGER, put_scores, name, buckets, results=before + results, due=due)
        if done is not None and done["due"]:
            V.mark(spark, root, library, f"{done['number']:08}", "scan-checkpoint", done["number"])
            V.retain(spark, root, keep)

    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scored_stream(s: SparkSession, d: str) -> DataFrame:
    """The ledger after a run over all documents, and after one more, which finds nothing to do."""
    from tallyloom.plans.stand_in import rubric_scorer

    at = folder(s)
    for run in ("first", "again"):
        score_stream(table_stream(s, d, "documents", files=8), f"{at}/ledger", f"{at}/{run}", rubric_scorer)
    return Buckets.read(s, f"{at}/ledger", LEDGER).select("id", "hash", "score", "error")


#: The log_id of a row that only tells the time.
TICK = -1


#: Microseconds of a log that one key of the state holds.
SLICE = 6 * 3_600_000_000
#: An outcome as it waits in the state.
OUTCOME = np.dtype([("us", "<i8"), ("log_id", "<i8"), ("down", "?")])


class SliceWatch(StatefulProcessor):
    """One slice of a provider's time: outcomes that the watermark hasn't passed, packed.

    A timer at the earliest waiting outcome goes off once the watermark is past it. Then all outcomes that are due are taken in the order of their
    own time, however they came in, and are told as runs of failures: RUN rows. A run inside of them is whole and told only if it is long
    enough; the first and the last one may go on in other slices.
    """

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")

    def wake_at(self, times: list[int]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(min(times))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # What the watermark has passed is settled: a row that comes later than that is left out, and so is a tick.
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        for b in rows:
            came = b[(b["log_id"] != TICK) & (b["us"] > settled)]
            if len(came):
                packed = np.empty(len(came), OUTCOME)
                for c in OUTCOME.names:
                    packed[c] = came[c]
                self.waiting.appendValue((packed.tobytes(),))
                self.wake_at([*self.handle.listTimers(), int(packed["us"].min()) // 1000])
        yield pd.DataFrame(columns=RUN_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        every = np.concatenate([np.frombuffer(r[0], OUTCOME) for r in self.waiting.get()])
        due, later = every[every["us"] <= now], every[every["us"] > now]
        self.waiting.clear()
        if len(later):
            self.waiting.put([(later.tobytes(),)])
        self.wake_at([int(later["us"].min()) // 1000] if len(later) else [])
        told = runs_of(due[np.lexsort((due["log_id"], due["us"]))], self.least)
        told.insert(0, "provider", key[0])
        told.insert(1, "slice", np.int64(key[1]))
        yield told[RUN_COLUMNS]

    def close(self) -> None:
        pass


def runs_of(due: np.ndarray, least: int) -> pd.DataFrame:
    """The runs of failures among outcomes in order: nth, from_us, to_us, failures, whether another outcome stands before and after; ts is when a run was settled.

    The first run is told even without a failure, as another outcome after it ends what earlier slices have begun.
    """
    ups = np.flatnonzero(~due["down"])
    begin, end = np.concatenate(([0], ups + 1)), np.concatenate((ups, [len(due)]))
    n, nth = end - begin, np.arange(len(begin))
    kept = (n >= least) | (nth == 0) | ((nth == len(ups)) & (n > 0))
    if not len(due):
        kept[:] = False
    begin, end, n, nth = begin[kept], end[kept], n[kept], nth[kept]
    us, last = due["us"], len(due) - 1
    return pd.DataFrame({
        "nth": nth, "from_us": us[np.minimum(begin, last)], "to_us": us[np.maximum(end - 1, 0)], "failures": n, "before": nth > 0, "after": nth < len(ups),
        "ts": pd.to_datetime(us[np.minimum(end, last)], unit="us", utc=True),
    })


class OutageWatch(StatefulProcessor):
    """One provider's state: the run of failures that it is in. Runs of slices (RUN) that the watermark has passed come in and are put together.

    The state of each run that changed is told: open while it lasts, closed by another outcome.
    """

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "from_us long, to_us long, failures long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows)).sort_values(["slice", "nth"])
        run, more = (tuple(self.run.get()) if self.run.exists() else None), False
        told = []
        for begin, end, n, before, after in zip(*[came[c].tolist() for c in ("from_us", "to_us", "failures", "before", "after")], strict=True):
            run = None if before else run
            if n:
                run, more = (run[0] if run else begin, end, (run[2] if run else 0) + n), True
            if after:
                if run and run[2] >= self.least:
                    told.append((key[0], *run, False))
                run, more = None, False
        if run:
            self.run.update(run)
            if more and run[2] >= self.least:
                told.append((key[0], *run, True))
        else:
            self.run.clear()
        yield pd.DataFrame(told, columns=["provider", "from_us", "to_us", "failures", "open"]).astype({"from_us": "int64", "to_us": "int64", "failures": "int64", "open": "bool"})

    def close(self) -> None:
        pass


RUN = "provider string, slice long, nth long, from_us long, to_us long, failures long, before boolean, after boolean, ts timestamp"
RUN_COLUMNS = [c.split()[0] for c in RUN.split(", ")]
OUTAGE = "provider string, started timestamp, ended timestamp, failures long, open boolean"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def outage_stream(log: DataFrame, late: str = "1 hour", least: int = 2) -> DataFrame:
    """What becomes known of each provider's runs of at least ``least`` consecutive connectivity failures: OUTAGE rows, the last one of a run counts.

    Outcomes wait for the watermark in slices of a provider's time, each a key of its own; a provider's key gets a slice's runs only.

    Outcomes may come in any order within ``late``; what comes later than that is left out. ``log`` may hold rows without a status and an
    error whose log_id is null: they only tell the time.
    """
    down = F.coalesce(failure_scope(F.col("status"), F.col("error")) == "connectivity", F.lit(False))
    us = F.unix_micros("ts")
    rows = log.withWatermark("ts", late).select("provider", F.floor(us / SLICE).alias("slice"), "ts", us.alias("us"), F.coalesce("log_id", F.lit(TICK)).cast("long").alias("log_id"), down.alias("down"))
    runs = rows.groupBy("provider", "slice").transformWithStateInPandas(statefulProcessor=SliceWatch(least), outputStructType=RUN, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")
    shape = "provider string, from_us long, to_us long, failures long, open boolean"
    told = runs.groupBy("provider").transformWithStateInPandas(statefulProcessor=OutageWatch(least), outputStructType=shape, outputMode="Append", timeMode="EventTime")
    return told.select("provider", F.timestamp_micros("from_us").alias("started"), F.timestamp_micros("to_us").alias("ended"), "failures", "open")


def latest_outages(told: DataFrame) -> DataFrame:
    """One row a run: the last that was told of it. A run only grows until it is closed."""
    last = F.max(F.struct(F.col("failures"), (~F.col("open")).alias("closed"), F.col("ended"))).alias("l")
    return told.groupBy("provider", "started").agg(last).select("provider", "started", F.col("l.ended").alias("ended"), F.col("l.failures").alias("failures"), (~F.col("l.closed")).alias("open"))


def live_outages(s: SparkSession, d: str, least: int = 2, files: int | None = 1, late: str = "1 hour") -> DataFrame:
    """Runs of consecutive connectivity failures of a provider, the ones that are still open included (``open``).

    The log is a stream of files beside a stream of ticks, rows that tell how late it is. When the log has been read, the stream is stopped; a
    tick after the end comes in, and the stream goes on from its checkpoint, so that the last outcomes are due as well.
    """
    at = folder(s)
    shape = "provider string, ts timestamp, log_id long, status int, error string"
    columns = [c.split()[0] for c in shape.split(", ")]
    log = B.request_log_of(table_stream(s, d, "events", files)).selectExpr("provider", "ts", "CAST(log_id AS LONG) AS log_id", "CAST(status AS INT) AS status", "error")
    s.createDataFrame([], shape).write.mode("append").parquet(f"{at}/ticks")
    was = s.conf.get(STATE_STORE[0], None)
    s.conf.set(*STATE_STORE)
    try:
        for tick in (False, True):
            if tick:
                last = B.request_log(s, d).groupBy("provider").agg(F.max("ts").alias("ts"))
                end = last.agg(F.max("ts").alias("end"))
                ticks = last.join(end).select("provider", (F.col("end") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 SECOND")).alias("ts"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in shape.split(", ")[2:]])
                ticks.select(*columns).coalesce(1).write.mode("append").parquet(f"{at}/ticks")
            stream = log.unionByName(s.readStream.schema(shape).parquet(f"{at}/ticks"))
            writer = outage_stream(stream, late, least).writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
            writer.format("parquet").option("path", f"{at}/told").start().awaitTermination()
    finally:
        s.conf.set(STATE_STORE[0], was) if was else s.conf.unset(STATE_STORE[0])
    return latest_outages(s.read.schema(OUTAGE).parquet(f"{at}/told"))


def register(query) -> None:
    from tallyloom.plans.registry import HASH, SCOPED, request_sql

    hours = "SELECT date_trunc('hour', ts) AS start, count(*) AS done, count(error) AS errors, avg(took_ms) AS mean_ms FROM log GROUP BY 1"
    last = "(SELECT max(ts) - INTERVAL 1 HOUR FROM log)"
    query("stream_run_counters", f"+ h AS ({hours}) SELECT * FROM h WHERE start + INTERVAL 1 HOUR <= {last}", "log")(run_counters)
    query("stream_run_rates", f"+ h AS ({hours}), w AS (SELECT start, done FROM h UNION ALL SELECT start - INTERVAL 1 HOUR, done FROM h) SELECT start, CAST(sum(done) AS BIGINT) AS done FROM w WHERE start + INTERVAL 2 HOURS <= {last} GROUP BY 1", "log")(run_rates)
    query("stream_dedup", f"SELECT DISTINCT id, {HASH} AS hash FROM cards", "cards")(lambda s, d: drained(deduplicated(card_deliveries(s, d))).select("id", "hash"))
    query(
        "stream_outages",
        SCOPED + """SELECT provider, min(ts) AS started, max(ts) AS ended, count(*) AS failures, max(ts) > coalesce(max(up), TIMESTAMP '1970-01-01') AS "open"
        FROM (SELECT *, sum(CASE WHEN scope = 'connectivity' THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY ts, log_id) AS island, max(CASE WHEN scope = 'connectivity' THEN NULL ELSE ts END) OVER (PARTITION BY provider) AS up FROM scoped)
        WHERE scope = 'connectivity' GROUP BY provider, island HAVING count(*) >= 2""", "log",
    )(live_outages)
    d, m = "1 + (n * 7 + 1) % 10", "1 + (n * 7 + 2) % 10"
    overall = f"floor((0.0::DOUBLE + ({d}) * 0.3::DOUBLE + ({m}) * 0.25::DOUBLE) / (0.0::DOUBLE + 0.3::DOUBLE + 0.25::DOUBLE) * 10 + 0.5) / 10.0"
    query("stream_scoring", f"""SELECT c.id, c.hash, CASE WHEN n % 13 <> 0 THEN {overall} END AS score, CASE WHEN n % 13 = 0 THEN '{scoring.CUT_OFF}' END AS error
        FROM (SELECT id, {HASH} AS hash FROM cards) c JOIN (SELECT id, length(request) AS n FROM ({request_sql('full')}) WHERE request IS NOT NULL) r ON r.id = c.id""", "cards")(scored_stream)  # fmt: skip
