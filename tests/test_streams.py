"""Commits, ledgers in buckets, snapshots and streams: two writers, stops and restarts, files in any order."""

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ledger as L
from tallyloom.operators import scoring, telemetry
from tallyloom.plans import bindings as B
from tallyloom.plans.stand_in import rubric_scorer
from tallyloom.sources import buckets, commits
from tallyloom.sources import files as S
from tallyloom.sources import snapshots as V
from tallyloom.sources.store import written
from tallyloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_published_generations(spark, tmp_path):
    root = str(tmp_path)
    assert S.version(spark, root) == 0 and S.manifest(spark, root) is None
    for n in (1, 2):
        S.publish(spark.range(n), root)
    spark.range(9).write.parquet(f"{root}/gen=half-written")
    assert S.published(spark, root).count() == 2 and S.version(spark, root) == 2
    assert [r.number for r in S.manifest(spark, root).orderBy("number").collect()] == [1, 2]


def test_of_two_writers_one_commits(spark, tmp_path):
    """Both start from one version: one is in, the other is told so; a thousand tries at one number give one winner."""
    root = str(tmp_path)
    S.publish(spark.range(1), root)
    base = S.version(spark, root)
    S.publish(spark.range(2), root, base=base)
    with pytest.raises(commits.Conflict):
        S.publish(spark.range(3), root, base=base)
    assert S.published(spark, root).count() == 2
    won, lost = [], []

    def write(n):
        try:
            won.append(S.publish(spark.range(10 + n), root, base=2))
        except commits.Conflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3 and commits.newest(spark, root)["path"] == won[0] and S.version(spark, root) == 3


ENTRY = "id string, hash string, score double"


def replace(entries, changes):
    return entries.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(3000).selectExpr("concat('card-', id) AS id", "'h' AS hash", "CAST(id % 10 AS DOUBLE) AS score")
    buckets.merge(rows, root, ENTRY, replace, "all", buckets=32)
    size = lambda path: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    whole = size(tmp_path / "data")
    done = buckets.merge(rows.where("id IN ('card-7', 'card-8')").withColumn("score", F.lit(99.0)), root, ENTRY, replace, "two")
    assert len(done["rewritten"]) <= 2 and done["of"] == 32 and size(tmp_path / "data") - whole < whole / 8
    now = buckets.read(spark, root, ENTRY)
    assert now.count() == 3000 and {r.id for r in now.where("score = 99").collect()} == {"card-7", "card-8"}
    assert buckets.read(spark, root, ENTRY, number=1).where("score = 99").count() == 0
    assert buckets.read_for(rows.where("id = 'card-7'"), root, ENTRY).count() < 300
    assert buckets.merge(rows.limit(0), root, ENTRY, replace, "none") is None
    emptied = buckets.merge(rows.where("id = 'card-7'"), root, ENTRY, lambda entries, _: entries.where("false"), "gone")
    assert emptied["buckets"][str(emptied["rewritten"][0])] is None and 2700 < buckets.read(spark, root, ENTRY).count() < 3000


@pytest.fixture
def few(spark, tmp_path):
    docs = B.table(spark, SF, "documents").where("doc_id < 9").repartition(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def entries(spark, root):
    return {r.id: (r.hash, r.score, r.error) for r in buckets.read(spark, root, jobs.LEDGER).collect()}


def test_stream_scoring_asks_once_and_follows_changes(spark, few):
    """A second run asks for nothing; a changed card is asked about again; results are those of the batch."""
    root, docs = f"{few}/ledger", spark.read.parquet(f"{few}/documents.parquet")
    run = lambda: jobs.score_stream(jobs.table_stream(spark, few, "documents"), root, f"{few}/state", rubric_scorer, buckets=4)
    run()
    first, made = entries(spark, root), commits.numbers(spark, root)
    run()
    assert commits.numbers(spark, root) == made and len(first) == docs.count()
    docs.where("doc_id = 3").withColumn("text", F.lit("another text entirely")).write.mode("append").parquet(f"{few}/documents.parquet")
    run()
    then = entries(spark, root)
    assert {i for i in then if then[i] != first[i]} == {"doc-00000003.json"}


@pytest.mark.parametrize("stop", ["landed", "data", "committed"])
def test_a_stop_after_each_write_costs_nothing(spark, few, monkeypatch, stop):
    """Stopped after replies are landed, after buckets are written or after the commit, a run that goes on ends like one that wasn't stopped."""

    def counting(folder):
        os.mkdir(folder)

        def scorer(batches):
            for b in rubric_scorer(batches):
                for i in b["id"]:
                    open(f"{folder}/{i}-{time.time_ns()}", "w").close()
                yield b

        return scorer

    run = lambda name, scorer: jobs.score_stream(jobs.table_stream(spark, few, "documents", 1), f"{few}/{name}", f"{few}/state-{name}", scorer, buckets=4)
    asked = lambda name: sorted(n.rsplit("-", 1)[0] for n in os.listdir(f"{few}/asked-{name}"))
    run("whole", counting(f"{few}/asked-whole"))
    real = buckets.merge

    def merge(*a, **b):
        real(*a, **b)
        raise RuntimeError("stopped")

    def fail(*a, **b):
        raise RuntimeError("stopped")

    monkeypatch.setattr(*{"landed": (buckets, "merge", fail), "data": (commits, "commit", fail), "committed": (buckets, "merge", merge)}[stop])
    scorer = counting(f"{few}/asked-stopped")
    with pytest.raises(Exception, match="stopped"):
        run("stopped", scorer)
    monkeypatch.undo()
    assert 0 < len(asked("stopped")) < len(asked("whole"))
    run("stopped", scorer)
    assert entries(spark, f"{few}/stopped") == entries(spark, f"{few}/whole") and asked("stopped") == asked("whole")


def test_six_hundred_results_leave_two_checkpoints(spark, tmp_path):
    at = tmp_path / "documents.parquet"
    at.mkdir()
    for n in range(6):
        made = spark.range(n * 100, n * 100 + 100).selectExpr("id AS doc_id", "concat('text of ', id) AS text", "'s' AS source").coalesce(1)
        made.write.parquet(str(tmp_path / f"made-{n}"))
        next((tmp_path / f"made-{n}").glob("*.parquet")).rename(at / f"part-{n}.parquet")
        os.utime(at / f"part-{n}.parquet", (time.time() + n, time.time() + n))
    root = str(tmp_path / "ledger")
    jobs.score_stream(jobs.table_stream(spark, str(tmp_path), "documents", 1), root, str(tmp_path / "state"), rubric_scorer, buckets=2)
    taken = {r.snapshot: V.read(spark, root, r.snapshot).count() for r in V.listed(spark, root).collect()}
    assert taken == {"cache-stream--00000003--scan-checkpoint": 300, "cache-stream--00000005--scan-checkpoint": 500}
    assert [V.checkpoint_due(b, 100) for b in range(0, 600, 100)] == [False, False, True, False, True, False]


def test_retention_and_hooks(spark, tmp_path):
    """A snapshot before each import, merge and rescore; the newest twelve stay, and copies beyond them are deleted."""
    root = str(tmp_path)
    S.publish(spark.range(5), root)
    for n in range(14):
        V.guarded(root, "lib", f"{n:03}", ("import", "merge", "rescore")[n % 3], lambda x: x.union(x.sparkSession.range(1)), spark)
    names = sorted(r.snapshot for r in V.listed(spark, root).collect())
    assert names == [f"cache-lib--{n:03}--before-{('import', 'merge', 'rescore')[n % 3]}" for n in range(2, 14)]
    assert sorted(os.listdir(f"{root}/snapshots")) == names and V.read(spark, root, names[0]).count() == 7
    assert V.restore(spark, root, names[1], "lib", "100").count() == 8 and S.published(spark, root).count() == 8

    def raced(ledger):
        S.publish(ledger, root)
        return ledger

    with pytest.raises(commits.Conflict):
        V.guarded(root, "lib", "101", "merge", raced, spark)


def test_failures_keep_the_rest_of_an_entry(spark):
    columns = "id string, hash string, score double, error string, brief boolean, prompt_hash string, fast_score double, name string, improved_from string, scored_at timestamp"
    old = spark.sql("SELECT TIMESTAMP'2024-01-01' AS t").first().t
    ledger = spark.createDataFrame([("a", "h", 7.0, None, False, "p", 6.0, "A", "z", old), ("b", "h", 5.0, None, True, "p", None, "B", None, old), ("c", "h", 4.0, None, True, "p", None, "C", None, old)], columns)
    bad = spark.createDataFrame([("a", "h", 500, "HTTP 500"), ("b", "other", 500, "HTTP 500"), ("c", None, 500, "unread"), ("d", "h", 500, "new"), ("e", "h", 401, "HTTP 401")], "id string, hash string, status int, message string")
    at = F.lit("2024-05-05 00:00:00").cast("timestamp")
    got = {r.id: r for r in L.upsert_failure(ledger, bad, at).collect()}
    assert set(got) == set("abcd") and got["a"].asDict() | {"last_error_at": 0} == ledger.where("id = 'a'").first().asDict() | {"last_error": "HTTP 500", "last_error_at": 0}
    assert (got["b"].score, got["b"].brief, got["b"].prompt_hash, got["b"].error, got["b"].name, got["b"].hash, got["b"].scored_at > old) == (None, None, None, "HTTP 500", "B", "other", True)
    assert (got["c"].score, got["c"].last_error, got["d"].error, got["d"].last_error) == (4.0, "unread", "new", None)
    again = L.upsert_failure(L.upsert_failure(ledger, bad, at), bad.limit(0))
    assert {r.id: r.last_error for r in again.collect()} == {i: r.last_error for i, r in got.items()}


@pytest.mark.parametrize("parallel", [1, 2])
def test_no_more_requests_than_allowed(spark, tmp_path, parallel):
    """A scorer that asks one thing after the other is never in more than ``parallel`` requests at once, in the whole job."""
    here, seen = str(tmp_path / "in"), str(tmp_path / "seen")
    os.mkdir(here)
    os.mkdir(seen)

    def asking(batches):
        for b in batches:
            for i in b["id"]:
                name = f"{here}/{i}-{os.getpid()}"
                open(name, "w").close()
                open(f"{seen}/{len(os.listdir(here))}", "w").close()
                time.sleep(0.01)
                os.unlink(name)
            yield from rubric_scorer(iter([b]))

    requests = spark.range(60).selectExpr("concat('c', id) AS id", "repeat('x', CAST(id AS INT) + 1) AS request").repartition(8)
    scores = scoring.score_corpus(requests, asking, written, parallel)
    assert scores.count() == 60 and max(map(int, os.listdir(seen))) == parallel


@pytest.mark.parametrize("order", ["time", "shuffled", "all"])
def test_live_outages_equal_the_batch(spark, tmp_path, order):
    """However the log is cut into files and whatever order they come in, within the watermark: every run is told, open ones too."""
    events = B.table(spark, SF, "events").orderBy("ts").toPandas()
    events["event_type"] = ["error" if i % 9 < 6 else t for i, t in enumerate(events["event_type"])]
    events["props"] = ['{"k": 1}' if i % 9 < 6 else p for i, p in enumerate(events["props"])]
    (tmp_path / "events.parquet").mkdir()
    cuts, files = list(range(6)), 6
    size = -(-len(events) // files)
    if order == "shuffled":
        random.Random(3).shuffle(cuts)
    for n, cut in enumerate(cuts):
        path = tmp_path / "events.parquet" / f"part-{n}.parquet"
        spark.createDataFrame(events[cut * size : (cut + 1) * size]).coalesce(1).write.parquet(str(tmp_path / f"made-{n}"))
        next((tmp_path / f"made-{n}").glob("*.parquet")).rename(path)
        os.utime(path, (time.time() + n, time.time() + n))
    late = "400 days" if order == "shuffled" else "1 hour"
    live = {tuple(r)[:4] for r in jobs.live_outages(spark, str(tmp_path), files=None if order == "all" else 1, late=late).collect()}
    assert live == {tuple(r) for r in telemetry.outages(B.request_log(spark, str(tmp_path))).collect()} and live


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    shape = "provider string, ts timestamp, log_id long, status int, error string"
    at = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    files = [[("p", at(0), 1, 503, "HTTP 503"), ("p", at(1), 2, 503, "HTTP 503"), ("p", at(300), 3, 200, None)], [("p", at(2), 4, 200, None), ("p", at(301), 5, 503, "HTTP 503"), ("q", at(302), 6, 503, "HTTP 503")], [("p", at(302), 7, 503, "HTTP 503"), ("p", at(900), None, None, None)]]
    folder = tmp_path / "log"
    folder.mkdir()
    for n, rows in enumerate(files):
        df = spark.createDataFrame([json.dumps(dict(zip(("provider", "ts", "log_id", "status", "error"), r, strict=True))) for r in rows], "string").select(F.from_json("value", shape).alias("r")).select("r.*")
        df.coalesce(1).write.parquet(str(tmp_path / f"made-{n}"))
        next((tmp_path / f"made-{n}").glob("*.parquet")).rename(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (time.time() + n, time.time() + n))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(folder))
    spark.conf.set(*jobs.STATE_STORE)
    told = jobs.latest_outages(jobs.drained(jobs.outage_stream(stream, "1 hour")))
    spark.conf.unset(jobs.STATE_STORE[0])
    assert {(r.provider, r.failures, r.open) for r in told.collect()} == {("p", 2, False), ("p", 2, True)}
