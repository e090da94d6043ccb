"""Cases of the third round's findings."""

import itertools
import json
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.llm import near_copies, simhash
from tallyloom.operators import alignment, cards, dedupe, edits, ideas, revisions
from tallyloom.plans import bindings as B
from tallyloom.plans import more, registry
from tallyloom.plans.stand_in import rubric_scorer
from tallyloom.sources import payloads
from tallyloom.streaming import jobs


def test_details_across_the_border_of_two_parts(spark):
    """In the card's order, a number that ends a part takes the unit that begins the next one: the bare number is nowhere then."""
    texts = {"description": "Has 12 cats.", "personality": "Room 12", "scenario": "in the hall", "post_history_instructions": "Stay."}
    parts = spark.createDataFrame([("a", f, t, False) for f, t in texts.items()], "id string, field string, text string, empty boolean")
    edit = spark.createDataFrame([("a", 0, "description", "replace", "12", "some", "trim")], "id string, ord int, field string, action string, find string, put string, kind string")
    impact = lambda **k: [(r.lost, r.on) for r in edits.edit_impact(edits.place_edits(edit, parts), edit, parts, **k).collect()]
    assert impact() == [("12", False)]
    # What else the card holds stands behind the description; a part that is not filled parts its neighbours.
    rest = lambda t: spark.createDataFrame([("a", t)], "id string, text string")
    assert impact(rest=rest("still 12")) == [("", True)]
    assert edits.edit_impact(edits.place_edits(edit, parts), edit, parts.where("field <> 'scenario'")).first().lost == ""


def test_ends_that_need_no_table():
    """Ends are matched as the whole table would match them, whatever recurs; long texts with few changes leave nothing to the table."""
    rng = random.Random(4)
    for _ in range(400):
        kinds = rng.choice((2, 4, 12, 60))
        x = [rng.randrange(kinds) for _ in range(rng.randrange(14))]
        y = [v for v in x if rng.random() > 0.15 for v in ([v, 100 + rng.randrange(3)] if rng.random() < 0.2 else [v])]
        y = y if rng.random() < 0.6 else [rng.randrange(kinds + 2) for _ in range(rng.randrange(14))]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        want, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                want.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        assert alignment.common(np.array(x, np.int64), np.array(y, np.int64)) == want
    x = np.arange(50_000)
    y = np.concatenate([x[:20_000], [-1], x[20_001:]])
    assert len(alignment.without_ends(x, y)[1]) == 0


def test_python_takes_up_texts_in_slices(monkeypatch):
    """A batch of many long rows is cut; the rows are the same, and none is dropped for its length."""
    monkeypatch.setattr(revisions, "SLICE", 1000)
    texts = ["a" * n for n in [1, 2, 5000, 3, 4, *[90] * 200, 7000]]
    parts = list(revisions.slices(iter([pa.record_batch({"t": texts})])))
    assert [t for p in parts for t in p["t"].to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 2000 for p in parts)


def test_words_in_common_decide_for_a_single_pair():
    assert revisions.unit_diff(["one two three four five.\n"], ["one b c d e.\n"])[0][0] == "change"
    assert [r[0] for r in revisions.unit_diff(["one two three four five six.\n"], ["one b c d e f.\n"])] == ["remove", "add"]
    assert [r[0] for r in revisions.unit_diff(["...\n"], ["!\n"])] == ["remove", "add"]


def test_near_copies_link_by_fingerprint(spark):
    """A passage that recurs often outweighs the rest: fingerprints agree where few of the distinct shingles do. Both kinds of links join up."""
    common = " ".join(f"w{k}" for k in range(41))
    a, b = (" ".join([*[common] * 60, *[f"{x}{k}" for k in range(30)]]) for x in "ab")
    near = b.replace("b29", "other")
    rows = [(1, a), (2, b), (3, near), (4, "something else altogether, of a few words only")]
    fp = [simhash.fingerprint(t) for _, t in rows]
    assert (fp[0] ^ fp[1]).bit_count() <= 2
    x, y = (set(near_copies.shingles(t).tolist()) for t in (a, b))
    assert len(x & y) < 0.8 * len(x | y)
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_label_passing_sends_no_table_through_the_driver(spark):
    few = spark.createDataFrame([("a", 1)], "key string, n int")
    plan = dedupe.sorted_join(few, few.select("key", F.col("n").alias("m")), "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_patch_computes_each_map_once(spark, tmp_path):
    """What a lambda holds is computed for every entry: a map that another is put into is a column by then. The report reads patched rows once."""
    raw = spark.createDataFrame([("a", '{"data":{"name":"n","extensions":{"x":1,"depth_prompt":{"depth":2,"prompt":"p"}}},"name":"n"}')], "id string, payload string")
    patches = spark.createDataFrame([("a", {"character_note": "note", "description": "new"}, "m")], "id string, fields map<string,string>, name string")
    out = payloads.field_patch(raw, patches)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"map_keys\((?!\w+#\d+\))", plan(out)) == [] and "map_keys(" in plan(out)
    assert json.loads(out.first().payload) == {"data": {"name": "m", "description": "new", "extensions": {"x": 1, "depth_prompt": {"depth": 2, "prompt": "note"}}}, "name": "m"}
    assert plan(more.patch_report(spark, "/root/testdata/sf0.001")).count("Join") == 1


def test_runs_of_slices_make_the_runs_of_the_whole():
    """Cut anywhere, by slices and by what is due, the runs of the pieces are put together to those of the whole log; whole short ones aren't told."""
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 40)
        due = np.array([(t, i, rng.random() < 0.6) for i, t in enumerate(sorted(rng.randrange(60) for _ in range(n)))], jobs.OUTCOME)
        cuts = sorted({0, n, *[rng.randrange(n) for _ in range(rng.randrange(6))]})
        run, told, rows = 0, [], 0
        for a, b in itertools.pairwise(cuts):
            for r in jobs.runs_of(due[a:b], 2).itertuples():
                rows += 1
                run = r.failures + (0 if r.before else run)
                if r.after:
                    told, run = told + [run] * (run >= 2), 0
        told += [run] * (run >= 2)
        whole = [len(list(g)) for down, g in itertools.groupby(due["down"].tolist()) if down]
        assert told == [k for k in whole if k >= 2] and rows <= len(told) + 2 * (len(cuts) - 1)
    assert len(jobs.runs_of(due[:0], 2)) == 0


def test_images_pass_python_in_slices(spark):
    """Images are drawn and read as Arrow batches, which are cut to a size in bytes: no frame holds ten thousand cards."""
    plan = more.png_cards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_a_review_places_edits_once(spark, monkeypatch):
    calls, real = [], edits.placed_sample
    monkeypatch.setattr(edits, "placed_sample", lambda *a: calls.append(a) or real(*a))
    registry.QUERIES["review_summary"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_edit_requests_judge_ideas_once_without_texts(spark, monkeypatch):
    """Ideas are judged once for a request, and no card's text is sorted along with them."""
    calls, real = [], ideas.validate_ideas
    monkeypatch.setattr(ideas, "validate_ideas", lambda *a: calls.append(real(*a)) or calls[-1])
    registry.QUERIES["edit_requests"](spark, "/root/testdata/sf0.001")
    plan = calls[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "Window" in plan and "whole#" not in plan[: plan.index("Window")]
    below = plan[plan.index("Window") :].splitlines()[1]
    assert "whole#" not in below


def test_strip_looks_at_the_ends_alone(spark):
    """It takes off what the pattern took off, for every code point, and no pattern goes through the text."""
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    x = F.concat(c, F.lit(" "), c, F.lit("a"), c, F.lit("b \n "), c, c)
    assert points.where(text.strip(x) != F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).isEmpty()
    assert points.where((text.strip(c) == "") & (c != "")).count() == len(text.SPACES)
    assert spark.range(1).select(text.strip(F.lit(None).cast("string")).alias("s")).first().s is None
    assert "regexp" not in str(spark.sql("SELECT 'a' AS t").select(text.strip(F.col("t")))._jdf.queryExecution().analyzed())


def test_requests_are_made_once_and_of_the_work_alone(spark, tmp_path, monkeypatch):
    """A filter on requests isn't computed from the texts again; a run with nothing to do makes no request and lands no text."""
    asked = cards.build_requests(B.cards(spark, "/root/testdata/sf0.001")).where("request IS NOT NULL")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("### description") == 1 and "regexp" not in plan
    spark.range(9).selectExpr("id AS doc_id", "concat('a text of some length ', id) AS text", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    real = jobs.landing

    def landing(s, at):
        land = real(s, at)
        return lambda df: made.append(land(df)) or made[-1]

    monkeypatch.setattr(jobs, "landing", landing)
    for n in range(2):
        made.clear()
        jobs.score_stream(jobs.table_stream(spark, str(tmp_path), "documents"), f"{tmp_path}/ledger", f"{tmp_path}/state-{n}", rubric_scorer, buckets=2)
        assert made[0].columns == ["id", "hash", "tokens"] and made[0].count() == 9
        failed = jobs.Buckets.read(spark, f"{tmp_path}/ledger", jobs.LEDGER).where("error IS NOT NULL").count()
        assert made[2].columns == ["id", "request"] and made[2].count() == made[1].count() == (failed if n else 9)


def test_groups_read_texts_for_names_once(spark):
    """Names, their keys and what they group are written; a key is made once a row, and a text isn't split beyond its second word."""
    sf = "/root/testdata/sf0.001"
    plan = dedupe.keyed(B.names(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(text.KEY_STEPS[0][0]) == 1 and "+, 3)" in plan
    groups = registry.QUERIES["duplicate_groups"](spark, sf)
    assert groups.count() and not any("documents.parquet" in f for f in groups.inputFiles())


def test_groups_are_joined_up_by_their_names(spark, monkeypatch):
    """Links that a block's smallest forms miss are drawn between groups: the second pass sees groups alone, and ends where all pairs lead."""
    rng = random.Random(16)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(5, 8))) for _ in range(120)})
    keys = spark.createDataFrame([(n,) for n in names], "key string").coalesce(1)
    passes, real = [], dedupe.components

    def components(edges, *more):
        passes.append(([tuple(e) for e in edges.collect()], real(edges, *more)))
        return passes[-1][1]

    monkeypatch.setattr(dedupe, "components", components)
    got = {r.key: r.root for r in dedupe.name_roots(keys).collect()}
    want = {n: n for n in names}
    pairs = [tuple(p) for p in dedupe.similar_names(keys).collect()]
    for _ in names:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(passes) == 2
    within = {r.key: r.root for r in passes[0][1].collect()}
    assert all(within.get(x, x) == x for edge in passes[1][0] for x in edge)
    assert len(dedupe.blocks(keys.select(F.col("key").alias("s"), F.length("key").alias("n"))).inputFiles()) > 1
