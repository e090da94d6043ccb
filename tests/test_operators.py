"""Golden cases and properties of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import failures, text
from tallyloom.operators import dedupe, edits, replies, revisions, telemetry
from tallyloom.operators import ledger as L


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("name", "key"),
    [("Tin Lantern.png", "tinlantern"), ("Tin Lantern (1) v2", "tinlantern"), ("Orsolo final 3", "orsolo"), ("", ""), (None, ""), ("日本", "")],
)
def test_dedupe_key(spark, name, key):
    assert one(spark, name, text.dedupe_key) == key


@pytest.mark.parametrize(("key", "out"), [("scporso", "orso"), ("thescporsobot", "orso"), ("thebot", "thebot"), ("mycardmira", "mira"), ("the" * 20 + "mira", "mira"), ("mira" + "bot" * 17 + "ai", "mira"), ("orso", "orso")])
def test_strip_affixes(spark, key, out):
    assert one(spark, key, text.strip_affixes) == out


@pytest.mark.parametrize(
    ("message", "kind"),
    [("Request timed out", "Request timed out (model too slow)"), ("HTTP 404", "Provider rejected the request (404)"), ("HTTP 503", "Provider server error (503)"), ("odd", "Other"), (None, "Other")],
)
def test_error_kind(spark, message, kind):
    assert one(spark, message, failures.error_kind) == kind


@pytest.mark.parametrize(
    ("status", "message", "scope"),
    [(402, "x", "fatal"), (429, "exceeded your current quota", "fatal"), (429, "quota exceeded, try again in 5 s", "item"), (503, "x", "connectivity"), (None, "fetch failed", "connectivity"), (500, "x", "item"), (404, "no such model", "fatal"), (200, None, None)],
)
def test_failure_scope(spark, status, message, scope):
    df = spark.createDataFrame([(status, message)], "s int, m string")
    assert df.select(failures.failure_scope(F.col("s"), F.col("m"))).first()[0] == scope


def test_half_up(spark):
    assert [r[0] for r in spark.createDataFrame([(-0.25,), (0.25,), (0.35,)], "x double").select(text.half_up(F.col("x"))).collect()] == [-0.2, 0.3, 0.4]


def test_reasoning_and_recovery(spark):
    rows = [(1, '<think>{"fields":1}</think>{"fields":{"a":1}}'), (2, 'so: ```json\n{"fields":{"a":"}"}}\n```'), (3, "plain"), (4, None), (5, '{"x":1} then {"fields":{}}')]
    out = {r.id: r.answer for r in replies.extract_json(spark.createDataFrame(rows, "id int, content string")).collect()}
    assert out[1] == '{"fields":{"a":1}}' and out[2] == '{"fields":{"a":"}"}}' and out[3] is None and out[4] is None and out[5] == '{"fields":{}}'


def test_detail_terms(spark):
    got = one(spark, "The tan kite had 12 cm tails, and Orso's ladder was of birch. With it", text.detail_terms)
    assert {"tan", "kite", "12 cm", "tails", "orso", "ladder", "birch"} <= set(got) and "with" not in got


def test_weighted_overall(spark):
    df = spark.createDataFrame([(8, 6)], "d int, f int")
    assert df.select(replies.weighted_overall({"description": F.col("d"), "first_mes": F.col("f")})).first()[0] == 7.1


def close(a, b):
    if abs(len(a) - len(b)) > 2:
        return 3
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_blocking_is_complete(spark):
    """All pairs of random keys, long ones included, against the blocked join."""
    rng = random.Random(5)
    keys = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)}
    for n in (30, 38, 39, 40, 41, 42, 60):
        base = "".join(rng.choice("abcdef") for _ in range(n))
        keys |= {base, base[:-2], base[1:], base[:10] + "zz" + base[12:], base[:5] + "q" + base[5:], base[: n // 2] + base[n // 2 + 2 :]}
    keys = sorted(k for k in keys if k)
    want = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            short, long = sorted((a, b), key=len)
            k = 2 if len(short) >= 8 else 1 if len(short) >= 5 else 0
            if (len(short) >= 4 and short in long and len(short) >= 0.4 * len(long)) or (k and close(a, b) <= k):
                want.add((a, b))
    got = {tuple(r) for r in dedupe.similar_names(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(20)] + [("x", "y")], "a string, b string")
    assert {r.key: r.root for r in dedupe.components(edges).collect()} == {f"{i:03}": "000" for i in range(21)} | {"x": "x", "y": "x"}


def test_merge_is_independent_of_order(spark):
    s = "id string, score double, scored_at timestamp, source_ord int"
    a = spark.sql("SELECT 'a' AS id, 7.0D AS score, TIMESTAMP'2024-01-01' AS scored_at, 0 AS source_ord UNION ALL SELECT 'b', NULL, TIMESTAMP'2024-02-01', 0")
    b = spark.sql("SELECT 'b' AS id, 9.0D AS score, TIMESTAMP'2023-01-01' AS scored_at, 1 AS source_ord UNION ALL SELECT 'c', 4.0D, NULL, 1")
    rows = lambda df: sorted((r.id, r.score) for r in df.collect())
    assert rows(L.merge_ledgers(a, b)) == rows(L.merge_ledgers(b, a)) == [("a", 7.0), ("b", 9.0), ("c", 4.0)]
    assert L.merge_ledgers(spark.createDataFrame([], s)).count() == 0


TEXT = "A tin lamp. It is  old… “Very old,” he said. A tin cup."
PARTS = [("c", "description", TEXT, False), ("c", "scenario", "", True), ("c", "first_mes", "Hello there. Good day.", False), ("c", "personality", "calm", False)]
CASES = [
    # field, action, find, put -> reason, or the text that the edit gives
    ("nowhere", "replace", "a", "b", edits.NO_PART), ("description", "disable", "A tin lamp.", "", edits.NO_SWITCH), ("personality", "replace", "calm", "wild", edits.NOT_CHOSEN),
    ("description", "write", "", "new", edits.NOT_EMPTY), ("scenario", "write", "", "  ", edits.NOTHING), ("description", "replace", " ", "x", edits.NO_QUOTE), ("description", "replace", "a copper lamp", "x", edits.ABSENT),
    ("description", "replace", "A tin", "x", edits.SEVERAL), ("description", "replace", "A tin lamp.", "A tin lamp.", edits.NO_CHANGE), ("description", "insert_after", "A tin lamp.", " ", edits.NOTHING),
    ("description", "replace", "tin lamp", "brass lamp", "A brass lamp. It is  old… “Very old,” he said. A tin cup."),
    ("description", "replace", "It is old...", "New.", "A tin lamp. New. “Very old,” he said. A tin cup."),
    ("description", "replace", '"Very old," he', "He", "A tin lamp. It is  old… He said. A tin cup."),
    ("description", "insert_after", "A tin lamp.", "Bright.", "A tin lamp. Bright. It is  old… “Very old,” he said. A tin cup."),
    ("description", "insert_before", "It is", "Once.", "A tin lamp. Once. It is  old… “Very old,” he said. A tin cup."),
    ("first_mes", "replace", "Good", "", "Hello there. day."), ("first_mes", "replace", "there", "", "Hello . Good day."), ("scenario", "write", "", " At sea. ", "At sea."), ("scenario", "replace", "x", "At sea.", "At sea."),
]


@pytest.mark.parametrize(("field", "action", "find", "put", "result"), CASES)
def test_one_edit(spark, field, action, find, put, result):
    parts = spark.createDataFrame(PARTS, "id string, field string, text string, empty boolean")
    allowed = spark.createDataFrame([("c", f) for f in ("description", "scenario", "first_mes", "nowhere")], "id string, field string")
    edit = spark.createDataFrame([("c", 0, field, action, find, put)], "id string, ord int, field string, action string, find string, put string")
    placed = edits.place_edits(edit, parts, allowed)
    got = placed.first()
    if got.reason:
        assert got.reason == result
    else:
        assert edits.apply_edits(parts, placed).where(F.col("field") == field).first().text == result


def test_edits_of_one_part_in_order(spark):
    """The first placed wins; insertions at one place keep their order; a part is filled once."""
    parts = spark.createDataFrame(PARTS, "id string, field string, text string, empty boolean")
    rows = [
        ("description", "replace", "tin lamp", "X"), ("description", "replace", "lamp. It", "Y"), ("description", "insert_after", "A tin lamp.", "one"), ("description", "insert_after", "tin lamp.", "two"),
        ("description", "insert_before", "lamp", "no"), ("scenario", "write", "", "a"), ("scenario", "write", "", "b"),
    ]
    edit = spark.createDataFrame([("c", n, *r) for n, r in enumerate(rows)], "id string, ord int, field string, action string, find string, put string")
    placed = edits.place_edits(edit, parts)
    assert {r.ord: r.reason for r in placed.collect()} == {0: None, 1: edits.OVERLAP, 2: None, 3: None, 4: edits.OVERLAP, 5: None, 6: edits.FILLED}
    text = {r.field: r.text for r in edits.apply_edits(parts, placed).collect()}
    assert text["description"].startswith("A X. one two It is") and text["scenario"] == "a" and text["personality"] == "calm"


def test_impact(spark):
    """A detail is lost only if the whole card lacks it; a fix corrects on purpose, for other edits too."""
    parts = spark.createDataFrame([("c", "description", "A copper kettle, 7 feet tall. Marble floor.", False), ("c", "scenario", "The kettle waits.", False)], "id string, field string, text string, empty boolean")
    rows = [(0, "replace", "copper kettle", "kettle", "trim"), (1, "replace", "7 feet", "8 feet", "fix"), (2, "replace", "Marble floor.", "A floor.", "extend")]
    edit = spark.createDataFrame([("c", n, "description", a, f, t, k) for n, a, f, t, k in rows], "id string, ord int, field string, action string, find string, put string, kind string")
    got = {r.ord: (r.lost, r.corrected, r.on) for r in edits.edit_impact(edits.place_edits(edit, parts), edit, parts).collect()}
    assert got == {0: ("copper", "", False), 1: ("", "7 feet", True), 2: ("marble", "", False)}


def test_diff_rebuilds_both_sides(spark):
    rng = random.Random(3)
    pool = ["One fell. ", "Two ran!\n", "Three? ", "3.5 feet tall.\n\n", "“Quoted.” ", "no end", "", "Two ran far. "]
    rows = [(i, "".join(rng.choices(pool, k=6)), "".join(rng.choices(pool, k=6))) for i in range(100)]
    pairs = spark.createDataFrame(rows, "id long, before string, after string")
    diff = revisions.diff_versions(pairs).persist()
    want = {i: (b, a) for i, b, a in rows if a != b}
    old = diff.select("id", "ord", F.lit("old").alias("side"))
    assert {r.id: r.text for r in revisions.compose(diff, old).collect()} == {i: x[0] for i, x in want.items()}
    assert {r.id: r.text for r in revisions.compose(diff).collect()} == {i: x[1] for i, x in want.items()}
    assert not any("3." in (r.old, r.new) for r in diff.collect())


def test_changed_sentences_are_paired():
    old = ["The kite was red and long. ", "Nobody saw it. ", "It flew over the barn at noon. "]
    new = ["The kite was red. ", "It flew over the old barn. ", "Then came rain. "]
    assert revisions.unit_diff(old, new) == [("change", old[0], new[0]), ("remove", old[1], ""), ("change", old[2], new[1]), ("add", "", new[2])]


def test_word_marks(spark):
    rows = [(1, 0, "change", "a red kite", "a blue kite"), (1, 1, "keep", "x", "x"), (2, 0, "add", "", "new words")]
    got = {(r.id, r.ord): r for r in revisions.word_diff(spark.createDataFrame(rows, "id long, ord int, kind string, old string, new string")).collect()}
    assert [m.text for m in got[1, 0].old_marks if m.changed] == ["red"] and [m.text for m in got[1, 0].new_marks if m.changed] == ["blue"]
    assert "".join(m.text for m in got[1, 0].new_marks) == "a blue kite" and set(got) == {(1, 0), (2, 0)}


def test_newest_object_in_linear_time():
    import time

    assert replies.newest_object('{"fields":{"a":"}"}} then {"fields":{"b":1}} {x}', "fields") == '{"fields":{"b":1}}'
    assert replies.newest_object('a stray " and {"fields":{"a":"{"}}', "fields") == '{"fields":{"a":"{"}}'
    assert replies.newest_object('{"other":{"fields":[1]}}', "fields") == '{"fields":[1]}'
    began = time.process_time()
    for junk in ("{" * 200_000, '{"a":' * 60_000, '{"' * 100_000, "{}" * 100_000, '"{' * 100_000):
        replies.newest_object(junk, "fields")
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    ("fields", "overall", "scores"),
    [
        ('{"description":7.5,"first_mes":"6"}', 7.1, {"description": 8, "first_mes": 6}), ('{"description":{"score":null}}', 1.0, {"description": 1}), ('{"description":null,"first_mes":3}', 3.0, {"first_mes": 3}),
        ('{"description":"8/10","first_mes":99}', 10.0, {"description": None, "first_mes": 10}), ('{"odd":4,"strange":7}', 5.5, {"odd": 4, "strange": 7}), ('{"odd":4,"personality":{"score":true}}', 1.0, {"personality": 1}),
        ('{"alternate_greetings":6}', 6.0, {"alternate_greetings": 6}), ('{"description":"n/a"},"overall_score":12', 10.0, {"description": None}),
    ],
)
def test_scores_of_odd_replies(spark, fields, overall, scores):
    row = replies.parse_scores(spark.createDataFrame([(1, '{"fields":' + fields + "}")], "id int, answer string")).first()
    assert row.overall == overall and {k: v.score for k, v in row.fields.items()} == scores


def test_replies_without_scores_are_left_out(spark):
    rows = [(1, '{"fields":{}}'), (2, '{"fields":{"description":"n/a"},"overall_score":"7"}'), (3, None), (4, '{"fields":[1]}')]
    assert replies.parse_scores(spark.createDataFrame(rows, "id int, answer string")).count() == 0


def test_answers_in_order_of_trust(spark):
    rows = [(1, '```json\n{"fields":{"a":1}}\n```\nor {"fields":{}}'), (2, '{"fields":{"a":1}} trailing {"fields":{"b":2}}'), (3, '{"fields":{"a":1}}')]
    got = {r.id: r.answer for r in replies.extract_json(spark.createDataFrame(rows, "id int, content string")).collect()}
    assert got == {1: '{"fields":{"a":1}}', 2: '{"fields":{"b":2}}', 3: '{"fields":{"a":1}}'}


@pytest.mark.parametrize(("code", "status", "message", "body", "scope"), [("ECONNRESET", None, None, "", "connectivity"), (None, 429, "no", "You exceeded your current quota", "fatal"), ("EPIPE", None, "x", "", "item"), (None, None, "timed out: network", "", "item")])
def test_failure_scope_of_sockets_and_bodies(spark, code, status, message, body, scope):
    df = spark.createDataFrame([(code, status, message, body)], "c string, s int, m string, b string")
    assert df.select(failures.failure_scope(F.col("s"), F.col("m"), F.col("c"), F.col("b"))).first()[0] == scope


def test_sql_functions_equal_the_columns(spark):
    from tallyloom.functions import sql

    assert set(sql.register(spark)) == {"token_estimate", "error_kind", "dedupe_key", "detail_terms", "weighted_overall", "weighted_overall_by"}
    rows = [("Tin Lantern (1) v2.png", "HTTP 404 here"), ("Orso's 12 cm kite, 3'4″ – \"quoted\"", "timed out"), ("", None), (None, "odd")]
    df = spark.createDataFrame(rows, "name string, m string")
    cols = [text.dedupe_key(F.col("name")), failures.error_kind(F.col("m")), text.token_estimate(F.col("name")), text.detail_terms(F.col("name"))]
    want = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()
    df.createOrReplaceTempView("named")
    assert spark.sql("SELECT dedupe_key(name), error_kind(m), token_estimate(name), detail_terms(name) FROM named").collect() == want


def test_free_numbers_of_copies(spark):
    """No number that a file there, or a card of the batch, has is given."""
    s = "id string, hash string"
    cards = spark.createDataFrame([("a.png", "1"), ("a (3).png", "1"), ("b.json", "1"), ("c", "1"), ("d.png", "1")], s)
    there = spark.createDataFrame([("a.png", "0"), ("a (2).png", "0"), ("a (3).png", "0"), ("b.json", "1"), ("c", "0")], s)
    known = cards.select("id")
    got = {r.id: (r.copied_to, r.action, r.score_travels) for r in L.publish_keepers(cards, there, known, spark.createDataFrame([("b.json",)], "id string")).collect()}
    assert got == {"a.png": ("a (4).png", "renamed", True), "a (3).png": ("a (3) (2).png", "renamed", True), "b.json": (None, "skipped", False), "c": ("c (2)", "renamed", True), "d.png": ("d.png", "copied", True)}


def test_outage_needs_two(spark):
    rows = [(i, "a", "p", f"2024-01-01 00:0{i}:00", 1, s, None if s == 200 else "x") for i, s in enumerate([503, 200, 503, 503, 401, 503])]
    log = spark.createDataFrame(rows, "log_id int, item string, provider string, t string, took_ms int, status int, error string").withColumn("ts", F.to_timestamp("t"))
    assert [r.failures for r in telemetry.outages(log).collect()] == [2]


def test_similarity_join_has_no_cross_product(spark):
    plan = dedupe.similar_names(spark.createDataFrame([("mira",), ("miras",)], "key string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_works_without_the_llm_folder(spark, monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError(name)) if name == "corpus_pipeline" else real(name, *a, **k))
    assert "op2_exact_dedup" not in importlib.reload(entry).queries() and "score_histogram" in entry.queries()
    monkeypatch.undo()
    importlib.reload(entry)
