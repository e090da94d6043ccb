"""Files in and out, and streams against their batch forms."""

import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import telemetry
from tallyloom.plans import bindings as B
from tallyloom.sources import files as S
from tallyloom.sources import payloads as P
from tallyloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_png_payload():
    image = S.png_of(b'{"name":"x"}')
    assert S.png_payload(image) == '{"name":"x"}'
    at = image.index(b"IDAT") - 4
    body = b"ccv3\0\0" + zlib.compress(b'{"name":"newer"}')
    newer = image[:at] + len(body).to_bytes(4, "big") + b"zTXt" + body + b"\0\0\0\0" + image[at:]
    assert S.png_payload(newer) == '{"name":"newer"}'
    for junk in (b"", b"junk", image[:8], image.replace(b"chara", b"other")):
        with pytest.raises(ValueError):
            S.png_payload(junk)


def test_unreadable_newer_chunk_gives_way():
    image = S.png_of(b'{"name":"x"}')
    at = image.index(b"IDAT") - 4
    body = b"ccv3\0!! no card !!"
    both = image[:at] + len(body).to_bytes(4, "big") + b"tEXt" + body + b"\0\0\0\0" + image[at:]
    assert S.png_payload(both) == '{"name":"x"}'


V2 = {
    "spec": "chara_card_v2", "name": "Old", "description": "old copy", "alternate_greetings": ["x"], "extra": {"deep": [1, None, {"a": 0.5}]},
    "data": {"name": "Orso", "creator": "me", "description": "d", "personality": 0, "scenario": False, "first_mes": None, "mes_example": 5, "alternate_greetings": ["hi", "", "yo"], "tags": ["a", "b"],
             "extensions": {"depth_prompt": {"depth": 1, "prompt": "note", "role": "user"}, "other": True}, "character_book": {"entries": [{"keys": ["k"]}]}},
}


def test_normalize_shapes(spark):
    import json

    rows = [("a", '{"name":"n","description":"d"}'), ("b", '{"data":{"name":"","description":5},"name":"root"}'), ("c", "no json"), ("d", None), ("e", '{"data":{}}'), ("f", json.dumps(V2)), ("g", '{"name":"x"} trailing'), ("h", '{"data":{"tags":"no","alternate_greetings":"no","extensions":{"depth_prompt":{"prompt":7}}}}')]
    got = {r.id: r for r in P.normalize_cards(spark.createDataFrame(rows, "id string, payload string")).collect()}
    short = lambda r: (r.spec, r.name, r.f1)
    assert short(got["a"]) == ("chara_card_v1", "n", "d") and short(got["b"]) == ("chara_card_v2", "root", "5") and short(got["e"]) == ("chara_card_v2", "(unnamed)", "")
    assert got["c"].spec is None and got["d"].spec is None and got["g"].spec is None and got["a"].flat and not got["f"].flat
    f = got["f"]
    assert (f.name, f.creator, f.tags, f.f1, f.f2, f.f3, f.f4, f.f5, f.f8, f.f9, f.note_depth) == ("Orso", "me", ["a", "b"], "d", "", "", "", "5", "note", "hi\n\n---\n\nyo", 1)
    assert got["h"].tags == [] and got["h"].f8 == "" and got["h"].f9 == ""


def test_field_patch_keeps_every_other_key(spark):
    import copy
    import json

    flat = {"name": "Flat", "description": "d", "first_mes": "m", "other": [1, 2]}
    raw = spark.createDataFrame([("v2", json.dumps(V2)), ("flat", json.dumps(flat)), ("note", json.dumps(flat)), ("bare", '{"data":{"name":"B"}}')], "id string, payload string")
    patches = [
        ("v2", {"description": "new", "alternate_greetings": "one\n\n---\n\n two \n---\n", "character_note": "noted"}, " Renamed "), ("flat", {"first_mes": "", "description": None, "alternate_greetings": " "}, None),
        ("note", {"character_note": "x"}, None), ("bare", {"character_note": "x"}, "  "),
    ]
    got = {r.id: r for r in P.field_patch(raw, spark.createDataFrame(patches, "id string, fields map<string,string>, name string")).collect()}
    want = copy.deepcopy(V2)
    want["data"] |= {"description": "new", "alternate_greetings": ["one", "two"], "name": "Renamed"}
    want["data"]["extensions"]["depth_prompt"]["prompt"] = "noted"
    want |= {"description": "new", "alternate_greetings": ["one", "two"], "name": "Renamed"}
    assert json.loads(got["v2"].payload) == want
    assert json.loads(got["flat"].payload) == flat | {"first_mes": "", "alternate_greetings": []}
    assert json.loads(got["note"].payload) == flat and got["note"].error
    assert json.loads(got["bare"].payload) == {"data": {"name": "B", "extensions": {"depth_prompt": {"depth": 4, "role": "system", "prompt": "x"}}}}


def test_score_file_shapes(spark):
    files = [("1", '[{"id":"a","overallScore":7}]'), ("2", '{"scores":[{"name":"b","score":"6.5"}]}'), ("3", '{"x.png":8,"y.png":{"overall_score":3}}'), ("4", "broken"), ("5", "[]")]
    got = {(r.source, r.id, r.name, r.score) for r in S.read_scores(spark.createDataFrame(files, "source string, content string")).collect()}
    assert got == {("1", "a", None, 7.0), ("2", None, "b", 6.5), ("3", "x.png", None, 8.0), ("3", "y.png", None, 3.0)}


def test_written_tables_need_a_shared_folder(spark, monkeypatch):
    from tallyloom.sources import store

    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())
