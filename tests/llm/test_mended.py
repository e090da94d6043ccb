"""Cases that once crashed, lost links or changed with a size: many repeated rows, null ids, slices of long texts, repeated labels."""

import random

import pytest

from tallyloom.llm import quality_classifier, simhash, substring_dedup, toxicity

from .test_llm import vocabulary


def test_two_thousand_repeats_of_a_row(spark):
    """The repeats of one id and text are one document: each loses what a smaller id has, and no other work is done for them."""
    rng, words = random.Random(3), vocabulary(400, 5)
    first = [rng.choice(words) for _ in range(200)]
    second = first[30:180] + [rng.choice(words) for _ in range(50)]
    rows = [(1, " ".join(first))] + [(2, " ".join(second))] * 2000 + [(None, " ".join(first))] * 3
    found = substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    counts = {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in found.groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert counts == {(1, 200, 0): 1, (2, 200, 150): 2000, (None, 200, 0): 3}


def test_null_ids_link(spark, monkeypatch):
    """A row without an id that is near a document is in its component, and joins two documents that it alone is near to."""
    texts = {"a": 0b0, "b": 0b11, "c": 0b1111, "far": (1 << 40) - 1, "far2": (1 << 40) - 2}
    rows = [(5, "a"), (None, "b"), (9, "c"), (None, "far"), (None, "far2"), (3, "far2x")]
    monkeypatch.setattr(simhash, "fingerprints", lambda df, text_col, words, *carried: df.select(*carried, *[spark_case(text_col, texts)]))
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for (i, k), v in found.items() if v == 5} == {f"{texts[x]:016x}": 5 for x in "abc"}
    assert found[None, f"{texts['far']:016x}"] is None and found[None, f"{texts['far2']:016x}"] is None and found[3, "5" * 16] == 3


def spark_case(text_col, texts):
    from pyspark.sql import functions as F

    out = F.lit(0x5555555555555555)
    for name, value in texts.items():
        out = F.when(F.col(text_col) == name, F.lit(value)).otherwise(out)
    return out.cast("long").alias("fp")


BLANKS = [" ", "\n", "\t", "\r", "\x0b", "\f", "\x85", "\xa0", "  ", " \t", "\n\n"]


@pytest.mark.parametrize("size", [1, 3, 7, 40])
def test_slices_change_nothing(size):
    """Parts spell the text and encode to the same words, whatever blanks there are, and wherever single characters meet an edge."""
    rng = random.Random(size)
    words = ["i", "d", "o", "t", "idiot", "a-b", "mild.", "(x)", "Straße", "né", "!", "q" * 90]
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice(BLANKS) for _ in range(rng.randint(0, 60))) + rng.choice(["", "e", " ", "end"])
        parts = list(toxicity.slices(text, size))
        assert "".join(parts) == text

        def spelled(parts):
            out = []
            for p in parts:
                code, starts = toxicity.encode(p)
                if not len(starts):
                    continue
                ends = [*starts[1:].tolist(), len(code) - 1]
                out += [tuple(code[a:b].tolist()) for a, b in zip(starts.tolist(), ends, strict=True) if b > a + 1]
            return out

        assert spelled(parts) == spelled([text] if text else [])


def test_a_long_text_between_tabs_keeps_its_words():
    machine = toxicity.Machine(__import__("numpy").zeros(toxicity.CLASSES**3, "float32"), 0.0, (0.0, 0.0, 0.0))
    assert len(machine.words("\t".join(["abcdef"] * 60_000))) == 60_000


def test_what_is_learned_from_is_bounded(spark, monkeypatch):
    """Rows that repeat an id count once, and texts stop where they have so many characters in all."""
    docs = spark.createDataFrame([(i, f"words of document {i} " * 5) for i in range(40)] + [(7, f"another text {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    texts = toxicity.training_sample(docs, labels, "doc_id", "text")[0].collect()
    assert len(texts) == len({i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 4 != 2})
    monkeypatch.setattr(toxicity, "MAX_CHARACTERS", 700)
    assert 0 < sum(len(r.text) for r in toxicity.training_sample(docs, labels, "doc_id", "text")[0].collect()) <= 700
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, real=quality_classifier.fit: seen.append(len(rows)) or real(rows))
    full = docs.selectExpr("doc_id", "text", "'s' AS source", "'en' AS lang")
    assert quality_classifier.classified(full, labels).count() == 340 and seen == [len(texts)]
