"""Ranked search against every document scored in plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import lexical

from .test_llm import SCHEMA, awkward, vocabulary

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(t or "")]


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [b.total() for _, b in bags]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for (i, b), size in zip(bags, sizes, strict=True):
            if size:
                m = 100 - 75 + (75 * size * n) // words
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
                if s > 0:
                    scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", 2, None, "r", "k", 3) for i, t in rows], SCHEMA).repartition(3)


def some_docs():
    rng, words = random.Random(4), vocabulary(400, 7)
    rows = [(k, " ".join(rng.choices(words[: rng.choice((20, 100, 400))], k=rng.choice((3, 40, 300, 2500))))) for k in range(150)]
    rows += [(200 + k, rows[k][1]) for k in range(0, 60, 2)]  # equal scores
    rows += [(400, "many " * 700 + "few"), (401, "many " * 300), (402, "MANY\tmány-manY_many"), (None, rows[5][1]), (3, rows[9][1]), (None, "many")]
    return rows + [(i + 1000 if i is not None else None, t) for i, t in awkward()]


def some_items():
    rng, words = random.Random(6), vocabulary(400, 7)
    items = [(k, " ".join(rng.choices(words, k=rng.choice((1, 5, 30))))) for k in range(25)]
    return items + [(100, None), (101, ""), (102, "... !"), (103, "many few many"), (104, "nowherefound"), (105, "mány"), (25, items[3][1]), (25, items[3][1]), (106, "x"), (107, "a b c one")]


def ranked(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize(("batch", "block", "coordinates"), [(128, 32768, 1024), (3, 40, 1024), (16, 200, 8)])
def test_against_every_document(spark, monkeypatch, batch, block, coordinates):
    """Also where few coordinates make loose bounds, and where queries come in several blocks."""
    for name, value in (("BATCH", batch), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = some_docs(), some_items()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, rank int").repartition(2)
    assert ranked(lexical.search(lexical.index(frame(spark, docs), coordinates=coordinates), table)) == plain(docs, items)


def test_bounds_hold_and_spare_work(monkeypatch):
    """No document scores above its bound, and most aren't rescored."""
    rng, words = random.Random(1), vocabulary(3000, 2)
    docs = [" ".join(rng.choices(words, k=rng.choice((20, 200)))) for _ in range(600)]
    found = [lexical.counted(t) for t in docs]
    n, total = len(docs), sum(f[0] for f in found)
    m = np.array([25 + 75 * f[0] * n // total for f in found])
    tops = np.stack([np.frombuffer(lexical.sketch(*f[1:]), np.uint8) for f in found]).astype(np.int64)
    asked = lexical.counted(" ".join(rng.choices(words, k=8)))
    bound = lexical.impact(tops, m[:, None])[:, asked[1] % lexical.COORDINATES] @ asked[2]
    exact = np.array([sum(c * lexical.impact(f[2][f[1] == t], mm).sum() for t, c in zip(asked[1], asked[2], strict=True)) for f, mm in zip(found, m, strict=True)])
    assert (bound >= exact).all() and (bound >= np.sort(exact)[-10]).sum() < 120


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.index(frame(spark, [])), items).count() == 0
    assert lexical.search(lexical.index(frame(spark, [(1, None), (2, "?")])), items).count() == 0
    assert lexical.search(lexical.index(frame(spark, [(1, "a b")])), items.limit(0)).count() == 0
