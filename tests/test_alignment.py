"""Alignments and pairings against plain tables, small and large, and planted differences."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import alignment, revisions


def plain_common(x, y):
    """The whole table, and the way that matches first, then leaves out of x."""
    n, m = len(x), len(y)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if x[i] == y[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_pairs(like, n, m, least):
    best = np.zeros((n + 1, m + 1))
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = max(like[i][j] + best[i + 1, j + 1] if like[i][j] >= least else -1.0, best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if like[i][j] >= least and best[i, j] == like[i][j] + best[i + 1, j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("cells", [1, 40, 4_000_000])
def test_common_takes_the_same_way(monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    rng = np.random.default_rng(2)
    for k in range(300):
        x, y = (rng.integers(0, rng.choice([2, 4, 30]), rng.integers(0, 40)) for _ in range(2))
        if k % 3 == 0:
            y = np.delete(np.insert(x, rng.integers(0, len(x) + 1, 3), 99), rng.integers(0, len(x) + 3, 2)) if len(x) else y
        assert alignment.common(x, y) == plain_common(x, y)


@pytest.mark.parametrize("cells", [1, 60, 4_000_000])
def test_pairing_takes_the_same_way(monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    rng = random.Random(4)
    for _ in range(120):
        old, new = ([np.array([rng.randrange(12) for _ in range(rng.choice((0, 2, 5, 9)))], np.int64) for _ in range(rng.randint(1, 14))] for _ in range(2))
        like = alignment.Likeness(old, new)
        table = [[sum(min((a == w).sum(), (b == w).sum()) for w in set(a.tolist())) / max(len(a), len(b), 1) for b in new] for a in old]
        assert [like.row(i).tolist() for i in range(len(old))] == table
        assert alignment.pairing(like, len(old), len(new), 0.2) == plain_pairs(table, len(old), len(new), 0.2)


def test_ten_thousand_sentences(monkeypatch):
    """Far apart and in a narrow band, the way equals that of the whole table (made a row at a time, one byte a cell)."""
    rng = np.random.default_rng(6)
    far = (rng.integers(0, 50, 10_000), rng.integers(0, 50, 10_000))
    near = np.arange(10_000) % 4_000
    for x, y in (far, (near, np.delete(np.insert(near, [17, 5_000, 9_998], 77), [40, 41, 7_000]))):
        n, m = len(x), len(y)
        moves, below = np.empty((n, m), np.int8), np.zeros(m + 1, np.int32)
        for i in range(n - 1, -1, -1):
            same = y == x[i]
            row = np.append(np.maximum.accumulate(np.where(same, below[1:] + 1, below[:-1])[::-1])[::-1], 0).astype(np.int32)
            moves[i] = np.where(same, 2, np.where(below[:-1] >= row[1:], 1, 0))
            below = row
        want, i, j = [], 0, 0
        while i < n and j < m:
            move = moves[i, j]
            if move == 2:
                want.append((i, j))
            i, j = i + (move != 0), j + (move != 1)
        assert alignment.common(x, y) == want


@pytest.mark.parametrize("n", [499, 501, 1500])
def test_any_number_of_changed_sentences_is_paired(n):
    words = [f"{a}{b}" for a in "klmnprst" for b in "aeiou"]
    rng = random.Random(n)
    old = [" ".join([f"no{k}", *rng.choices(words, k=8)]) + ". " for k in range(n)]
    new = [u[:-2] + " now. " for u in old]
    assert revisions.unit_diff(old, new) == [("change", a, b) for a, b in zip(old, new, strict=True)]


def test_the_case_with_three_choices(spark):
    """A trim of one sentence, a trim of another and a dropped one are three changes, each with a choice of its own."""
    before = "The mill stands idle. Oren is short, broad and sunburnt, with a grey beard. He wears a heavy brown leather apron with iron buckles and a straw hat. He is quite quite quiet and also quiet. He likes rain."
    after = "The mill stands idle. Oren is short and sunburnt. He wears a brown apron. He likes rain."
    diff = revisions.diff_versions(spark.createDataFrame([(1, before, after)], "id long, before string, after string")).persist()
    changes = [r for r in diff.orderBy("ord").collect() if r.kind != "keep"]
    assert [r.kind for r in changes] == ["change", "change", "remove"]
    choice = spark.createDataFrame([(1, changes[1].ord, "old")], "id long, ord int, side string")
    assert revisions.compose(diff, choice).first().text == after.replace("He wears a brown apron. ", changes[1].old)


def test_any_mix_is_made_of_whole_sentences(spark):
    rng = random.Random(7)
    pool = ["He hums at work.", "Crows follow the cart.", "His coat is brown.", "He hates long talks.", "The miller drinks milk.", "Wind does not scare him.", "He counts sacks at dawn.", '"Come in, {{user}}."']
    rows = []
    for k in range(200):
        a = [rng.choice(pool) for _ in range(rng.randint(3, 7))]
        b = [x[:-1] + ", mostly." if rng.random() < 0.3 else x for x in a if rng.random() < 0.75]
        b[rng.randint(0, len(b)) : 0] = [rng.choice(pool)] if rng.random() < 0.5 else []
        rows.append((k, "".join(x + " " for x in a), "".join(x + " " for x in b)))
    diff = revisions.diff_versions(spark.createDataFrame(rows, "id long, before string, after string")).persist()
    mixed = revisions.compose(diff, diff.select("id", "ord", F.expr("CASE WHEN (id + ord) % 2 = 0 THEN 'old' ELSE 'new' END").alias("side")))
    texts = {k: (a, b) for k, a, b in rows}
    split = lambda t: [u.strip() for u in re.split(r'(?<=[.”"])\s+(?=[A-Z“"])', t) if u.strip()]
    for r in mixed.collect():
        assert set(split(r.text)) <= {*split(texts[r.id][0]), *split(texts[r.id][1])}
