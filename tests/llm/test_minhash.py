"""MinHash near-dedup against all pairs, with stars that leave links open, hot buckets, null ids and odd texts."""

import random

import numpy as np
import pytest

from tallyloom.llm import minhash, near_copies

from .test_llm import SCHEMA, awkward, words_of


def sets_of(rows):
    out = []
    for _, t in rows:
        w = [x.lower() for x in words_of(t)]
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def plain(rows, percent=85):
    sets = sets_of(rows)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    ids = {g: [r[0] for r, k in zip(rows, group, strict=True) if k == g and r[0] is not None] for g in group}
    out = []
    for (i, _), s, g in zip(rows, sets, group, strict=True):
        low = (min(ids[g]) if ids[g] else None) if s else i
        out.append((i, len(s), low, i == low))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", 2, None, "r", "k", 3) for i, t in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)


def edited(words, rng, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def families(seed=5):
    """Groups of texts a few edits apart: some link to all, some only along a chain, some to none."""
    rng = random.Random(seed)
    rows, n = [], 0
    for size, edits in ((2, 1), (12, 2), (40, 3), (25, 4), (6, 9)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 180, 400)))]
        for _ in range(size):
            rows.append((n, " ".join(edited(base, rng, edits))))
            n += rng.randrange(1, 4)
    chain = [f"c{k}" for k in range(300)]
    for k in range(12):
        rows.append((n, " ".join(chain[k * 6 : k * 6 + 200])))
        n += 1
    short = [f"s{k}" for k in range(12)]
    for k in range(5, 13):
        rows.append((n, " ".join(short[:k])))
        n += 1
    return rows


@pytest.mark.parametrize("tile", [3, 512])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = families() + [(i, t) if i is None else (i + 5000, t) for i, t in awkward()]
    rows += [(None, rows[0][1]), (None, rows[3][1] + " x"), (9000, rows[40][1].upper().replace("W", "w")), (9000, "an id that recurs with another text of six")]
    assert got(frame(spark, rows)) == plain(rows)


def test_what_stars_leave_open(spark):
    """Two ends that link with each other and not with any centre: only the comparison of tiles finds them."""
    rng = np.random.default_rng(3)

    def numbers(n):
        return [rng.bytes(8) + b"x" * 8 for _ in range(n)]

    base = np.unique(rng.integers(0, 1 << 63, 200, np.int64))
    sets = {"far": np.concatenate([base[:150], rng.integers(0, 1 << 63, 60, np.int64)]), "one": base, "two": np.concatenate([base[3:], rng.integers(0, 1 << 63, 3, np.int64)])}
    names = sorted(numbers(3))
    pairs = [(n, np.unique(s)) for n, s in zip(names, sets.values(), strict=True)]
    table = spark.createDataFrame([(n, s.tolist()) for n, s in pairs], "node binary, shingles array<long>")
    listed = spark.createDataFrame([(1, n, len(s), n) for n, s in pairs], "key long, node binary, size long, root binary")
    stars = minhash.open_stars(listed)
    assert {bytes(r.center) for r in stars.collect()} == {names[0]} and minhash.confirmed_stars(stars, table, 85).count() == 0
    assert {frozenset((bytes(r.u), bytes(r.v))) for r in minhash.confirmed_tiles(listed, table, 85).collect()} == {frozenset(names[1:])}


def test_bins_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    for size in (3, 20, 110, 2000):
        for s in (0.5, 0.85):
            agree = []
            for _ in range(60):
                shared = max(1, round(2 * size * s / (1 + s)))
                both = rng.integers(0, 1 << 63, shared, np.uint64) * np.uint64(2)
                a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, size - shared, np.uint64) * np.uint64(2)])) for _ in range(2))
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                agree.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
            assert abs(np.mean(agree)) < 0.08


def test_a_third_of_all_rows_is_near(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(base, rng, 1))) for k in range(400)] + [(1000 + k, " ".join(f"u{rng.randrange(10**9)}" for _ in range(40))) for k in range(800)]
    found = got(frame(spark, rows))
    assert found == sorted([(i, len(s), 0 if i < 400 else i, i == 0 or i >= 400) for (i, _), s in zip(rows, sets_of(rows), strict=True)], key=str)


def test_empty_table_and_kept_ids(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    only_nulls = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, "")])
    assert got(only_nulls) == sorted([(None, 2, None, True)] * 2 + [(None, 0, None, True), (4, 0, 4, True)], key=str)
    assert {r.doc_id for r in minhash.keep_one(frame(spark, [(1, "a b"), (2, "A B"), (3, "c"), (None, "d")])).collect()} == {1, 3}


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, n)).astype(np.uint64) for n in (1, 5, 30, 60)]
    other = np.unique(rng.integers(0, 50, 20)).astype(np.uint64)
    assert minhash.shared(sets, other).tolist() == [len(np.intersect1d(s, other)) for s in sets]
    assert near_copies.forest([s.view(np.int64) for s in (sets[2], sets[2])], 8.5) == ([0], [1])
