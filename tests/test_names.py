"""Groups of similar names from spanning links, against all pairs."""

import itertools
import random

import pytest

from tallyloom.functions import text as T
from tallyloom.operators import dedupe


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    if a == b:
        return n >= 3
    return (n >= 4 and short in long and n >= 0.4 * len(long)) or (n >= 5 and len(long) - n <= 2 and distance(a, b) <= (2 if n >= 8 else 1))


def plain_roots(keys, form):
    root = {k: k for k in keys}
    for a, b in itertools.combinations(sorted(keys), 2):
        if root[a] != root[b] and alike(form[a], form[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    """Short and long keys, chains, holders, and a beginning that most keys share, so that its blocks are hot."""
    rng = random.Random(seed)
    keys = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(80)}
    keys |= {"dragon" + "".join(rng.choice("klmnop") for _ in range(rng.randint(2, 9))) for _ in range(90)}
    for n in (8, 13, 40, 41, 70):
        base = "".join(rng.choice("uvwxyz") for _ in range(n))
        for _ in range(5):
            keys.add(base)
            k = rng.randrange(len(base))
            base = rng.choice((base[:k] + base[k + 1 :], base[:k] + rng.choice("uvw") + base[k:], base[:k] + rng.choice("uvw") + base[k + 1 :]))
    keys = sorted(k for k in keys if k)
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    form = {r.key: r.s for r in df.select("key", T.strip_affixes(df.key).alias("s")).collect()}
    want = plain_roots(keys, form)
    assert {r.key: r.root for r in dedupe.name_roots(df).collect()} == want
    pairs = {tuple(r) for r in dedupe.similar_names(df).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(keys, 2) if alike(form[a], form[b])}


def test_a_stripped_key_of_many_names(spark):
    """Thousands of keys with one stripped form are a group by as many links, not by all their pairs."""
    tags = T.NAME_AFFIXES
    keys = sorted({"".join(c) + "lanternkeeper" for n in range(5) for c in itertools.product(tags[:8], repeat=n)})
    got = {r.root for r in dedupe.name_roots(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert len(keys) > 4000 and got == {keys[0]}


def test_no_names(spark):
    assert dedupe.duplicate_groups(spark.createDataFrame([(1, "!!", 2.0), (2, None, None)], "id long, name string, score double")).count() == 0
    few = spark.createDataFrame([(1, "Ab", 2.0), (2, "ab", 3.0), (3, "cd", 1.0)], "id long, name string, score double")
    assert {(r.id, r.tag) for r in dedupe.duplicate_groups(few).collect()} == {(1, "DUPLICATE"), (2, "BEST")}
