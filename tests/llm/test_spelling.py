"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import spelling

from .test_llm import SCHEMA, awkward


def plain(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def less(w):
        return {(k, w[:k] + w[k + 1 :]) for k in range(len(w))}

    cut = {w: less(w) for w in words}
    bare = {w: {d for _, d in x} for w, x in cut.items()}

    def near(a, b):
        if len(a) == len(b):
            return a != b and bool(cut[a] & cut[b])
        return b in bare[a] if len(a) > len(b) else a in bare[b]

    found = {a: sorted((-words[b], b) for b in words if abs(len(a) - len(b)) <= 1 and near(a, b)) for a in words}
    form = {a: x[0][1] if x and -x[0][0] >= 5 * words[a] else None for a, x in found.items()}

    def root(a):
        return a if form[a] is None else root(form[a])

    return sorted((a, form[a], root(a), words[a], len(found[a]), words[form[a]] if form[a] else None) for a in words)


def some_rows(seed=3):
    rng = random.Random(seed)
    letters = "abcdeghilmnorstuéßÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(60)]
    pool = []
    for s in stems:
        pool += [s] * 150
        for _ in range(4):
            k = rng.randrange(len(s))
            v = rng.choice((s[:k] + s[k + 1 :], s[:k] + rng.choice(letters) + s[k:], s[:k] + rng.choice(letters) + s[k + 1 :]))
            pool += [v] * rng.choice((1, 6, 29, 30, 31))
            pool += [v[:2] + rng.choice(letters) + v[2:]] * rng.choice((5, 6))
    pool += ["".join(sorted("abcdefgh", key=lambda _: rng.random())) for _ in range(300)] * 5  # equal vectors
    rng.shuffle(pool)
    rows = [(k, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in pool[k * 40 : k * 40 + 40])) for k in range(len(pool) // 40 + 1)]
    return rows + [(None, "colour " * 30 + "colours-color9Colour"), (None, "color " * 4 + "COLOR"), (7, "colour " * 3), (7, "colour " * 3), (8, "a" * 3000 + " " + "a" * 3001)] * 5 + awkward()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", 2, None, "r", "k", 3) for i, t in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize(("cell", "counted", "at_once"), [(16_000, 200_000, 50_000), (40, 5_000, 4), (5, 50, 50_000)])
def test_against_all_pairs(spark, monkeypatch, cell, counted, at_once):
    """Also with small cells, where the trie is split to its last level and equal vectors are cut into slices."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "COUNTED", counted)
    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    rows = some_rows()
    assert got(frame(spark, rows)) == plain(rows)


def test_edits():
    assert spelling.one_edit("colour", "color") and spelling.one_edit("color", "colour") and spelling.one_edit("abcdef", "abcdeg")
    assert not any(spelling.one_edit(a, b) for a, b in (("abcdef", "abcdef"), ("abcdef", "bacdef"), ("abcdef", "abcdefgh"), ("abc", "bcd"), ("aab", "bba")))
    assert spelling.one_edit("bcdef", "abcdef") and spelling.one_edit("abcdef", "abcde") and spelling.one_edit("aaaa", "aaa")


@pytest.mark.parametrize("at_once", [1, 30, 50_000])
def test_a_cell_against_all_pairs(monkeypatch, at_once):
    """Every pair is found once, from either side, whatever is compared at once; words longer than a row too."""
    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    words = sorted({"".join(rng.choice("abcqé") for _ in range(rng.randint(4, 7))) for _ in range(300)} | {"a" * k for k in (46, 47, 48, 49, 50, 80, 81)} | {"a" * 47 + "b", "a" * 48 + "b", "b" + "a" * 80})
    n = np.arange(len(words)) % 17 + 5
    found = spelling.near_in([], words, n, np.zeros(len(words), np.int8), words, n)
    want = {}
    for a in words:
        near = sorted((-int(n[k]), b) for k, b in enumerate(words) if spelling.one_edit(a, b))
        if near:
            want[a] = (len(near), *near[0])
    assert found == want


def test_chains_end(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)] + [("x", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.followed(forms).collect()} == {**{f"w{k}": "w20" for k in range(20)}, "x": "w20"}


def test_empty_table(spark):
    assert got(frame(spark, [])) == [] and got(frame(spark, [(1, None), (None, ""), (3, "short words only")])) == []
