"""Weak supervision on planted junk, and the hierarchical classifier against a plain version and on planted sites."""

import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import quality_classifier as Q
from tallyloom.llm import quality_rules as R


def planted(shares, rates, n, seed=3):
    """Votes of ``n`` documents: class 0 is good; rates are of bad votes; a tenth of the votes is withheld."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(len(shares), n, p=shares)
    votes = np.where(rng.random((n, rates.shape[1])) < rates[kind], 0, 1)
    votes[rng.random(votes.shape) < 0.1] = 2
    return kind, votes


@pytest.mark.parametrize("rare", [0.01, 0.1])
def test_no_kind_of_junk_hides_another(rare):
    """A kind that is up to twenty times rarer than the commonest is still told, and rates come out as planted."""
    rates = np.array([[0.01, 0.02, 0.01, 0.03, 0.01], [1, 0.8, 0.02, 0.02, 0.02], [0.02, 0.02, 1, 0.02, 0.9]])
    kind, votes = planted([0.8 - rare, 0.2, rare], rates, 40_000)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = R.fit([(*[None if x == 2 else int(x) for x in r], int(c)) for r, c in zip(rows, counts, strict=True)])
    good = model.good(votes)
    told = (votes[:, [0, 2]] != 2).all(axis=1)
    assert ((good >= 0.5) == (kind == 0))[told].mean() > 0.95  # a lone false alarm looks like junk
    assert (good[told & (kind == 2)] < 0.5).mean() > 0.95
    assert np.abs(model.accuracies()[:, 0] - (1 - rates[0])).max() < 0.03


def test_abstentions_say_nothing():
    model = R.fit([(1, 1, 1, 900), (0, 0, 1, 60), (0, 1, 0, 40)])
    assert np.allclose(model.good(np.array([[2, 2, 2]])), model.share[0])
    few = R.fit([(None, None, None, 0)])
    assert 0 < few.good(np.array([[1, 1, 1]]))[0] < 1


def test_kept_is_the_posterior(spark):
    """Every document takes part in the fit; the column equals the model's posterior of its votes."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=60)) + "\n" + " ".join(rng.choices(words, k=20)) for _ in range(300)]
    texts += ["## ** && " * 20 + " ".join(rng.choices(words, k=20)) for _ in range(30)] + ["same line of text here\n" * 30 for _ in range(30)] + ["short one"] * 40 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = R.judged(df).collect()
    code = {None: 2, 0: 0, 1: 1}
    votes = np.array([[code[r[f"vote_{n}"]] for n, _, _ in R.RULES] for r in got])
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = R.fit([(*[None if x == 2 else int(x) for x in r], int(c)) for r, c in zip(rows, counts, strict=True)])
    assert np.allclose(model.good(votes), [r.good for r in got], atol=1e-6)
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(300))) > 290 and not kept & set(range(300, 401))
    assert all(r.kept == (not r.base_failed and r.good >= R.KEEP_FROM) for r in got)


def sites(seed=11):
    """Three hosts with paths of their own quality, sparse ones among them, nulls, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(800)]
    good = lambda: " ".join(rng.choices(words, k=80))
    bad = lambda: " ".join(rng.choices(words[:5], k=60)) + " #### %%%" * 8
    middling = lambda: " ".join(rng.choices(words, k=40)) + " " + " ".join(rng.choices(words[:5], k=15)) + " ## %"
    rows = []
    for host, path, share, n in (("a", "x", 0.95, 120), ("a", "y", 0.9, 60), ("b", "x", 0.1, 120), ("b", "y", 0.05, 60), ("b", "z", 0.5, 2), ("c", None, 0.5, 40), (None, None, 0.5, 10)):
        for _ in range(n):
            rows.append((len(rows), good() if rng.random() < share else bad(), host, path))
    rows += [(len(rows), middling(), "a", "x"), (len(rows) + 1, None, "a", "y"), (5, rows[5][1], "a", "x"), (None, good(), "b", "x"), (len(rows) + 4, middling(), "b", "x")]
    return rows


def test_classifier_against_a_plain_version(spark):
    rows = sites()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, lang string, n long, host string").repartition(3)
    label = [(r[0], int("####" not in (r[1] or "####")), 0) for r in rows if r[0] is not None and r[0] % 2]
    labels = spark.createDataFrame([*label, (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.classified(docs, labels).collect()
    assert len(got) == len(rows)
    # The plain version: the same classifier, then sums over lists.
    names = [c.split()[0] for c in R.COUNTS.split(", ")]
    from math import log

    def features(text):
        v = dict(zip(names, R.text_counts(text or ""), strict=True)) | {"ln": log, "least": min, "greatest": max}
        return [eval(e, {"__builtins__": {}}, v) for e in Q.FEATURES.values()]

    known = {i: q for i, q, _ in label if zlib.crc32(str(i).encode()) % 4 != 2}
    w = Q.fit([(*features(t), known[i]) for i, t, _, _ in rows if i in known])
    own = [1 / (1 + np.exp(-(w[0] + np.dot(w[1:], features(t))))) for _, t, _, _ in rows]
    host = [r[2] or "" for r in rows]
    path = [(r[2] or "", r[3] or "") for r in rows]
    corpus = float(np.mean(own))

    def strength(keys, toward):
        groups = {k: [s for s, x in zip(own, keys, strict=True) if x == k] for k in set(keys)}
        spread = sum(len(g) * (np.mean(g) - toward[k]) ** 2 for k, g in groups.items())
        inside = sum(len(g) * toward[k] * (1 - toward[k]) for k, g in groups.items())
        sampled = sum(toward[k] * (1 - toward[k]) for k in groups)
        between = max(1e-6, (spread - sampled) / len(keys))
        return min(1e6, max(1.0, inside / len(keys) / between))

    sh = strength(host, dict.fromkeys(host, corpus))
    rate = {h: (sum(s for s, x in zip(own, host, strict=True) if x == h) + sh * corpus) / (host.count(h) + sh) for h in set(host)}
    sp = strength(path, {p: rate[p[0]] for p in path})
    odds = lambda p: np.log(p / (1 - p))
    want = []
    for i, (r, h, p) in enumerate(zip(rows, host, path, strict=True)):
        others = lambda keys, k: [s for j, (s, x) in enumerate(zip(own, keys, strict=True)) if x == k and j != i]  # noqa: B023, E731
        hr = (sum(others(host, h)) + sh * corpus) / (host.count(h) - 1 + sh)
        pr = (sum(others(path, p)) + sp * hr) / (path.count(p) - 1 + sp)
        want.append((r[0], own[i], hr, pr, 1 / (1 + np.exp(-(odds(min(max(own[i], 1e-6), 1 - 1e-6)) + odds(pr) - odds(corpus))))))
    by = lambda x: (x[0] is None, x[0] or 0, x[1])
    for a, b in zip(sorted(((g.doc_id, g.doc_score, g.host_rate, g.path_rate, g.score) for g in got), key=by), sorted(want, key=by), strict=True):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-6)


def test_sites_move_what_the_text_leaves_open(spark):
    rows = sites()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int("####" not in (r[1] or "####"))) for r in rows if r[0] is not None], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classified(docs, labels).collect()}
    middle = [r for r in got.values() if r.doc_id in (rows[-5][0], rows[-1][0])]
    good, bad = sorted(middle, key=lambda r: -r.path_rate)
    assert good.path_rate > 0.7 and bad.path_rate < 0.4 and good.score > bad.score
    # A path of two documents stays near its host.
    sparse = [r for r in got.values() if r.doc_id is not None and r.doc_id < len(rows) and rows[r.doc_id][2:] == ("b", "z")]
    assert all(abs(r.path_rate - r.host_rate) < 0.25 for r in sparse)


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame(sites(), "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.doc_score, 6) for r in Q.classified(docs, none).collect()} == {0.5}
    assert Q.classified(docs.limit(0), none).count() == 0
