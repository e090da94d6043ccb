"""Quality by weak supervision: rules vote or abstain, and their accuracies are learned without labels.

Each rule reads the same per-document counts and votes good, bad or abstains. Votes are grouped into patterns
(3 ** rules at most, whatever the number of documents); expectation-maximisation over that small table fits a
mixture of good documents and, for each rule, one kind of junk: the kind that this rule exists to see. A kind's
documents never get a good vote from its own rule; how the other rules vote on it, how often each rule is wrong
about good documents, and how common each kind is, are estimated. So the commonest junk doesn't alone define what
"bad" is, as it would with a single bad class. An abstention says nothing. A document's posterior probability of
being good replaces the demand that all rules pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
ROUNDS = 200
#: A document stays if its posterior probability of being good is at least this.
KEEP_FROM = 0.5
#: Prior of the rates, in documents: it steadies what few documents tell and is outweighed by many.
PRIOR_WEIGHT = 20.0
#: Prior rate of a bad vote, among votes, on a good document and on junk of another kind.
PRIOR_FALSE = 0.005
PRIOR_OTHER = 0.1
#: Rate of good votes of a rule on its own kind of junk.
OWN_MISS = 0.001
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_letters long"
#: (name, bad if, good if): neither means that the rule abstains.
RULES = (
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "n_repeat_words = 0"),
    ("length", "n_words < 20", "n_words >= 50"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("variety", "n_words >= 50 AND n_distinct < 0.2 * n_words", "n_words >= 50 AND n_distinct >= 0.3 * n_words"),
    ("letters", "n_letters < 0.7 * word_chars", "n_letters >= 0.85 * word_chars"),
)


def repeat_words(words: list[bytes], size: int = 8) -> int:
    """Words in windows of ``size`` words that the text holds twice or more, first included."""
    n = len(words)
    if n <= size or len(number := {w: i for i, w in enumerate(dict.fromkeys(words))}) == n:
        return 0
    codes = np.fromiter((number[w] for w in words), np.int64, n)
    span = 1
    while span < size:  # a window's code is the rank of the pair of its halves
        pair = codes[:-span] * (codes.max() + 1) + codes[span:]
        codes = np.unique(pair, return_inverse=True)[1]
        span *= 2
    twice = (np.bincount(codes) > 1)[codes]
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    digits = sum(text.count(c) for c in "0123456789")
    marks = sum(text.count(c) for c in "!\"'(),-./:;=?@[]_{}~+\\^`" + SYMBOLS)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), len(set(words)), chars - digits - marks


def counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [text_counts(t or "") for t in b["text"]]
            yield pd.DataFrame({"id": b["id"].astype("Int64")} | {c: [r[i] for r in rows] for i, c in enumerate(names)})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, " + COUNTS)


def votes(rules=RULES) -> list:
    return [F.when(F.expr(bad), 0).when(F.expr(good), 1).alias(f"vote_{name}") for name, bad, good in rules]


@dataclass
class Model:
    """Shares of the classes (good first, then one kind of junk a rule) and each class's rates of bad votes, by rule."""

    share: np.ndarray
    bad: np.ndarray

    def accuracies(self) -> np.ndarray:
        """(rules, 2): how often each rule's vote is right on good documents and, of the votes it casts there, on junk."""
        junk = self.share[1:] / max(self.share[1:].sum(), 1e-300)
        return np.stack([1 - self.bad[0], junk @ self.bad[1:]], axis=1)

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """(rows, classes): log share and likelihood of each row of votes (0 bad, 1 good, 2 abstains)."""
        return np.log(self.share) + (votes == 0) @ np.log(self.bad).T + (votes == 1) @ np.log1p(-self.bad).T

    def good(self, votes: np.ndarray) -> np.ndarray:
        x = self.log_joint(votes)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x[:, 0] / x.sum(axis=1)


def fit(patterns: list[tuple], rounds: int = ROUNDS) -> Model:
    """The model of (votes..., count) rows by expectation-maximisation; without rows it is the prior."""
    rules = len(patterns[0]) - 1 if patterns else len(RULES)
    v = np.array([[2 if x is None else x for x in p[:-1]] for p in patterns]).reshape(-1, rules)
    n = np.array([p[-1] for p in patterns], float)
    prior = np.full((rules + 1, rules), PRIOR_OTHER)
    prior[0] = PRIOR_FALSE
    own = np.concatenate([np.zeros((1, rules), bool), np.eye(rules, dtype=bool)])
    prior[own] = 1 - OWN_MISS
    # The first shares are those of the bad votes: a kind starts as common as its rule's bad votes are.
    first = np.concatenate([[n.sum()], ((v == 0) * n[:, None]).sum(axis=0)]) + 1.0
    model = Model(first / first.sum(), prior.copy())
    for _ in range(rounds):
        x = model.log_joint(v)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        member = n[:, None] * x / x.sum(axis=1, keepdims=True)
        bad, voted = member.T @ (v == 0) + PRIOR_WEIGHT * prior, member.T @ (v != 2) + PRIOR_WEIGHT
        rate = np.where(own, prior, np.clip(bad / voted, 1e-6, 1 - 1e-6))
        share = (member.sum(axis=0) + 1) / (n.sum() + rules + 1)
        moved = max(np.abs(rate - model.bad).max(), np.abs(share - model.share).max())
        model = Model(share, rate)
        if moved < 1e-9:
            break
    return model


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``df``: ``id_col``, the base counts, base_failed, kept, good (posterior probability).

    All documents take part in the fit. A null text counts as empty, fails the base rule and isn't kept; repeated rows
    count singly; a null id stays null. An empty table gives an empty result.
    """
    base = materialize(counted(df, id_col, text_col))
    cast = votes(rules)
    names = [f"vote_{name}" for name, _, _ in rules]
    patterns = [tuple(p) for p in base.groupBy(*cast).count().collect()]  # at most 3 ** rules rows
    model = fit(patterns) if patterns else fit([(*[None] * len(rules), 0)])
    # One sum of log rates for each class: a column expression over the votes.
    lines = []
    for share, rates in zip(model.share.tolist(), model.bad.tolist(), strict=True):
        line = F.lit(math.log(share))
        for name, r in zip(names, rates, strict=True):
            line = line + F.when(F.col(name) == 0, math.log(r)).when(F.col(name) == 1, math.log1p(-r)).otherwise(0.0)
        lines.append(line)
    good = 1 / reduce(add, [F.exp(F.least(x - F.col("class_0"), F.lit(700.0))) for x in map(F.col, [f"class_{i}" for i in range(len(lines))])])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = base.select("*", *cast).select("*", failed.alias("base_failed"), *[x.alias(f"class_{i}") for i, x in enumerate(lines)]).withColumn("good", good)
    kept = ~F.col("base_failed") & (F.col("good") >= KEEP_FROM)
    return scored.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "good", *names)
