"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its path and host are like.

A logistic classifier (fitted on a bounded sample of labelled rows) gives each document a probability. Grouped
sums of these probabilities over hosts and over paths give rates; a path's rate is shrunk towards its host's
and a host's towards the corpus's, by prior strengths that the spread between groups itself determines
(method of moments). A document's score adds its own log-odds and its path's, less the corpus's; its own
probability is taken out of its path's and host's sums first, so that no evidence counts twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, sized_broadcast
from .quality_rules import COUNTS, text_counts

#: Bound of the labelled rows that the classifier is fitted on.
MAX_LABELLED = 20_000
#: Group tables of up to so many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_GROUPS = 50_000
KEEP_FROM = 0.5
FEATURES = {
    "size": "ln(n_words + 1) / 8",
    "symbols": "least(n_symbols / greatest(n_words, 1), 1)",
    "symbol_chars": "least(10 * n_symbols / greatest(word_chars, 1), 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "least(word_chars / greatest(n_words, 1), 20) / 10",
    "letters": "n_letters / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def fit(rows: list[tuple]) -> np.ndarray:
    """Intercept and slopes of a ridge logistic regression; (features..., label) rows."""
    if not rows:
        return np.zeros(len(FEATURES) + 1)
    a = np.array(rows, float)
    x, y = np.hstack([np.ones((len(a), 1)), a[:, :-1]]), a[:, -1]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def strength(groups: DataFrame, toward: Column) -> float:
    """Prior strength, in documents, of ``groups`` (n, total) whose means scatter about ``toward``.

    Between-group variance is the spread of the means less what sampling alone would give; the strength is the variance
    within groups over it. Groups that don't differ beyond chance get a strength that leaves them no say.
    """
    mean = F.col("total") / F.col("n")
    gap, within = (mean - toward) ** 2, toward * (1 - toward)
    row = groups.agg(F.sum("n"), F.sum(F.col("n") * gap), F.sum(F.col("n") * within), F.sum(within)).first()
    total, spread, inside, sampled = (float(x or 0) for x in row)
    between = max(1e-6, (spread - sampled) / max(total, 1.0))
    return min(1e6, max(1.0, inside / max(total, 1.0) / between))


def shrunk(total: Column, n: Column, toward: Column, weight: float) -> Column:
    return (total + weight * toward) / (n + weight)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, doc_score, host_rate, path_rate, score, kept.

    The rates are those of the other documents of the host and path. A path is a ``path_col`` value within a host; nulls
    form a host or path of their own. A null text counts as empty; repeated rows count singly; a null id stays null.
    Without usable labels every doc_score is 0.5. An empty table gives an empty result.
    """
    keyed = docs.select(
        F.struct(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")).alias("key"),
        F.col(text_col).alias("text"),
    )
    base = materialize(counts_with_key(keyed).select("id", "host", "path", "n_words", *[F.expr(e).alias(c) for c, e in FEATURES.items()]))
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("label"))
    known = known.orderBy(F.xxhash64("id")).limit(MAX_LABELLED)
    # One row an id, however often rows repeat it: what is collected is bounded by MAX_LABELLED.
    learned = base.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct(*FEATURES, "label")).alias("r"))
    w = fit([tuple(r) for r in learned.orderBy("id").select("r.*").collect()])
    line = F.lit(float(w[0]))
    for c, x in zip(FEATURES, w[1:].tolist(), strict=True):
        line = line + F.col(c) * x
    scored = base.select("id", "host", "path", "n_words", (1 / (1 + F.exp(-line))).alias("doc_score"))
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("doc_score").alias("total")))
    corpus = paths.agg(F.sum("total") / F.sum("n")).first()[0]
    corpus = 0.5 if corpus is None else float(corpus)
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total")))
    for_hosts = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_total").alias("total")), F.lit(corpus))
    both = paths.join(hosts, "host")
    for_paths = strength(both, shrunk(F.col("host_total"), F.col("host_n"), F.lit(corpus), for_hosts))
    sites, _ = sized_broadcast(materialize(both), BROADCAST_GROUPS)
    own = F.col("doc_score")
    host_rate = shrunk(F.col("host_total") - own, F.col("host_n") - 1, F.lit(corpus), for_hosts)
    path_rate = shrunk(F.col("total") - own, F.col("n") - 1, F.col("host_rate"), for_paths)
    rated = scored.join(sites, ["host", "path"]).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    odds = logit(own) + logit(F.col("path_rate")) - logit(F.lit(corpus))
    out = rated.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("id").alias(id_col), "n_words", "doc_score", "host_rate", "path_rate", "score", (F.col("score") >= KEEP_FROM).alias("kept"))


def counts_with_key(keyed: DataFrame) -> DataFrame:
    """The counts of ``quality_rules`` for each text of ``keyed`` (key: id, host, path; text)."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    @F.pandas_udf("struct<" + ", ".join(c.replace(" ", ":") for c in COUNTS.split(", ")) + ">")
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t or "") for t in texts], columns=names)

    return keyed.select("key", counts("text").alias("c")).select("key.*", "c.*")
