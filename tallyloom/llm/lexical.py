"""Ranked lexical search by hashed max-sketches: upper bounds for a whole batch of queries, then exact scores in descending order.

The index has one row a document: its terms with their frequencies, and a sketch of ``coordinates`` bytes. A term's impact grows with its
frequency and depends on nothing else but the document's length, so a coordinate keeps the largest frequency among the terms that
hash to it: the largest impact follows once the corpus totals are known, and the index needs one pass. 255 stands for 255 or more.

A search looks the queries' terms up in the sketches, one matrix product for a batch of documents and a block of queries. That bounds
each document's score from above. A task rescores the documents of a query in descending order of their bounds and stops where a bound
is below the k-th best exact score that it has found. Each task returns its k best per query; the k best of these are the result.
Terms are told apart by XXH64 (64 bits).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast

SEED = 42
K = 10
COORDINATES = 1024
FULL = 255
#: Documents that are bounded at once.
BATCH = 128
#: About how many queries and terms of queries a block has; each block is one pass over the index.
BLOCK_ITEMS = 1024
BLOCK_TERMS = 32_768
#: Terms of queries that are broadcast to be counted; beyond it they are joined by shuffle.
MAX_BROADCAST = 500_000

#: Bytes of a term stay, A-Z in lower case; all else becomes a blank. Bytes of longer UTF-8 sequences are from 0x80 on.
BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_numbers: dict[bytes, int] = {}


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BLANKED).split(b" ") if text else []


def counted(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms, the distinct ones as signed hashes, and how often each occurs."""
    import xxhash

    tf = Counter(terms_of(text))
    tf.pop(b"", None)
    if len(_numbers) > 1_000_000:
        _numbers.clear()
    for t in tf:
        if t not in _numbers:
            _numbers[t] = xxhash.xxh64_intdigest(t, SEED)
    terms = np.fromiter((_numbers[t] for t in tf), np.uint64, len(tf)).view(np.int64)
    return tf.total(), terms, np.fromiter(tf.values(), np.int64, len(tf))


def sketch(terms: np.ndarray, tf: np.ndarray, coordinates: int = COORDINATES) -> bytes:
    tops = np.zeros(coordinates, np.uint8)
    np.maximum.at(tops, terms % coordinates, np.minimum(tf, FULL).astype(np.uint8))
    return tops.tobytes()


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES) -> DataFrame:
    """One row per row of ``df``: doc, n (terms with repeats), sketch, terms, tfs; written. A null text has no terms."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in batches:
            for s in range(0, len(every), 1000):
                b = every.iloc[s : s + 1000]
                found = [counted(t) for t in b["text"]]
                yield pd.DataFrame(
                    {"doc": b["doc"].astype("Int64"), "n": [f[0] for f in found], "sketch": [sketch(*f[1:], coordinates) for f in found], "terms": [f[1] for f in found], "tfs": [f[2] for f in found]}
                )

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return materialize(rows.mapInPandas(read, "doc long, n long, sketch binary, terms array<long>, tfs array<long>"))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, item, term, times: the terms of each item; written. Rows equal in id and text are one item."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counted(t)[1:] for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "item": b["item"], "terms": [f[0] for f in found], "times": [f[1] for f in found]})

    rows = items.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).alias("item"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    kind = rows.schema["item"].dataType.simpleString()
    read_rows = rows.mapInPandas(read, f"key long, item {kind}, terms array<long>, times array<long>")
    return materialize(read_rows.select("key", "item", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("key", "item", F.col("x.terms").alias("term"), F.col("x.times").alias("times")))


def with_frequencies(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """``asked`` with df, how many documents hold the term; terms that none holds are gone; written."""
    known, _ = sized_broadcast(materialize(asked.select("term").distinct()), MAX_BROADCAST)
    df = indexed.select(F.explode("terms").alias("term")).join(known, "term").groupBy("term").agg(F.count("*").alias("df"))
    return materialize(asked.join(df, "term"))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Block:
    """A block of queries: which terms each has, with weight times count; built in the driver, unfolded in a task."""

    def __init__(self, rows: pd.DataFrame, documents: int, words: int, k: int, batch: int):
        self.documents, self.words, self.k, self.batch = documents, words, k, batch
        self.keys, which = np.unique(rows["key"].to_numpy(np.int64), return_inverse=True)
        self.vocabulary, column = np.unique(rows["term"].to_numpy(np.int64), return_inverse=True)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in rows["df"].tolist()], np.float64) * rows["times"].to_numpy(np.float64)
        self.which, self.column, self.weight = which, column, weight

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        order = np.argsort(self.which, kind="stable")
        cuts = np.cumsum(np.bincount(self.which, minlength=len(self.keys)))[:-1]
        columns, weights = np.split(self.column[order], cuts), np.split(self.weight[order], cuts)
        best: list[list[tuple]] = [[] for _ in self.keys]
        floor = np.ones(len(self.keys))
        for every in batches:
            if lookup is None and every.num_rows:
                coordinates = len(every.column(2)[0].as_py())
                lookup = np.zeros((coordinates, len(self.keys)))
                np.add.at(lookup, (self.vocabulary[self.column] % coordinates, self.which), self.weight)
            for s in range(0, every.num_rows, self.batch):
                self.rescore(every.slice(s, self.batch), lookup, columns, weights, best, floor)
        found = [(int(key), -score, None if none else doc) for key, mine in zip(self.keys, best, strict=True) for score, none, doc in mine]
        kinds = (pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["key", "score", "doc_id"])

    def rescore(self, b: pa.RecordBatch, lookup: np.ndarray, columns: list, weights: list, best: list, floor: np.ndarray) -> None:
        docs = b.column(0).to_pylist()
        m = np.array([25 + 75 * n * self.documents // self.words for n in b.column(1).to_pylist()], np.int64)
        tops = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(docs), -1).astype(np.int64)
        # No frequency gives an impact of more than a million.
        bounds = np.where(tops == FULL, 1_000_000, impact(tops, m[:, None])).astype(np.float64) @ lookup
        open_ = np.flatnonzero((bounds >= floor).any(axis=0))
        if not len(open_):
            return
        lists = b.column(3)
        row = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy())
        terms, tf = lists.flatten().to_numpy(), b.column(4).flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == terms
        exact = np.zeros((len(docs), len(self.vocabulary)))
        exact[row[hit], at[hit]] = impact(tf[hit], m[row[hit]])
        for q in open_.tolist():
            line = bounds[:, q]
            down = np.argsort(-line, kind="stable")
            down = down[line[down] >= floor[q]]
            s, step = 0, self.k
            while s < len(down) and line[down[s]] >= floor[q]:
                some = down[s : s + step]
                scores = exact[np.ix_(some, columns[q])] @ weights[q]
                mine = best[q] + [(-int(x), docs[d] is None, docs[d] or 0) for d, x in zip(some.tolist(), scores.tolist(), strict=True) if x >= floor[q]]
                best[q] = sorted(mine)[: self.k]
                if len(best[q]) == self.k:
                    floor[q] = -best[q][-1][0]
                s, step = s + step, 2 * step


def search(indexed: DataFrame, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``id_col``, rank (from 1), doc_id, score: for each item the ``k`` documents of an index that score highest, above 0.

    Equal scores go by ascending id, a null id last. Rows that repeat an id are documents of their own. An item without terms, or
    whose terms no document holds, has no rows; nor has any where a table is empty. Items equal in id and text are one; an id that recurs
    with another text has a ranking for each.
    """
    spark = indexed.sparkSession
    documents, words = indexed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = query_terms(items, id_col, text_col)
    weighed = with_frequencies(asked, indexed)
    terms, many = weighed.agg(F.count("*"), F.count_distinct("key")).first()
    blocks = max(1, -(-terms // BLOCK_TERMS), -(-many // BLOCK_ITEMS))
    found = spark.createDataFrame([], "key long, score long, doc_id long")
    for n in range(blocks if terms else 0):
        rows = weighed.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == n).select("key", "term", "times", "df").toPandas()
        if len(rows):
            block = Block(rows, documents, words, k, BATCH)
            found = found.unionAll(indexed.select("doc", "n", "sketch", "terms", "tfs").mapInArrow(block.search, "key long, score long, doc_id long"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    named = asked.groupBy("key").agg(F.first("item").alias(id_col))
    return ranked.join(named, "key").select(id_col, "rank", "doc_id", "score")
