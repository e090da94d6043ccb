"""Near copies: texts whose SimHash fingerprints differ in few bits, and those that share most of their word shingles.

Fingerprints are compared exactly (``simhash``). They alone can't serve: texts that share 0.8 of their shingles differ in some ten
bits, and bit ranges narrow enough for that radius compare nearly everything with everything. So links by the Jaccard similarity of
the shingle sets, each confirmed on the sets themselves, join those by fingerprint:

- equal shingle sets are one node;
- ``BANDS`` bands of ``ROWS`` MinHash values list each node. A pair of similarity s shares a band with probability
  1 - (1 - s**ROWS)**BANDS: at 0.8 it is missed once in some 38,000 pairs, above that less often;
- buckets with the same members are compared once, large ones are cut into tiles, and each tile or pair of tiles
  counts the shared shingles of its sets. It returns a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import free_name, materialize
from .graph import components

SEED = 42
WORDS = 5
#: Least similarity of a link, in tenths.
TENTHS = 8
BANDS = 20
ROWS = 4
#: Most bits in which linked fingerprints differ.
RADIUS = 2
#: Most sets and (about) most shingles of a tile.
TILE = 512
TILE_SHINGLES = 400_000

_rng = np.random.default_rng(SEED)
FLIPS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
ODDS = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the text's shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hash_of, joined = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= words:
        return np.array([hash_of(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.unique(np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)], np.uint64))


def bands(values: np.ndarray) -> list[int]:
    """One key a band: the hash of the band's number and its smallest values."""
    import xxhash

    if not len(values):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(values), 4096):
        x = (values[None, s : s + 4096] ^ FLIPS) * ODDS
        low = np.minimum(low, x.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(low[ROWS * i : ROWS * (i + 1)].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def set_key(values: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(values.tobytes())], np.uint64).view(np.int64)[0])


def forest(sets: list[np.ndarray], tenths: int = TENTHS) -> tuple[list[int], list[int]]:
    """Positions of a spanning forest of the links between ``sets``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)[np.argsort(code, kind="stable")]
    many = np.bincount(code)
    begin = np.cumsum(many) - many
    mine = np.split(code, np.cumsum(sizes)[:-1])
    new = np.ones(m, bool)
    left: list[int] = []
    right: list[int] = []
    for r in range(m):
        if not new[r]:
            continue
        new[r] = False
        edge = [r]
        while edge and new.any():
            x = edge.pop()
            n = many[mine[x]]
            at = np.repeat(begin[mine[x]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=m)
            found = np.flatnonzero(new & ((10 + tenths) * shared >= tenths * (sizes + sizes[x]))).tolist()
            new[found] = False
            left += [x] * len(found)
            right += found
            edge += found
    return left, right


def links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v): a spanning set of the links between the nodes of ``prints`` (node, size, bands), whose ``texts`` are (node, text)."""
    listed = prints.dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("key"))
    listed = materialize(listed)
    sizes = listed.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"),
    )
    sizes = sizes.where("n > 1").groupBy("n", "total", "low", "high", "same").agg(F.min("key").alias("key"))
    slices = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("total") / TILE_SHINGLES))
    members = materialize(
        listed.join(sizes.select("key", slices.alias("slices")), "key").select("key", F.pmod(F.xxhash64("node"), "slices").alias("slice"), "node")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "shingles": [shingles(t).view(np.int64) for t in b["text"]]})

    needed = texts.join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(needed.mapInPandas(read, "node long, shingles array<long>").dropDuplicates(["node"]))
    tiles = members.join(sets, "node").groupBy("key", "slice").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
    tiles = materialize(tiles)
    a = tiles.select("key", F.col("slice").alias("a_slice"), F.col("members").alias("a_members"))
    b = tiles.select("key", F.col("slice").alias("b_slice"), F.col("members").alias("b_members"))
    pairs = a.join(b, "key").where("a_slice < b_slice").select("a_members", "b_members")
    pairs = pairs.unionAll(tiles.where(F.size("members") > 1).select("members", F.lit(None)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [], []
            for x, y in zip(batch["a_members"], batch["b_members"], strict=True):
                both = [*x, *(y if y is not None else [])]
                i, j = forest([np.asarray(m["shingles"], np.int64) for m in both])
                us += [both[k]["node"] for k in i]
                vs += [both[k]["node"] for k in j]
            yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return pairs.mapInPandas(compare, "u long, v long")


def print_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): a spanning set of the links between the nodes of ``prints`` (fp, node) by fingerprint.

    A fingerprint is led by the smallest of its nodes: the others link to it, and leaders link where their fingerprints do.
    """
    pairs = prints.distinct()
    leaders = materialize(pairs.groupBy("fp").agg(F.min("node").alias("node")))
    same = pairs.join(leaders.select("fp", F.col("node").alias("v")), "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    return same.unionAll(simhash.links(leaders, radius))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component of near copies the row with its smallest id, a null id last.

    Texts link whose fingerprints (majority bits of three-word shingles) differ in two bits or fewer, and those whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more; texts without words link with each other. Rows count singly, also where they repeat an id; rows equal in id and text stay or go together.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "id": b["id"].astype("Int64"), "row": b["row"], "node": [set_key(s) for s in found], "size": [len(s) for s in found], "bands": [bands(s) for s in found],
                    "fp": np.array([simhash.fingerprint(t) for t in b["text"]], np.uint64).view(np.int64),
                }
            )

    def key(text):
        return F.xxhash64(F.coalesce(text, F.lit("")))

    rows = df.select(F.col(id_col).cast("long").alias("id"), key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    prints = materialize(rows.mapInPandas(read, "id long, row long, node long, size long, bands array<long>, fp long"))
    named = prints.select("row", "node").distinct()
    roots = components(links(rows.join(named, "row").select("node", "text"), prints).unionAll(print_links(prints.select("fp", "node"))))
    placed = prints.join(roots, "node", "left").select("id", "row", F.coalesce("root", "node").alias("root"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    stay = first.select("first.id", "first.row")
    mine, hashed = free_name(df.columns, "id"), free_name([*df.columns, "__id"], "row")
    stay = stay.select(F.col("id").alias(mine), F.col("row").alias(hashed))
    return df.join(stay, F.col(id_col).eqNullSafe(F.col(mine)) & (key(F.col(text_col)) == F.col(hashed)), "left_semi")
