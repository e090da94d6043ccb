"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document is the set of its distinct word shingles. Two documents link where 100 * intersection >= ``PERCENT`` * union.

- Equal sets are one node, named by 128 bits of the set. One hash a shingle is enough: it picks the bin and is the value there.
  An empty bin takes the value of the first filled bin in an order of its own, the same for every document, so that any bin of
  two documents agrees with probability of their similarity s, however short they are.
- ``BANDS`` bands of ``ROWS`` bins list each node. A pair of similarity s shares no bucket with probability
  (1 - s**ROWS)**BANDS: at 0.85 once in some 1.3 million pairs, above that less often.
- A bucket gives a star: edges from its smallest node to the others, one fewer than it has nodes. First each node is compared
  with the smallest centre that it has anywhere; then stars are drawn in those buckets only whose nodes aren't one component yet.
- Two ends of a star may link though neither links to the centre. So the buckets that still hold several components are cut into
  tiles by set size and component, and tiles that may link are compared on whole sets. No link inside a bucket is lost.

Every link is confirmed on whole shingle sets, which reach only tasks that compare them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components
from .near_copies import forest, shingles

SEED = 42
WORDS = 5
#: Least similarity of a link, in hundredths.
PERCENT = 85
BANDS = 24
ROWS = 5
BINS = BANDS * ROWS
#: Most sets and (about) most shingles of a tile.
TILE = 512
TILE_SHINGLES = 400_000

#: Where an empty bin looks for a value, in order.
PROBES = np.argsort(np.random.default_rng(SEED).random((BINS, BINS)), axis=1)


def signature(values: np.ndarray) -> np.ndarray:
    """The value of each bin; ``values`` are sorted, so that the first of a bin is its smallest."""
    at = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    bins, first = np.unique(at, return_index=True)
    low, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    low[bins], filled[bins] = values[first], True
    if len(bins) == BINS:
        return low
    source = PROBES[np.arange(BINS), filled[PROBES].argmax(axis=1)]
    return np.where(filled, low, low[source])


def bands(values: np.ndarray) -> list[int]:
    """One key a band, the band's number hashed in; none for an empty set."""
    import xxhash

    if not len(values):
        return []
    low = signature(values)
    return np.array([xxhash.xxh64_intdigest(low[ROWS * i : ROWS * (i + 1)].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def set_key(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def shared(sets: list[np.ndarray], other: np.ndarray) -> np.ndarray:
    """How many shingles of each set ``other`` has too; all are sorted."""
    every = np.concatenate(sets)
    hit = other[np.minimum(np.searchsorted(other, every), len(other) - 1)] == every
    ends = np.cumsum([len(s) for s in sets])
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, row (hash of the text), node, size and bands of each row; written."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t, words) for t in b["text"]]
            yield pd.DataFrame(
                {"id": b["id"].astype("Int64"), "row": b["row"], "node": [set_key(s) for s in found], "size": [len(s) for s in found], "bands": [bands(s) for s in found]}
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return materialize(rows.mapInPandas(read, "id long, row long, node binary, size long, bands array<long>"))


def row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, words: int, nodes: DataFrame) -> DataFrame:
    """node, shingles: the sets of ``nodes`` (node, id, row), read from one document each; written."""
    docs = df.select(F.col(id_col).cast("long").alias("d_id"), row_key(F.col(text_col)).alias("d_row"), F.col(text_col).alias("text"))
    picked = docs.join(nodes, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_row") == F.col("row")), "left_semi").select("text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t, words) for t in b["text"]]
            yield pd.DataFrame({"node": [set_key(s) for s in found], "shingles": [s.view(np.int64) for s in found]})

    return materialize(picked.mapInPandas(read, "node binary, shingles array<long>").dropDuplicates(["node"]))


def cut(n: Column, total: Column) -> Column:
    """In how many tiles ``n`` sets of ``total`` shingles go."""
    return F.greatest(F.ceil(n / TILE), F.ceil(total / TILE_SHINGLES), F.lit(1))


def confirmed_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): those of ``stars`` (center, node, size) that are links. A star is compared in slices; each has the centre's set once."""
    slices = stars.groupBy("center").agg(cut(F.count("*"), F.sum("size")).alias("slices"))
    ends = stars.join(slices, "center").select("center", F.pmod(F.xxhash64("node"), "slices").alias("slice"), "node")
    middles = slices.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.col("center").alias("node"))
    held = ends.unionAll(middles).join(sets, "node").groupBy("center", "slice").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, vs = [], []
            for center, members in zip(b["center"], b["members"], strict=True):
                center = bytes(center)
                found = {bytes(m["node"]): np.asarray(m["shingles"], np.int64).view(np.uint64) for m in members}
                mine = found.pop(center)
                if not found:
                    continue
                both = shared(list(found.values()), mine)
                sizes = np.array([len(s) for s in found.values()]) + len(mine)
                near = [k for k, yes in zip(found, (100 + percent) * both >= percent * sizes, strict=True) if yes]
                us += [center] * len(near)
                vs += near
            yield pd.DataFrame({"u": us, "v": vs})

    return held.mapInPandas(compare, "u binary, v binary")


def confirmed_tiles(listed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): a spanning set of the links between different components of each bucket; ``listed`` is (key, node, size, root).

    Sets link only if their sizes are at most one level (a factor 100 / percent) apart. A component of more than a tile in a level
    has tiles of its own, which are not compared with each other.
    """
    level = F.floor(F.log("size") / F.log(F.lit(100.0 / percent)) + 1e-9).alias("level")
    rows = listed.select("key", level, "node", "size", "root")
    by_root = rows.groupBy("key", "level", "root").agg(cut(F.count("*"), F.sum("size")).alias("own"), F.count("*").alias("n"), F.sum("size").alias("total"))
    small = by_root.where("own = 1").groupBy("key", "level").agg(cut(F.sum("n"), F.sum("total")).alias("parts"))
    named = by_root.join(small, ["key", "level"], "left").select("key", "level", "root", "own", "parts")
    large = F.when(F.col("own") > 1, F.col("root"))
    part = F.when(F.col("own") > 1, F.pmod(F.xxhash64("node"), "own")).otherwise(F.pmod(F.xxhash64("root"), "parts"))
    placed = rows.join(named, ["key", "level", "root"]).select("key", "level", large.alias("large"), F.xxhash64("level", large, part).alias("tile"), "node")
    tiles = materialize(placed)
    kinds = tiles.select("key", "level", "large", "tile").distinct()
    a = kinds.select("key", F.col("level").alias("a_level"), F.col("large").alias("a_large"), F.col("tile").alias("a"))
    b = kinds.select("key", F.col("level").alias("b_level"), F.col("large").alias("b_large"), F.col("tile").alias("b"))
    other = (F.col("a") < F.col("b")) & ~(F.col("a_large").isNotNull() & F.coalesce(F.col("a_large") == F.col("b_large"), F.lit(False)))
    within = (F.col("a") == F.col("b")) & F.col("a_large").isNull()
    pairs = a.join(b, "key").where((F.abs(F.col("a_level") - F.col("b_level")) <= 1) & (other | within)).select("key", "a", "b")
    members = tiles.join(sets, "node").groupBy("key", "tile").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
    members = materialize(members)
    left = pairs.join(members.select("key", F.col("tile").alias("a"), F.col("members").alias("x")), ["key", "a"])
    both = left.join(members.select("key", F.col("tile").alias("b"), F.col("members").alias("y")), ["key", "b"]).select("a", "b", "x", "y")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [], []
            for p, q, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
                every = [*x, *(y if p != q else [])]
                i, j = forest([np.asarray(m["shingles"], np.int64) for m in every], percent / 10)
                us += [bytes(every[k]["node"]) for k in i]
                vs += [bytes(every[k]["node"]) for k in j]
            yield pd.DataFrame({"u": us, "v": vs})

    return both.mapInPandas(compare, "u binary, v binary")


def unsettled(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, size, root of the buckets that hold more than one component; written."""
    rooted = listed.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted)
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return materialize(rooted.join(several, "key"))


def component_roots(df: DataFrame, prints: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that link to others."""
    nodes = materialize(prints.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(F.struct("id", "row")).alias("at")))
    every = nodes.select("node", "size", F.explode("bands").alias("key"))
    heads = every.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1").select("key", "center")
    listed = materialize(every.join(heads, "key").select("key", "center", "node", "size"))
    met = nodes.join(listed.select("node").distinct(), "node", "left_semi").select("at.id", "at.row")
    sets = shingle_sets(df, id_col, text_col, words, met)
    first = listed.groupBy("node", "size").agg(F.min("center").alias("center")).where("node <> center")
    links = materialize(confirmed_stars(first, sets, percent))
    roots = components(links)
    for confirm in (
        lambda open_: confirmed_stars(open_stars(open_), sets, percent),
        lambda open_: confirmed_tiles(open_, sets, percent),
    ):
        open_ = unsettled(listed.select("key", "node", "size"), roots)
        if open_.isEmpty():
            break
        more = materialize(confirm(open_))
        links = links.unionAll(more)
        roots = components(links)
    return roots


def open_stars(open_: DataFrame) -> DataFrame:
    """center, node, size: a star a bucket, without the ends that are in the centre's component."""
    heads = open_.groupBy("key").agg(F.min(F.struct("node", "root")).alias("head")).select("key", F.col("head.node").alias("center"), F.col("head.root").alias("c_root"))
    return open_.join(heads, "key").where("root <> c_root").select("center", "node", "size").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_shingles (size of its set), component_id, kept.

    component_id is the smallest id that links reach, the row's own included; kept is true for rows that have it as their own. Texts
    are lower-cased A to Z; a text of fewer words than a shingle is one shingle. A null or empty text, or one without words, links
    with nothing. Rows that repeat an id and text share a component and are kept or dropped together; an id that recurs with another
    text counts in each component by itself. A row with a null id gets its component's smallest id; if no row there has one, it is
    null, and these rows are kept. An empty table gives an empty result; further columns are not read.
    """
    prints = fingerprints(df, id_col, text_col, words)
    roots = component_roots(df, prints, id_col, text_col, words, percent)
    named = prints.where("size > 0").groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "id")
    lowest = named.groupBy("root").agg(F.min("id").alias("lowest"))
    told = materialize(named.join(lowest, "root").select("node", "lowest"))
    found = prints.select("id", "node", "size").join(told, "node", "left")
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("lowest"))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(``id_col``) of the documents that stay: one id a component. Rows without an id are not among them."""
    return near_duplicates(df, id_col, text_col, words, percent).where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
