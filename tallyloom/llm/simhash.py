"""SimHash near-duplicates: exact comparison of fingerprints, tile against tile.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles. Two of them link when they differ
in at most ``radius`` bits. To find every link:

- copies of a fingerprint are one node; a component's smallest document is looked up at the end;
- fingerprints that differ in at most r bits agree in at least one of r + 1 bit ranges, so each is listed
  under its value in each range (a bucket). This loses no link and keeps comparisons near-linear;
- a bucket is cut into tiles of about ``TILE`` fingerprints, by population count where it holds more than one
  tile. Tile pairs whose population counts differ by more than the radius are skipped by the join's
  condition; each remaining pair is one numpy exclusive-or with bit counts;
- a tile pair returns a spanning forest of its links, fewer rows than fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize
from .graph import components

SEED = 42
BITS = 64
TILE = 512


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's shingles; 0 for a text without words."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hash_of, joined = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= words:
        return hash_of(joined, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)], ">u8")
    # 64 counts of up to 2**31 shingles; summed in slices, so that the bits of a very long text are never all unpacked.
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[s : s + 4096].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str, words: int, *carried: str) -> DataFrame:
    """``carried`` columns and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return df.select(*carried, fp(F.col(text_col)).alias("fp"))


def ranges(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of radius + 1 bit ranges that cover a fingerprint."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a + b of a spanning forest of the links between ``a`` and ``b``, or within ``a`` if ``b`` is ``a``."""
    same = b is a
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if same:
        np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return rows, rows
    cols = np.flatnonzero(near.any(axis=0))
    shift = 0 if same else len(a)
    new_a, new_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    new_a[rows], new_b[cols] = True, True
    left, right = [], []
    for r in rows.tolist():
        if not new_a[r]:
            continue
        new_a[r] = False
        if same:
            new_b[r] = False
        edge = [(0, r)]
        while edge:
            side, x = edge.pop()
            line, new = (near[x], new_b) if side == 0 else (near[:, x], new_a)
            found = np.flatnonzero(line & new)
            if not len(found):
                continue
            new[found] = False
            if same:
                new_a[found] = new_b[found] = False
            left.append(np.full(len(found), x + shift * (side == 1)))
            right.append(found + shift * (side == 0))
            edge += [(0 if same else 1 - side, y) for y in found.tolist()]
    return (np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])


def tiles(nodes: DataFrame, radius: int) -> DataFrame:
    """band, value, low, high (population counts), tile, members (fp, node): the buckets with more than one fingerprint, cut."""
    listed = nodes.select(
        "fp",
        "node",
        F.bit_count("fp").alias("ones"),
        F.posexplode(F.array(*[F.expr(f"shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L") for low, width in ranges(radius)])).alias("band", "value"),
    )
    sizes = listed.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    # At most 65 rows a bucket meet here, however many fingerprints it has.
    bucket = Window.partitionBy("band", "value")
    sizes = sizes.withColumn("total", F.sum("n").over(bucket)).where("total > 1")
    cut = listed.join(sizes, ["band", "value", "ones"]).select(
        "band",
        "value",
        F.when(F.col("total") > TILE, F.col("ones")).alias("level"),
        F.when(F.col("total") > TILE, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE))).otherwise(0).alias("slice"),
        "ones",
        F.struct("fp", "node").alias("member"),
    )
    return cut.groupBy("band", "value", "level", "slice").agg(
        F.min("ones").alias("low"), F.max("ones").alias("high"), F.collect_list("member").alias("members")
    )


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v): a spanning set of the links between ``nodes`` (fp, node), all of them found."""
    made = materialize(tiles(nodes, radius).withColumn("tile", F.xxhash64("level", "slice")))
    a = made.select("band", "value", *[F.col(c).alias(f"a_{c}") for c in ("low", "high", "tile", "members")])
    b = made.select("band", "value", *[F.col(c).alias(f"b_{c}") for c in ("low", "high", "tile", "members")])
    apart = (F.col("b_low") - F.col("a_high") <= radius) & (F.col("a_low") - F.col("b_high") <= radius)
    pairs = a.join(b, ["band", "value"]).where(apart & (F.col("a_tile") < F.col("b_tile"))).select("a_members", "b_members")
    pairs = pairs.unionAll(made.where(F.size("members") > 1).select("members", F.lit(None)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(batch["a_members"], batch["b_members"], strict=True):
                fp = np.array([m["fp"] for m in x], np.int64).view(np.uint64)
                node = np.array([m["node"] for m in x], np.int64)
                if y is None:
                    i, j = forest(fp, fp, radius)
                else:
                    i, j = forest(fp, np.array([m["fp"] for m in y], np.int64).view(np.uint64), radius)
                    node = np.concatenate([node, np.array([m["node"] for m in y], np.int64)])
                us.append(node[i])
                vs.append(node[j])
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return pairs.mapInPandas(compare, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``df``: ``id_col``, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links reach, the row's own included. A null or empty text has
    fingerprint zero and links like any other. Rows with a null id get their component's smallest id, null
    if no member has one. Equal texts, and rows that repeat an id, share a component.
    """
    found = placed(df.select(F.col(id_col).alias("id"), text_col), text_col, words, radius, "id")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def placed(df: DataFrame, text_col: str, words: int, radius: int, *carried: str) -> DataFrame:
    """``carried`` columns (id among them), fp and component_id of each row of ``df``."""
    prints = materialize(fingerprints(df, text_col, words, *carried))
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(links(nodes.select("fp", F.col("fp").alias("node")), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return prints.join(materialize(rooted.join(lowest, "root").select("fp", "component_id")), "fp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``df`` that stay: of each component those with its smallest id (rows with a null id stay where none has an id).

    An id that recurs with other texts counts in each component by itself; rows that repeat an id and text stay or go together.
    Null and empty texts are one component. An empty table gives an empty result.
    """
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = placed(df.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text")), "text", words, radius, "id", "row")
    mine, hashed, lost = free_name(df.columns, "id"), free_name(df.columns, "row"), free_name(df.columns, "lost")
    drop = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(mine), F.col("row").alias(hashed), F.lit(True).alias(lost)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(mine)) & (row == F.col(hashed))
    return df.join(drop, same, "left").where(F.col(lost).isNull()).select(*df.columns)
