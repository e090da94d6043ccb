"""Exact de-duplication with a heavy-hitter split, in DataFrame operations only.

1. A frequent-items sketch (Spark's ``approx_top_k`` family, a mergeable Misra-Gries summary with a
   fixed number of counters) finds digests that many rows may share. Sketches merge in two levels,
   so that no task takes in one sketch for each input partition of a large corpus.
2. The candidates, at most ``max_heavy`` digests, are verified by an exact count. Each one's winner
   is a row of a table of at most ``max_heavy`` rows, which is broadcast: losing copies are marked
   on the map side and never shuffled by digest.
3. Every other row, and the rows that may be a winner, are ranked within their digest after one
   ordinary shuffle. No group there is larger than the sketch's error, about rows / ``max_heavy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

#: Counters of the sketch and most digests taken as heavy.
MAX_HEAVY = 1024
#: Sketches of the first level.
SKETCHES = 64
#: A digest with fewer copies isn't worth a broadcast row.
MIN_COPIES = 16


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def heavy_candidates(digests: DataFrame, column: str, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """Digests that may be frequent (one column, at most ``max_heavy`` rows); holds every one with over rows / ``max_heavy`` copies."""
    counters = 2 * max_heavy
    parts = digests.groupBy((F.spark_partition_id() % SKETCHES).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(`{column}`, {counters})").alias("sketch")
    )
    # Grouped by a constant, not global: an empty partition of a global aggregate holds an empty sketch, which Spark can't merge.
    top = parts.groupBy((F.col("part") < 0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {counters}), {max_heavy})").alias("top"))
    return top.select(F.explode("top").alias("top")).where(F.col("top.count") >= MIN_COPIES).select(F.col("top.item").alias(column))


def ranked_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY, carry: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256; with ``carry``, every column of ``df`` besides.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id
    stays; a null id is smaller than any other, and of rows that repeat an id and text one stays.
    With ``carry`` the added columns have free names, returned in this order after ``df``'s own.
    """
    names = [free_name(df.columns, n) for n in ("keep_id", "group_size", "kept", "sha")] if carry else ["keep_id", "group_size", "kept", "text_sha256"]
    keep, size, kept, sha = names
    rows = df.withColumn(sha, digest(F.col(text_col))) if carry else df.select(id_col, digest(F.col(text_col)).alias(sha))
    light = materialize(df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("sha")))
    if not carry:
        rows = light.select(F.col("id").alias(id_col), F.col("sha").alias(sha))
    candidates = heavy_candidates(light.select("sha"), "sha", max_heavy)
    winner, copies, mark = (free_name([*df.columns, *names], n) for n in ("winner", "copies", "mark"))
    winners = materialize(
        light.join(F.broadcast(candidates), "sha").groupBy("sha").agg(F.max("id").alias(winner), F.count("*").alias(copies)).where(F.col(copies) >= MIN_COPIES)
    ).withColumnRenamed("sha", mark)
    split = rows.join(F.broadcast(winners), F.col(sha) == F.col(mark), "left")
    lost = F.col(mark).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(winner))
    columns = df.columns if carry else [id_col]
    removed = split.where(lost).select(*columns, F.col(winner).alias(keep), F.col(copies).alias(size), F.lit(False).alias(kept), sha)
    group = Window.partitionBy(sha)
    ranked = split.where(~lost).withColumns(
        {
            kept: F.row_number().over(group.orderBy(F.col(id_col).desc_nulls_last())) == 1,
            keep: F.max(id_col).over(group),
            size: F.coalesce(F.col(copies), F.count("*").over(group)),
        }
    )
    return ranked.select(*columns, *names).unionAll(removed.select(*columns, *names))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group of equal texts, with the columns of ``df``: the largest id's, null texts as empty ones.

    Of rows that repeat an id and text one stays; a null id stays only where no row of its group has an id. An empty table
    gives an empty result.
    """
    ranked = ranked_copies(df, id_col, text_col, carry=True)
    return ranked.where(F.col(ranked.columns[-2])).select(*df.columns)
