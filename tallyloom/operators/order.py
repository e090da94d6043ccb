"""Orders of a result view. Places are numbered over range-partitioned rows: no task sorts a whole library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.store import written


def order_of(mode: str) -> list[Column]:
    """The sort of a mode; a missing score counts as -1, missing tokens as 0, names sort as in a dictionary; ids break ties."""
    score, tokens = F.coalesce("score", F.lit(-1.0)), F.coalesce("tokens", F.lit(0))
    orders = {"score_asc": score.asc(), "score_desc": score.desc(), "tokens_asc": tokens.asc(), "tokens_desc": tokens.desc(), "name": F.collate("name", "UNICODE").asc()}
    return [orders[mode], F.col("id").asc()]


def sorted_cards(summary: DataFrame, mode: str) -> DataFrame:
    return summary.orderBy(*order_of(mode))


def placed(rows: DataFrame, order: list[Column], place: str) -> DataFrame:
    """``rows`` with their place (from 1) in the whole table under ``order``.

    Rows are sorted by ranges and numbered within each; the counts of the ranges before, one row a range, complete the number.
    """
    local = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    block = F.shiftright("__at", 33)
    sizes = local.groupBy(block.alias("__block")).agg(F.count("*").alias("__n"))
    before = sizes.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = local.withColumn("__block", block).join(F.broadcast(before), "__block")
    return joined.withColumn(place, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__block", "__before")
