"""Exact order statistics of a table without sorting it: ranges are counted and narrowed until they hold few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.store import written

#: Ranges that are counted at once, and rows that may be sorted.
RANGES = 1024
FEW = 1000
#: Bytes of a text that one number of its order holds.
BYTES = 6


def text_parts(c: Column, longest: int) -> list[Column]:
    """A text as numbers of six bytes each: texts compare as these do, one after the other."""
    code = F.hex(F.encode(c, "utf-8"))
    digits = 2 * BYTES
    return [F.conv(F.rpad(F.substring(code, k * digits + 1, digits), digits, "0"), 16, 10).cast("long") for k in range(max(1, -(-longest // BYTES)))]


def narrowed(rows: DataFrame, part: str, rank: int, count: int) -> tuple[DataFrame, int, int]:
    """The rows of one range of ``part`` that hold the row of a rank (from 0), its rank among them, and how many they are.

    A pass counts ``RANGES`` ranges of what the range before holds: few rows, or a single value, are reached in at most seven.
    """
    low, high = rows.agg(F.min(part), F.max(part)).first()
    while count > FEW and low < high:
        step = (high - low) // RANGES + 1
        bins = F.floor((F.col(part) - low) / step).cast("long") if high - low < 1 << 52 else F.expr(f"({part} - {low}L) div {step}L")
        counts = sorted(rows.groupBy(bins.alias("bin")).count().collect())
        for n, size in counts:
            if rank < size:
                break
            rank -= size
        low, high, count = low + n * step, min(high, low + (n + 1) * step - 1), size
        rows = rows.where(F.col(part).between(low, high))
    return rows, rank, count


def at_ranks(rows: DataFrame, value: str, tie: str, ranks: Sequence[int], count: int) -> list:
    """The rows at ``ranks`` (from 0) by the integer column ``value``, equal values by the text column ``tie``; ``rows`` should be written.

    Only the range that holds a rank is looked at again; rows that nothing tells apart stand in for each other.
    """
    longest = rows.agg(F.max(F.octet_length(tie))).first()[0] or 0
    parts = {"__part_0": F.col(value).cast("long")} | {f"__part_{k}": c for k, c in enumerate(text_parts(F.coalesce(F.col(tie), F.lit("")), longest), 1)}
    told = rows.withColumns(parts)
    out = []
    for rank in ranks:
        left, place, n = told, rank, count
        for part in parts:
            if n <= FEW:
                break
            left, place, n = narrowed(left, part, place, n)
        few = left.select(*rows.columns, *parts).orderBy(*parts).limit(place + 1 if n <= FEW else 1)
        out.append(few.tail(1)[0])
    return out


def representative_sample(cards: DataFrame, first: int | None = 400) -> DataFrame:
    """pick, id, tokens: the smallest, the median (place floor(n / 2)) and the largest card by ``tokens``, equal ones by id.

    Of the first ``first`` cards (id, tokens) by id, or of all of them (None). One card is all three; without cards there is no row.
    """
    chosen = cards.select("id", F.col("tokens").cast("long").alias("tokens"))
    rows = written(chosen if first is None else chosen.orderBy("id").limit(first))
    n = rows.count()
    picked = at_ranks(rows, "tokens", "id", (0, n // 2, n - 1), n) if n else []
    return cards.sparkSession.createDataFrame([(name, r.id, r.tokens) for name, r in zip(("smallest", "median", "largest"), picked, strict=False)], "pick string, id string, tokens long")
