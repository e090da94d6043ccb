"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.store import written as materialize  # noqa: F401

#: Words everywhere in this package: maximal runs of code points outside this set. It is what
#: ``bytes.split()`` splits UTF-8 on, and Java's ``\s``.
WORD_GAP = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffled join follows).

    ``df`` should be materialized: it is counted here, and counting Parquet reads footers only.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that none of ``taken`` has, whatever its case."""
    low = {c.lower() for c in taken}
    name, n = f"__{stem}", 0
    while name.lower() in low:
        n += 1
        name = f"__{stem}_{n}"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model of this package learns from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
