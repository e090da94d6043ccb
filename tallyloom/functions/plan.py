"""Help for plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row however often it is used further on.

    The columns are generated: the optimizer neither copies their expressions into every later use nor pushes filters on
    them, with a copy of the expression, below them.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__once")
    return df.select(*[F.col(f"`{c}`") for c in kept], made).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__once.{name}").alias(name) for name in columns])
