"""A ledger in hash buckets: a change rewrites only the buckets that it touches.

A commit maps each bucket to the folder that holds it. A change reads the touched buckets of the version it starts from, writes them anew
under a folder of its own and commits a map that differs in these buckets only. Older versions stay readable, so that a snapshot
is the number of a commit and copies nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits
from .store import empty, written

BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, schema: str, number: int | None = None) -> DataFrame:
    """The ledger at a commit, the newest if none is named; an empty table before the first."""
    found = commits.newest(spark, root) if number is None else commits.entry(spark, root, number)
    paths = [p for p in (found or {}).get("buckets", {}).values() if p]
    return spark.read.schema(schema).parquet(*paths) if paths else empty(spark, schema)


def read_for(rows: DataFrame, root: str, schema: str, key: str = "id") -> DataFrame:
    """The entries of the newest commit in the buckets that ``rows`` fall into; other buckets aren't read."""
    spark = rows.sparkSession
    newest = commits.newest(spark, root)
    if newest is None:
        return empty(spark, schema)
    touched = [r[0] for r in rows.select(bucket_of(F.col(key), newest["of"])).distinct().collect()]
    paths = [p for b in touched if (p := newest["buckets"].get(str(b)))]
    return spark.read.schema(schema).parquet(*paths) if paths else empty(spark, schema)


def find(spark: SparkSession, root: str, generation: str) -> dict | None:
    """The commit of a generation, if there is one."""
    rows = commits.listed(spark, root)
    found = None if rows is None else rows.where(F.col("generation") == generation).select("number").first()
    return found and commits.entry(spark, root, found.number)


def noted(spark: SparkSession, root: str, name: str, default):
    """What the newest commit notes under ``name``."""
    return (commits.newest(spark, root) or {}).get(name, default)


def merge(changes: DataFrame, root: str, schema: str, change: Callable[[DataFrame, DataFrame], DataFrame], generation: str, buckets: int = BUCKETS, key: str = "id", **noted) -> dict | None:
    """Commit ``change(entries, changes)`` for the buckets that ``changes`` touch; entries of other buckets stay where they are.

    None if ``changes`` are empty. ``noted`` goes into the commit. The number of buckets is that of the first commit.
    """
    spark = changes.sparkSession
    base = commits.newest(spark, root) or {"number": 0, "buckets": {}}
    buckets = base.get("of", buckets)
    rows = written(changes.withColumn("__bucket", bucket_of(F.col(key), buckets)))
    touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return None
    paths = [p for b in touched if (p := base["buckets"].get(str(b)))]
    entries = spark.read.schema(schema).parquet(*paths) if paths else empty(spark, schema)
    columns = entries.columns
    merged = change(entries, rows.drop("__bucket")).select(*columns)
    at = f"{root.rstrip('/')}/data/{generation}-{uuid.uuid4().hex[:12]}"
    placed = merged.withColumn("bucket", bucket_of(F.col(key), buckets))
    placed.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(at)
    full = {r[0] for r in spark.read.schema(f"{schema}, bucket int").parquet(at).select("bucket").distinct().collect()}
    new = {str(b): f"{at}/bucket={b}" if b in full else None for b in touched}
    return commits.commit(spark, root, base["number"] + 1, {"generation": generation, "of": buckets, "buckets": base["buckets"] | new, "rewritten": touched, **noted})
