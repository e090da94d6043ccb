"""Versions of a ledger: generations with a manifest, named snapshots, retention, and restoring one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import commits
from .files import publish, published, version

KEEP = 12
#: Results of a run between two snapshots.
EVERY = 250


def name_of(library: str, stamp: str, reason: str) -> str:
    return f"cache-{library}--{stamp}--{reason}"


def enter(spark: SparkSession, root: str, name: str, paths: list[str]) -> str:
    row = spark.createDataFrame([(name, paths)], "snapshot string, paths array<string>")
    row.write.mode("append").parquet(f"{root.rstrip('/')}/snapshots-manifest")
    return name


def take(ledger: DataFrame, root: str, library: str, stamp: str, reason: str) -> str | None:
    """Write a snapshot and its row of the manifest, which comes last; an empty ledger is never kept. Its name, or None."""
    if ledger.isEmpty():
        return None
    name = name_of(library, stamp, reason)
    path = f"{root.rstrip('/')}/snapshots/{name}"
    ledger.write.mode("errorifexists").parquet(path)
    return enter(ledger.sparkSession, root, name, [path])


def mark(spark: SparkSession, root: str, library: str, stamp: str, reason: str, number: int | None = None) -> str | None:
    """A snapshot of a ledger in buckets as a commit left it (the newest if none is named): the folders that no later change touches.

    Copies nothing; one that is there already is left as it is.
    """
    found = commits.newest(spark, root) if number is None else commits.entry(spark, root, number)
    paths = sorted(p for p in (found or {}).get("buckets", {}).values() if p)
    name = name_of(library, stamp, reason)
    known = exists(spark, f"{root.rstrip('/')}/snapshots-manifest") and not every(spark, root).where(F.col("snapshot") == name).isEmpty()
    return enter(spark, root, name, paths) if paths and not known else None


def every(spark: SparkSession, root: str) -> DataFrame:
    """snapshot and paths of all that were taken."""
    return spark.read.schema("snapshot string, paths array<string>").parquet(f"{root.rstrip('/')}/snapshots-manifest")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """snapshot and paths of those that weren't dropped."""
    at, rows = root.rstrip("/"), every(spark, root)
    return rows.join(spark.read.schema("snapshot string").parquet(f"{at}/snapshots-dropped"), "snapshot", "left_anti") if exists(spark, f"{at}/snapshots-dropped") else rows


def exists(spark: SparkSession, path: str) -> bool:
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(java)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(*listed(spark, root).where(F.col("snapshot") == name).first().paths)


def retain(spark: SparkSession, root: str, keep: int = KEEP) -> list[str]:
    """Drop the snapshots beyond the newest ``keep`` of each library; copies are deleted, what a ledger in buckets shares is left alone."""
    rows = listed(spark, root).withColumns(parts(F.col("snapshot")))
    gone = [r.snapshot for r in expired(rows, keep).collect()]
    if gone:
        at = root.rstrip("/")
        spark.createDataFrame([(g,) for g in gone], "snapshot string").coalesce(1).write.mode("append").parquet(f"{at}/snapshots-dropped")
        for g in gone:
            java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/snapshots/{g}")
            java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(java, True)
    return gone


def restore(spark: SparkSession, root: str, name: str, library: str, stamp: str) -> DataFrame:
    """Make a snapshot the current generation; the one before it is snapshotted first. Returns the ledger as published."""
    return guarded(root, library, stamp, "restore", lambda _: read(spark, root, name), spark)


def guarded(root: str, library: str, stamp: str, reason: str, change: Callable[[DataFrame], DataFrame], spark: SparkSession, keep: int = KEEP) -> DataFrame:
    """Publish ``change(ledger)`` after a snapshot of the ledger as it is, named before- and the reason: import, merge, rescore or restore.

    The snapshot and the change are of the same version: if another writer commits meanwhile, ``commits.Conflict`` is raised.
    """
    base = version(spark, root)
    ledger = published(spark, root)
    take(ledger, root, library, stamp, f"before-{reason}")
    publish(change(ledger), root, base=base)
    retain(spark, root, keep)
    return published(spark, root)


def checkpoint_due(before: int, results: int, every: int = EVERY) -> bool:
    """Whether ``results`` more results pass a multiple of ``every`` since the run began, after ``before`` of them."""
    return (before + results) // every > before // every


def parts(name) -> dict:
    """Library, time and reason of a snapshot's name."""
    p = F.split(name, "--")
    return {"library": p[0], "taken": p[1], "reason": p[2]}


def inventory(rows: DataFrame) -> DataFrame:
    """Cards and scored cards of each snapshot (rows: snapshot, score), with what its name says."""
    counts = rows.groupBy("snapshot").agg(F.count("*").alias("cards"), F.count("score").alias("scored"))
    return counts.withColumns(parts(F.col("snapshot"))).select("snapshot", "library", "taken", "reason", "cards", "scored")


def expired(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """Snapshots (library, taken, snapshot) beyond the newest ``keep`` of each library."""
    rank = F.row_number().over(Window.partitionBy("library").orderBy(F.desc("taken"), F.desc("snapshot")))
    return snapshots.withColumn("rank", rank).where(F.col("rank") > keep).select("snapshot")
