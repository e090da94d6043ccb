"""Numbered commits of a table's versions: of two writers that start from one version, one succeeds. No clock is read.

A commit is a small JSON file named by its number. It is written aside and then put in place only if that name is free: by a hard link on
a local file system, by a rename that doesn't replace on others (HDFS refuses one; a store without such a rename needs a lock
of its own). Readers take the greatest number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one began with."""


def _in(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    java = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, java, java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(root: str) -> str:
    return f"{root.rstrip('/')}/commits"


def numbers(spark: SparkSession, root: str) -> list[int]:
    _, path, files = _in(spark, folder(root))
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def entry(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder(root)}/{number:020}.json").first()[0])


def newest(spark: SparkSession, root: str) -> dict | None:
    found = numbers(spark, root)
    return entry(spark, root, found[-1]) if found else None


def commit(spark: SparkSession, root: str, number: int, body: dict) -> dict:
    """Enter ``body`` as commit ``number``; Conflict if that number is taken."""
    body = {"number": number, **body}
    name = f"{number:020}.json"
    jvm, aside, files = _in(spark, f"{folder(root)}/.{name}.{uuid.uuid4().hex}")
    jvm, place, _ = _in(spark, f"{folder(root)}/{name}")
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    if files.getUri().getScheme() == "file":
        local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(local(place), local(aside))
            placed = True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            placed = False
        files.delete(aside, False)
    else:
        placed = not files.exists(place) and files.rename(aside, place)
        if not placed:
            files.delete(aside, False)
    if not placed:
        raise Conflict(f"version {number} of {root} was committed by another writer")
    return body


def listed(spark: SparkSession, root: str) -> DataFrame | None:
    """number, generation and more of all commits; None before the first."""
    return spark.read.json(f"{folder(root)}/*.json") if numbers(spark, root) else None
