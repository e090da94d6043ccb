"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local one will do for a local master only.

    Executors on other machines would write to folders of their own and lose rows silently: that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, stem: str = "tallyloom") -> str:
    """A new folder in the shared one; it is deleted, with all that is in it, when the application ends."""
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(java)
    files.deleteOnExit(java)  # only for what exists
    return path


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{fresh_path(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, known to the planner: no task and no Python worker is started for it."""
    return spark.range(0).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in StructType.fromDDL(schema)])
