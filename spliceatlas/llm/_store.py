"""Scratch tables in the shared checkpoint folder, and sizes to choose partition counts by."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: Bytes of an Arrow batch that goes to a Python worker. Spark's default of 64 MB is held several times over, by worker and executor.
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "67108864b"
_OWN: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and the master is local, a folder of this machine (tests).

    On a cluster other machines would not see such a folder, so RuntimeError is raised there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="spliceatlas-")
        _OWN[context.applicationId] = root
    return root.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application, once their results have been used."""
    _delete(spark, f"{checkpoint_root(spark)}/spliceatlas/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the package shipped and Arrow batches of bounded size (a setting of the user's stays)."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == DEFAULT_BATCH:
        spark.conf.set(setting, str(BATCH_BYTES))
    return ship(spark)


def session_of(df: DataFrame) -> SparkSession:
    """The prepared session of df: call it before handing Spark a Python function."""
    return prepared(df.sparkSession)


class Scratch:
    """Tables of one operator call. A written table cuts the lineage and is read again after an executor is lost; clear deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/spliceatlas/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later result reads."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: a partitioning hint only, results never depend on it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, each: int, least: int = 1) -> int:
    """Number of parts of about `each` bytes of text; compressed columns are taken to hold twice their size. Bounded for missing statistics."""
    return max(least, min(math.ceil(2 * input_bytes(df) / each), 1 << 24) if input_bytes(df) < 1 << 60 else least)
