"""Intermediate tables in the shared checkpoint folder. A written table cuts the lineage and is read again after an executor is lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and the master is local, a folder of this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spliceatlas-"))
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a new table in the shared folder, which is left to that folder's housekeeping."""
    path = f"{root(df.sparkSession)}/spliceatlas/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
