"""Classification of event files as they arrive. It is stateless; deduplication and maps are batch steps over what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import MOTIF_CUTS, Cuts, class_of, measured
from ..sources.text import fields
from ..specs import Event


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files that appear in a folder, as event rows (line, f). Headers have no numeric statistics and classify as nothing."""
    raw = spark.readStream.text(folder)
    return fields(raw.select(F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("split"), F.lit(0).cast("bigint").alias("row")).alias("line"), "value"))


def classify_stream(events: DataFrame, event: Event, cuts: Cuts = MOTIF_CUTS, analysis: str = "motif") -> DataFrame:
    """key, coords, grp of rows in a class."""
    rows = measured(events.where(F.size("f") >= 5 + event.coordinates), event, analysis)
    return rows.select("key", "coords", class_of(F.col("fdr"), F.col("delta"), F.col("psi1"), F.col("psi2"), cuts).alias("grp")).where(F.col("grp").isNotNull())
