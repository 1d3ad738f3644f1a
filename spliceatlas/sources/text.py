"""Tab-delimited sources, parsed by position.

Lines are read with the text source, which splits large files, and keep their place in `line`, a struct that orders by file,
split and row: later lines win where keys repeat. The first line of a table is its header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import number, stripped
from ..specs import GROUPS, Event


def lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """line, value: all lines but the header."""
    df = spark.read.text(path)
    out = df.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("line"), "value")
    first = df.head(1) if header else []
    return out.where(F.col("value") != first[0][0]) if first else out


def fields(df: DataFrame) -> DataFrame:
    """f: the fields of each line, white space at its ends removed first, so trailing empty fields are gone."""
    return df.select("line", F.split(stripped(F.col("value")), "\t", -1).alias("f"))


def read_events(spark: SparkSession, path: str, event: Event, analysis: str = "motif") -> DataFrame:
    """Event rows: line and f. Rows too short to hold the coordinates are dropped."""
    least = 3 + 2 + event.coordinates if analysis == "motif" or event.coordinates == 6 else 11
    return fields(lines(spark, path)).where(F.size("f") >= least)


def read_coordinates(spark: SparkSession, paths: dict[str, str], event: Event) -> DataFrame:
    """grp, line, chr, strand, c2..: coordinate sets of the groups up, dn and bg."""
    parts = [fields(lines(spark, paths[g])).withColumn("grp", F.lit(g)) for g in GROUPS]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return df.where(F.size("f") >= 2 + event.coordinates).select("grp", "line", F.get("f", F.lit(0)).alias("chr"), F.get("f", F.lit(1)).alias("strand"), *[F.get("f", F.lit(k)).cast("bigint").alias(f"c{k}") for k in range(2, 2 + event.coordinates)])


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """chr, p_start (1-based), p_end, height, line of BED rows of six columns or more; # comments are skipped, other rows fail."""
    df = lines(spark, path, header=False).where(~F.col("value").startswith("#"))
    f = F.split(stripped(F.col("value")), "\t", -1)
    df = df.select("line", F.when(F.size(f) >= 6, f).otherwise(F.raise_error(F.concat(F.lit("not a BED row of six columns: "), F.col("value")))).alias("f"))
    return df.select(F.get("f", F.lit(0)).alias("chr"), (F.get("f", F.lit(1)).cast("bigint") + 1).alias("p_start"), F.get("f", F.lit(2)).cast("bigint").alias("p_end"), F.get("f", F.lit(4)).cast("double").cast("bigint").alias("height"), "line")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """motif, regex: named regular expressions, each pair once."""
    return fields(lines(spark, path)).where(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("motif"), F.get("f", F.lit(1)).alias("regex")).distinct()


def read_isoforms(spark: SparkSession, path: str) -> DataFrame:
    """line, f of an isoform table; every row must have 18 fields. Only line ends are removed."""
    f = F.split(F.regexp_replace("value", "[\r\n]+$", ""), "\t", -1)
    return lines(spark, path).select("line", F.when(F.size(f) == 18, f).otherwise(F.raise_error(F.concat(F.lit("18 columns are expected: "), F.col("value")))).alias("f"))


__all__ = ["fields", "lines", "number", "read_coordinates", "read_events", "read_isoforms", "read_motifs", "read_peaks"]
