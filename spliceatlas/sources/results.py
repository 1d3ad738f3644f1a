"""Result folders of earlier runs: what analyses wrote, of many runs at once, with the run as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import number, stripped

#: How the header of each shape begins; the two analyses give files of different shapes the same name.
SHAPES = {"summary": "RBP\t", "positions": "Region\t"}


def _rows(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """run (the folder a file is in), contrast and f (fields) of the data lines of files of one shape."""
    path = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "pVal.*.vs.bg.RNAmap.txt").text(folder).select(path.alias("file"), stripped(F.col("value")).alias("value"))
    head = F.greatest(*[F.col("value").startswith(h) for h in SHAPES.values()])
    kinds = lines.groupBy("file").agg(F.max(F.col("value").startswith(SHAPES[shape])).alias("fits")).where("fits").select("file")
    rows = lines.where(~head & (F.length("value") > 0)).join(kinds, "file")
    return rows.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract("file", r"pVal\.([^./]+)\.vs[^/]*$", 1).alias("contrast"), F.split("value", "\t", -1).alias("f"))


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """run, contrast, RBP and p (array, in the order of the regions) of the summaries of smallest p-values under a folder."""
    return _rows(spark, folder, "summary").select("run", "contrast", F.get("f", F.lit(0)).alias("RBP"), F.transform(F.slice("f", 2, 1000), lambda x: number(x)).alias("p"))


def read_positions(spark: SparkSession, folder: str) -> DataFrame:
    """run, contrast, region, position and p of the p-values by position under a folder."""
    return _rows(spark, folder, "positions").select("run", "contrast", F.get("f", F.lit(0)).alias("region"), F.get("f", F.lit(1)).try_cast("int").alias("position"), number(F.get("f", F.lit(2))).alias("p"))


def top_of_runs(spark: SparkSession, folder: str, n: int = 20) -> DataFrame:
    """run, RBP, pval_up_vs_bg, pval_dn_vs_bg, log_pval_up, log_pval_dn and rank: in each run the n motifs with the smallest up p-values.

    A motif's p-value is the smallest over its regions and rows; values outside (0, 1] and what is no number are left out, and 1 stands for none. Ties
    go by name. Every task keeps n rows of each run before runs meet.
    """
    found = read_summaries(spark, folder)
    best = found.select("run", "contrast", "RBP", F.array_min(F.filter("p", lambda x: (x > 0) & (x <= 1))).alias("p")).where("p is not null")
    both = best.groupBy("run", "RBP").agg(*[F.coalesce(F.min(F.when(F.col("contrast") == g, F.col("p"))), F.lit(1.0)).alias(f"pval_{g}_vs_bg") for g in ("up", "dn")])
    rank = F.row_number().over(Window.partitionBy("run").orderBy("pval_up_vs_bg", "RBP"))
    logs = [(0 - F.log10(F.greatest(F.col(f"pval_{g}_vs_bg"), F.lit(1e-300)))).alias(f"log_pval_{g}") for g in ("up", "dn")]
    return both.withColumn("rank", rank).where(F.col("rank") <= n).select("run", "RBP", "pval_up_vs_bg", "pval_dn_vs_bg", *logs, "rank")
