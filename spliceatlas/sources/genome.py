"""Genome sequence as a table of fixed-size chunks, so a slice touches a few rows, wherever it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import ahead, bucket
from .text import lines

CHUNK = 1024


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, chunk, seq: upper-case sequence in chunks of CHUNK bases, of a FASTA file.

    Lines find their header and their offset by buckets: what the buckets ahead hold is summed over a table of one row for
    each, the rest inside the bucket, so neither a chromosome nor the file meets in one task, however many scaffolds there are.
    """
    df = lines(spark, path, header=False).select("line", F.trim("value").alias("value"))
    head = F.col("value").startswith(">")
    rows = df.where(F.length("value") > 0).select("line", bucket(df, "line").alias("bucket"), "value", F.when(head, F.regexp_extract("value", r"^>\s*(\S+)", 1)).alias("name"), F.when(head, 0).otherwise(F.length("value")).cast("bigint").alias("n"))
    inside = Window.partitionBy("bucket").orderBy("line")
    rows = rows.withColumn("at", F.sum("n").over(inside) - F.col("n"))
    rows = rows.withColumn("own", F.last(F.when(F.col("name").isNotNull(), F.struct("name", "at")), ignorenulls=True).over(inside))
    buckets = ahead(rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.max_by("own", "line").alias("last")), [], "n", "base")
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("last").isNotNull(), F.struct(F.col("last.name").alias("name"), (F.col("base") + F.col("last.at")).alias("at")))
    buckets = buckets.select("bucket", "base", F.last(last, ignorenulls=True).over(before).alias("earlier"))
    placed = rows.where(~head).join(buckets, "bucket")
    own = F.when(F.col("own").isNotNull(), F.struct(F.col("own.name").alias("name"), (F.col("base") + F.col("own.at")).alias("at")))
    placed = placed.withColumn("of", F.coalesce(own, "earlier")).where(F.col("of").isNotNull())
    return chunked(placed.select(F.col("of.name").alias("chrom"), (F.col("base") + F.col("at") - F.col("of.at")).alias("at"), F.upper("value").alias("seq")))


def chunked(df: DataFrame) -> DataFrame:
    """Chunks from pieces (chrom, at, seq) that follow each other without gaps."""
    k = F.explode(F.sequence(F.floor(F.col("at") / CHUNK), F.floor((F.col("at") + F.length("seq") - 1) / CHUNK)))
    cut = df.where(F.length("seq") > 0).withColumn("chunk", k)
    lo = F.greatest(F.col("at"), F.col("chunk") * CHUNK)
    hi = F.least(F.col("at") + F.length("seq"), (F.col("chunk") + 1) * CHUNK)
    cut = cut.select("chrom", "chunk", lo.alias("lo"), F.substring("seq", lo - F.col("at") + 1, hi - lo).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "part"))), lambda p: p["part"]), "")
    return cut.groupBy("chrom", "chunk").agg(joined.alias("seq"))


def slices(regions: DataFrame, genome: DataFrame) -> DataFrame:
    """regions (chr, start, end, reverse, id columns; equal rows count once) with `seq`: bases start..end (0-based, end exclusive), reverse-complemented where
    asked, then padded with N on the right to the full length. Starts below zero and unknown chromosomes give N only."""
    from ..functions.scalars import reverse_complement

    keys = regions.columns
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    known = (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    spanned = F.when(known, F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK)))
    wanted = regions.withColumn("chunk", F.explode_outer(spanned))
    parts = wanted.join(genome.select(F.col("chrom").alias("chr"), "chunk", F.col("seq").alias("bases")), ["chr", "chunk"], "left")
    lo = F.greatest(F.col("start"), F.col("chunk") * CHUNK)
    hi = F.least(F.col("end"), (F.col("chunk") + 1) * CHUNK)
    cut = F.substring("bases", (lo - F.col("chunk") * CHUNK + 1).cast("int"), (hi - lo).cast("int"))
    parts = parts.select(*keys, F.when(F.col("bases").isNotNull(), F.struct("chunk", cut.alias("s"))).alias("p"))
    out = parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["s"]), "").alias("seq"))
    turned = F.when(F.col("reverse"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return out.withColumn("seq", F.when(length > 0, F.rpad(F.coalesce(turned, F.lit("")), length.cast("int"), "N")).otherwise(F.lit("")))
