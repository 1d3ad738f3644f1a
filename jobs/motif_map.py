"""Motif maps of growing collections of sequences: which groups hold a motif more often than the others, and where along the sequence.

    python -m jobs.motif_map --input FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

A file stream takes the files that it has not seen, all that there are, and ends. Each of its batches writes counts of
its own: sequences by group, and hits and sequences with a hit by group, motif and bin of the relative position.
They are additive, so a map of everything follows from the counts of all batches, whenever they came. A batch that is done again
replaces its partition, so a job that was stopped anywhere can be run again.

Output, in Parquet: sizes/batch=N and counts/batch=N, and map/motif=NAME with, for each group and bin, the sequences with a hit, those
of all other groups, and Fisher's one-sided p-value. Settings are kept beside them: a folder holds the map of one configuration.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceatlas.functions import stats
from spliceatlas.operators import motif
from spliceatlas.shipping import ship

CONFIG = Path(__file__).with_suffix(".json")
COUNTS = "grp string, motif string, bin int, hits bigint, sequences bigint, batch bigint"
SIZES = "grp string, n bigint, batch bigint"
MAP = ["motif", "grp", "bin", "hits", "sequences", "n", "rest_sequences", "rest_n", "p"]
log = logging.getLogger(__name__)


def read_config(path: str | None = None) -> dict:
    return json.loads(Path(path or CONFIG).read_text(encoding="utf-8"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _same_settings(spark: SparkSession, config: dict, output: str) -> None:
    """Keeps the settings that decide on the counts, and refuses a folder that holds others."""
    own = json.dumps({k: config[k] for k in ("group", "sequence", "bins", "motifs")}, sort_keys=True)
    try:
        kept = [r.value for r in spark.read.text(f"{output}/settings").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = []
    if not kept:
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/settings")
    elif kept != [own]:
        raise ValueError(f"{output} holds a map of other settings: {kept[0]}")


def count_batch(batch: DataFrame, number: int, config: dict, output: str) -> None:
    """Writes what a batch adds. Null groups are the empty string; null and empty sequences count as sequences without a hit."""
    spark, bins = batch.sparkSession, config["bins"]
    grp = F.coalesce(F.col(config["group"]).cast("string"), F.lit("")).alias("grp")

    def write(df: DataFrame, name: str) -> None:
        df.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/{name}")

    motifs = spark.createDataFrame(list(config["motifs"].items()), "motif string, regex string")
    found = motif.matches(batch.select(grp, F.monotonically_increasing_id().alias("row"), F.col(config["sequence"]).alias("seq")), motifs, ["grp", "row"])
    # a match at the very end of a sequence (of no width) belongs to its last bin
    at = F.least(F.floor(F.col("p").cast("bigint") * bins / F.greatest("seq_len", F.lit(1))), F.lit(bins - 1)).cast("int").alias("bin")
    one = found.select("grp", "motif", "row", at).groupBy("grp", "motif", "bin", "row").agg(F.count("*").alias("hits"))
    write(one.groupBy("grp", "motif", "bin").agg(F.sum("hits").alias("hits"), F.count("*").alias("sequences")), "counts")
    write(batch.groupBy(grp).agg(F.count("*").alias("n")), "sizes")


def map_of(counts: DataFrame, sizes: DataFrame, config: dict) -> DataFrame:
    """motif, grp, bin, hits, sequences, n, rest_sequences, rest_n and p: every group at every bin of every motif."""
    n = sizes.groupBy("grp").agg(F.sum("n").alias("n"))
    whole = n.agg(F.sum("n").alias("all"))
    own = counts.groupBy("grp", "motif", "bin").agg(F.sum("hits").alias("hits"), F.sum("sequences").alias("sequences"))
    every = counts.groupBy("motif", "bin").agg(F.sum("sequences").alias("with"))
    names = F.array(*[F.lit(m) for m in config["motifs"]])
    # one row of a total; motifs and bins come from the settings
    cells = n.join(F.broadcast(whole)).withColumn("motif", F.explode(names)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(config["bins"] - 1))))
    rows = cells.join(own, ["grp", "motif", "bin"], "left").join(every, ["motif", "bin"], "left").fillna(0, ["hits", "sequences", "with"])
    rows = rows.withColumn("rest_sequences", F.col("with") - F.col("sequences")).withColumn("rest_n", F.col("all") - F.col("n"))
    return rows.withColumn("p", stats.fisher_column("sequences", "n", "rest_sequences", "rest_n", F.lit(1))).select(*MAP)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes the new files of a folder and brings the map up to date; returns the map, read back. Nothing new leaves it as it is."""
    ship(spark)
    config = config or read_config()
    _same_settings(spark, config, output)
    before = _table(spark, f"{output}/sizes", SIZES).agg(F.countDistinct("batch"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the pattern is part of the path, so a match may be a file or a folder of part files
    files = f"{source.rstrip('/')}/{config['files']}"
    schema = spark.read.parquet(files).select(config["group"], config["sequence"]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(files)
    started = stream.writeStream.foreachBatch(lambda df, k: count_batch(df, k, config, output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    counts, sizes = _table(spark, f"{output}/counts", COUNTS), _table(spark, f"{output}/sizes", SIZES)
    after = sizes.agg(F.countDistinct("batch"), F.coalesce(F.sum("n"), F.lit(0))).first()
    log.info("read %d new sequences in %d batches from %s/%s; %d in all", after[1] - before[1], after[0] - before[0], source, config["files"], after[1])
    map_of(counts, sizes, config).repartition("motif").write.mode("overwrite").partitionBy("motif").parquet(f"{output}/map")
    result = spark.read.parquet(f"{output}/map").select(F.col("motif").cast("string").alias("motif"), *MAP[1:])
    log.info("wrote %d rows to %s/map", result.count(), output)
    return result


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help=f"settings (default: {CONFIG.name})")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("motif map").getOrCreate()
    try:
        run(spark, given.input, given.output, given.checkpoint, read_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
