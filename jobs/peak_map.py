"""Peak map of differential events: classifies splicing events and compares the peaks around regulated exons with those around background ones.

    python -m jobs.peak_map --input FOLDER --output FOLDER [--config FILE]

Events and peaks are columnar tables of any names; the settings say, in SQL expressions, which of their columns are coordinates and
statistics. Output, in Parquet: exons/grp=up|dn|bg (the classified coordinates) and map/region=LABEL (summed heights, means for
each exon, and p-values of either set against background at each position). Both are replaced as a whole, so a job that
is run again, or was stopped, gives the same result.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceatlas.operators.classify import Cuts, classified, coordinates
from spliceatlas.operators.motif import Shape
from spliceatlas.plans.maps import clip_map
from spliceatlas.shipping import ship
from spliceatlas.specs import GROUPS, Event, event

CONFIG = Path(__file__).with_suffix(".json")
MAP = ["region", "pos", *GROUPS, *[f"mean_{g}" for g in GROUPS], "p_up", "p_dn"]
log = logging.getLogger(__name__)


def read_config(path: str | None = None) -> dict:
    return json.loads(Path(path or CONFIG).read_text(encoding="utf-8"))


def measured_events(events: DataFrame, columns: dict, kind: Event) -> DataFrame:
    """line, key, coords, fdr, delta, psi1, psi2; NaN counts as missing, as in event files. Rows without a chromosome or position are left out."""
    places = [columns["chr"], columns["strand"], *columns["positions"]]
    if len(places) != 2 + kind.coordinates:
        raise ValueError(f"{kind.name} events have {kind.coordinates} positions")
    coords = F.array(*[F.expr(x).cast("string") for x in places])
    named = events.select(F.expr(columns["line"]).alias("line"), coords.alias("coords"), *[F.nanvl(F.expr(columns[c]).cast("double"), F.lit(None)).alias(c) for c in ("fdr", "delta", "psi1", "psi2")])
    named = named.where(~F.exists("coords", lambda x: x.isNull()))
    return named.withColumn("key", F.array_join(F.slice("coords", 1, 4), ":"))


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> DataFrame:
    """Writes exons and map; returns the map, read back."""
    ship(spark)
    config = config or read_config()
    kind = event(config["event"])
    events, peaks = (spark.read.parquet(f"{source}/{config['tables'][t]}") for t in ("events", "peaks"))
    rows = measured_events(events, config["events"], kind)
    coords = coordinates(classified(rows, Cuts(**config["cuts"]), "clip"), kind)
    coords.write.mode("overwrite").partitionBy("grp").parquet(f"{output}/exons")
    coords = spark.read.parquet(f"{output}/exons").select(*coords.columns)
    sizes = {r["grp"]: r["count"] for r in coords.groupBy("grp").count().collect()}
    log.info("read events of %s/%s; wrote %s exons to %s/exons", source, config["tables"]["events"], sizes, output)
    given = peaks.select(*[F.expr(config["peaks"][c]).alias(c) for c in ("chr", "p_start", "p_end", "height", "line")])
    result = clip_map(coords, given, kind.name, Shape(**config["shape"]), config["method"], unique=True)
    means = result.combined().select("region", "pos", *[f"mean_{g}" for g in GROUPS])
    tested = result.labelled(result.tested.join(means, ["region", "pos"])).select(*MAP)
    tested.repartition("region").write.mode("overwrite").partitionBy("region").parquet(f"{output}/map")
    done = spark.read.parquet(f"{output}/map").select(*MAP)
    log.info("read peaks of %s/%s; wrote %d positions to %s/map", source, config["tables"]["peaks"], done.count(), output)
    return done


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("input", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help=f"settings (default: {CONFIG.name})")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("peak map").getOrCreate()
    try:
        run(spark, given.input, given.output, read_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
