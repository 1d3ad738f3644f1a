"""Writers. Tables go out as folders of tab-delimited files; reports of bounded size and drawings are single files.

Both go to the file system that Spark resolves the path to, so an output folder may be a URI.
"""

from __future__ import annotations

import math
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..specs import CONTRASTS, GROUPS

COLORS = {"up": "red", "dn": "blue", "bg": "black"}


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A folder of tab-delimited files with a header; fields are written as they are. With `by`, one folder for each value of that column.

    Files keep the order of a sorted table, by their names.
    """
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(by) if by else writer
    writer.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A folder of files of ready lines, each file with the column's name as its header."""
    df.write.mode("overwrite").option("sep", "\x01").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, replaced if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def write_report(df: DataFrame, path: str) -> None:
    """One file of a table that a map's shape or the list of motifs bounds, such as p-values by position or a summary by motif, row by row as they come."""
    rows = ["\t".join("" if x is None else str(x) for x in row) for row in df.collect()]
    write_text(df.sparkSession, path, "\n".join(["\t".join(df.columns), *rows]) + "\n")


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Records named by their columns, joined by colons."""
    names = [c for c in seqs.columns if c != "seq"]
    seqs.select(F.concat(F.lit(">"), F.concat_ws(":", *[F.col(c).cast("string") for c in names]), F.lit("\n"), F.col("seq"))).write.mode("overwrite").text(path)


def write_svg(spark: SparkSession, rows: list[Row], path: str, labels: tuple[str, ...], title: str, sizes: dict[str, int]) -> None:
    """One boxed panel for each region: mean scores by position as lines (axis on the left; up red, down blue, background black) and
    -log10 of the p-values as dashed lines (axis on the right), with a legend of the groups and their sizes.

    rows of one map, in order: region, pos, mean_up, mean_dn, mean_bg, nlp_up, nlp_dn. Infinite values are drawn at the top.
    """
    width, height, left, above = 220, 160, 50, 50
    finite = [r[n] for r in rows for n in ("nlp_up", "nlp_dn") if r[n] is not None and math.isfinite(r[n])]
    tops = {"mean": max([1e-9, *(r[f"mean_{g}"] for r in rows for g in GROUPS)]), "nlp": max([1e-9, *finite])}
    panels = []
    for k, label in enumerate(labels):
        own = [r for r in rows if r["region"] == k]
        drawn = [f'<rect width="{width - 20}" height="{height}" fill="none" stroke="gray"/>']
        for name, dash in [(f"mean_{g}", "") for g in GROUPS] + [(f"nlp_{g}", ' stroke-dasharray="4 3"') for g in CONTRASTS]:
            top = tops[name.split("_")[0]]
            at = " ".join(f"{r['pos'] * (width - 20) / max(len(own) - 1, 1):.1f},{height - min(r[name] / top, 1.0) * height:.1f}" for r in own if r[name] is not None)
            drawn.append(f'<polyline fill="none" stroke="{COLORS[name.split("_")[1]]}"{dash} points="{at}"/>')
        panels.append(f'<g transform="translate({left + k * width},{above})">{"".join(drawn)}<text y="{height + 16}" font-size="10">{escape(label)}</text></g>')
    right = left + width * len(labels) - 15
    axes = []
    for share in (0.0, 0.5, 1.0):
        y = above + height * (1 - share)
        axes.append(f'<text x="{left - 5}" y="{y:.0f}" font-size="9" text-anchor="end">{tops["mean"] * share:.3g}</text><text x="{right}" y="{y:.0f}" font-size="9">{tops["nlp"] * share:.3g}</text>')
    axes.append(f'<text x="{left - 40}" y="{above - 8}" font-size="9">mean score</text><text x="{right - 20}" y="{above - 8}" font-size="9">-log10 p</text>')
    names = {"up": "Upregulated", "dn": "Downregulated", "bg": "Background"}
    legend = "".join(f'<text x="{left + 150 * k}" y="32" font-size="11" fill="{COLORS[g]}">{names[g]} ({sizes[g]})</text>' for k, g in enumerate(GROUPS))
    write_text(spark, path, f'<svg xmlns="http://www.w3.org/2000/svg" width="{right + 60}" height="{height + above + 30}"><text x="10" y="16">{escape(title)}</text>{legend}{"".join(axes)}{"".join(panels)}</svg>\n')
