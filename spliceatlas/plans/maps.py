"""The two analyses: motif maps and peak maps, from coordinates to p-values."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import motif, overlap, summary
from ..operators.classify import CLIP_A5SS_CUTS, CLIP_CUTS, MOTIF_CUTS, Cuts, classify, coordinates, rekeyed
from ..operators.isoforms import convert
from ..operators.motif import Shape
from ..operators.numbering import numbered
from ..paths import MISSING
from ..scratch import written
from ..sources.text import read_coordinates, read_events, read_isoforms
from ..sources.workbook import is_workbook, read_workbook
from ..specs import CONTRASTS, GROUPS, Event, event

CLIP_SHAPE = Shape(window=10)


def given(path: str | None) -> bool:
    return bool(path) and path != MISSING


def load_coordinates(spark: SparkSession, kind: Event, analysis: str, *, events: str | None = None, isoforms: str | None = None, up: str | None = None, dn: str | None = None, bg: str | None = None, cuts: Cuts | None = None, bayes_low: float = 1, bayes_high: float | None = None) -> DataFrame:
    """Coordinates from an isoform table, an event table (text or workbook), or three coordinate files; the first of these that is given."""
    if given(isoforms):
        high = bayes_high if bayes_high is not None else (100 if analysis == "motif" else 10)
        rows = convert(read_isoforms(spark, isoforms), kind, bayes_low, high)
        rows = rows.where(F.size("f") >= 3 + 2 + kind.coordinates)
    elif given(events):
        rows = read_workbook(spark, events).where(F.size("f") >= 3 + 2 + kind.coordinates) if is_workbook(events) else read_events(spark, events, kind, analysis)
    elif given(up) and given(dn) and given(bg):
        sets = read_coordinates(spark, {"up": up, "dn": dn, "bg": bg}, kind)
        return numbered(sets, "grp", ["line"], "exon_idx").drop("line")
    else:
        raise ValueError("an event table, an isoform table, or up, down and background coordinates are needed")
    cuts = cuts or (MOTIF_CUTS if analysis == "motif" else CLIP_A5SS_CUTS if kind.name == "A5SS" else CLIP_CUTS)
    return coordinates(classify(rows, kind, cuts, analysis), kind)


@dataclass
class Map:
    """Counts and p-values of an analysis. counts: sparse, by key, grp, region, pos, exon_idx; tested: keys, region, pos, up, dn, bg, p_up, p_dn."""

    event: Event
    sizes: dict[str, int]
    counts: DataFrame
    cells: DataFrame
    tested: DataFrame
    keys: list[str] = field(default_factory=list)
    value: str = "cnt"

    def labelled(self, df: DataFrame) -> DataFrame:
        return df.withColumn("region", F.element_at(F.array(*[F.lit(x) for x in self.event.labels]), F.col("region") + 1))

    def points(self) -> DataFrame:
        return summary.draw_points(self.tested, self.sizes)

    def combined(self) -> DataFrame:
        return summary.combined(self.tested.select(*self.keys, "region", "pos", *GROUPS), self.sizes)

    def min_p(self, contrast: str) -> DataFrame:
        return summary.min_p_summary(self.tested, self.event, contrast)

    def top(self, n: int = 20) -> DataFrame:
        return summary.top_motifs(self.min_p("up"), self.min_p("dn"), n)

    def values(self, group: str) -> DataFrame:
        return summary.value_lists(self.counts, self.cells, self.sizes, group, self.keys, self.value)


def _tested(counts: DataFrame, parts: DataFrame, cells: DataFrame, keys: list[str], sizes: dict[str, int], method: str, clip: bool, window: int, permutations: int | None, seed: int | None, value: str) -> DataFrame:
    """parts: rows that add up to the counts; Fisher's test needs sums of groups only, so nothing is put together by exon."""
    on = [*keys, "region", "pos"]
    method = stats.method_name(method)
    if method == "fisher":
        return summary.fisher(summary.totals(parts, cells, keys, value), sizes, window if clip else 1)
    total = summary.totals(counts, cells, keys, value)
    if method == "permutation_one_sided":
        usual, own = stats.permutation_settings()
        if clip:
            b = permutations if permutations is not None and permutations >= stats.LEAST_PERMUTATIONS else usual
            s = seed if seed is not None and seed >= 0 else own
        else:
            b = max(stats.LEAST_PERMUTATIONS, usual if permutations is None else permutations)
            s = max(0, own if seed is None else seed)
        p = summary.permutation_test(counts, cells, keys, sizes, b, s, shared=not clip, value=value)
    else:
        p = summary.rank_test(summary.histograms(counts, cells, keys, sizes, value), method, clip).select(*on, *[f"p_{g}" for g in CONTRASTS])
    return total.join(p, on)


def motif_map(coords: DataFrame, genome: DataFrame, motifs: DataFrame, event_name: str, shape: Shape = Shape(), method: str = "fisher", permutations: int | None = None, seed: int | None = None) -> Map:
    """coords: grp, exon_idx, chr, strand, c2..; genome: chrom, chunk, seq; motifs: motif, regex."""
    kind, spark = event(event_name), coords.sparkSession
    sizes = summary.group_sizes(coords)
    seqs = motif.sequences(coords, genome, kind, shape)
    counts = motif.hit_counts(seqs, motifs, kind, shape)
    keys = ["motif", "regex"]
    cells = summary.grid(spark, motif.positions(kind, shape), motifs.select(*keys).distinct())
    return Map(kind, sizes, counts, cells, _tested(counts, motif.hits(seqs, motifs, kind, shape), cells, keys, sizes, method, False, shape.window, permutations, seed, "cnt"), keys)


def clip_map(coords: DataFrame, peaks: DataFrame, event_name: str, shape: Shape = CLIP_SHAPE, method: str = "fisher", permutations: int | None = None, seed: int | None = None, unique: bool = False) -> Map:
    """coords as for motif_map; peaks: chr, p_start, p_end, height, line. Every group must have an exon.

    unique: coords are known to have one exon for each key, as exons classified for peak maps have.
    """
    kind, spark = event(event_name), coords.sparkSession
    coords = coords if unique else rekeyed(coords, kind)
    sizes = summary.group_sizes(coords)
    if not all(sizes.values()):
        raise ValueError(f"no exons in a group: {sizes}")
    parts = overlap.region_overlaps(coords, written(overlap.distinct_peaks(peaks)), kind, shape).withColumnRenamed("height", "total")
    counts = parts.groupBy("grp", "exon_idx", "region", "pos").agg(F.sum("total").alias("total"))
    if kind.name == "RI":
        scaled = overlap.scaled_overlap(coords, peaks, kind, shape)
        counts, parts = counts.unionByName(scaled), parts.unionByName(scaled)
    cells = summary.grid(spark, motif.positions(kind, shape, clip=True))
    return Map(kind, sizes, counts, cells, _tested(counts, parts, cells, [], sizes, method, True, shape.window, permutations, seed, "total"), [], "total")


def write_coordinates(coords: DataFrame, kind: Event, out: str) -> None:
    """exon/{up,dn,bg}.coord.txt, folders in order, as coordinate replay reads them."""
    from ..operators.isoforms import header
    from ..sources.sinks import write_table

    names = [c for c in coords.columns if c not in ("grp", "exon_idx")]
    titles = header(kind)[3 : 5 + kind.coordinates]
    for g in GROUPS:
        rows = coords.where(F.col("grp") == g).orderBy("exon_idx")
        write_table(rows.select(*[F.col(c).alias(t) for c, t in zip(names, titles, strict=True)]), f"{out}/exon/{g}.coord.txt")


def write_motif_map(result: Map, out: str, method: str = "fisher", tables: bool = False, plot: bool = False) -> None:
    """Summaries of smallest p-values and draw points; with tables also count distributions and p-values, a folder for each motif;
    with plot also a map of each motif as an SVG file."""
    from ..sources.sinks import write_report, write_svg, write_table

    label = stats.HEADERS[stats.method_name(method)]
    for g in CONTRASTS:
        write_report(result.min_p(g), f"{out}/pVal.{g}.vs.bg.RNAmap.txt")
    write_table(result.labelled(result.points().orderBy(*result.keys, "region", "pos")), f"{out}/points.txt")
    if plot:
        # one pass over all motifs in order; the points of one map are held at a time
        rows = result.points().orderBy(*result.keys, "region", "pos").toLocalIterator(prefetchPartitions=True)
        for (name, expression), own in itertools.groupby(rows, lambda r: (r["motif"], r["regex"])):
            write_svg(result.tested.sparkSession, list(own), f"{out}/maps/{result.event.name}.{re.sub('[^A-Za-z0-9.-]', '_', name + '.' + expression)}.svg", result.event.labels, f"{name} {expression}", result.sizes)
    if tables:
        named = F.concat_ws(".", *result.keys).alias("RBP")
        for g in GROUPS:
            write_table(result.labelled(result.values(g)).select(named, F.col("region").alias("Region"), F.col("pos").alias("position"), "sum", "values"), f"{out}/countDist.{g}", "RBP")
        for g in CONTRASTS:
            write_table(result.labelled(result.tested).select(named, F.col("region").alias("Region"), F.col("pos").alias("position"), F.col(f"p_{g}").alias(label)), f"{out}/pVal.{g}.vs.bg", "RBP")


def write_clip_map(result: Map, out: str, method: str = "fisher", plot: bool = False) -> None:
    """Counts, combined counts, distributions and p-values; with plot also the map as an SVG file."""
    from ..sources.sinks import write_report, write_svg, write_table

    label = stats.HEADERS[stats.method_name(method)]
    rows = result.combined().orderBy("region", "pos")
    names = {"up": "upregulated", "dn": "downregulated", "bg": "background"}
    for g, name in names.items():
        write_report(result.labelled(rows).select(F.col("region").alias("Region"), F.col("pos").alias("Position"), F.col(g).alias("RawPeakCounts"), F.col(f"mean_{g}").alias("AverageRawPeakCount")), f"{out}/{name}.RNAmap.txt")
        write_table(result.labelled(result.values(g).orderBy("region", "pos")).select(F.col("region").alias("Region"), F.col("pos").alias("position"), "sum", "values"), f"{out}/count.dist.{name}.RNAmap.txt")
    tails = {"up": "up", "dn": "down", "bg": "background"}
    write_report(result.labelled(rows).select(F.col("region").alias("Region"), F.col("pos").alias("Position"), *[F.col(g).alias(f"RawPeakCounts_{t}") for g, t in tails.items()], *[F.col(f"mean_{g}").alias(f"AverageRawPeakCount_{t}") for g, t in tails.items()]), f"{out}/combined.RNAmap.txt")
    for g in CONTRASTS:
        write_report(result.labelled(result.tested.orderBy("region", "pos")).select(F.col("region").alias("Region"), F.col("pos").alias("position"), F.col(f"p_{g}").alias(label)), f"{out}/pVal.{g}.vs.bg.RNAmap.txt")
    if plot:
        drawn = result.points().drop(*[f"mean_{g}" for g in GROUPS]).join(result.combined().select("region", "pos", *[f"mean_{g}" for g in GROUPS]), ["region", "pos"])
        rows = drawn.orderBy("region", "pos").collect()  # bounded: positions of one map
        write_svg(result.tested.sparkSession, rows, f"{out}/{result.event.name}.RNA.map.svg", result.event.labels, f"{result.event.name} RNA map", result.sizes)
