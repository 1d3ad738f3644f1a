"""Conversion of isoform-level tables (Bayes factors) to event tables, and exon sets by expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mean_of_list, number
from ..specs import Event
from .classify import EXON_SET_CUTS, LEAST_FPKM, Cuts, class_of, exclusive, last_wins

#: Header names of the coordinates of each event type in converted tables.
HEADERS = {
    "SE": "exonStart_0base exonEnd upstreamES upstreamEE downstreamES downstreamEE",
    "A3SS": "longExonStart_0base longExonEnd shortES shortEE flankingES flankingEE",
    "A5SS": "longExonStart_0base longExonEnd shortES shortEE flankingES flankingEE",
    "RI": "riExonStart_0base riExonEnd upstreamES upstreamEE downstreamES downstreamEE",
    "MXE": "1stExonStart_0base 1stExonEnd 2ndExonStart_0base 2ndExonEnd upstreamES upstreamEE downstreamES downstreamEE",
}
#: Which parts of the isoform string become the coordinates on either strand, and what is added to each. Parts are
#: numbered as parsed: sK, eK are start and end of exon K; a and b the two sides of the varying end. The minus-strand forms of A3SS and RI
#: subtract two from one end and use it as a start.
LAYOUT = {
    "SE": {"+": "s2-1 e2 s1-1 e1 s3-1 e3", "-": "s2-1 e2 s3-1 e3 s1-1 e1"},
    "A3SS": {"+": "a-1 e2 b-1 e2 s1-1 e1", "-": "e2-2 b e2-2 a s1-1 e1"},
    "A5SS": {"+": "s1-1 b s1-1 a s2-1 e2", "-": "a-1 s1 b-1 s1 s2-1 e2"},
    "RI": {"+": "s1-1 e2 s1-1 e1 s2-1 e2", "-": "e2-2 s1 e2-2 s2 e1-1 s1"},
    "MXE": {"+": "s2-1 e2 s3-1 e3 s1-1 e1 s4-1 e4", "-": "s3-1 e3 s2-1 e2 s4-1 e4 s1-1 e1"},
}


def false_discovery_tier(bayes: Column, low: float, high: float) -> Column:
    return F.when(bayes >= high, 0.01).when(bayes <= low, 1.0).otherwise(0.4)


def isoform_count(counts: Column, isoform: str) -> Column:
    """The count of isoform 0 or 1 in a list like 0:12,1:7, the last one given; 0 if missing; other isoforms fail."""
    pairs = F.transform(F.split(counts, ","), lambda p: F.split(p, ":"))
    wrong = F.exists(pairs, lambda p: ~p[0].isin("0", "1"))
    own = F.filter(pairs, lambda p: p[0] == isoform)
    return F.when(wrong, F.raise_error(F.concat(F.lit("expecting isoform 0 or 1: "), counts))).otherwise(F.coalesce(F.try_element_at(own, F.lit(-1))[1].cast("int"), F.lit(0)))


def parsed(iso: Column, event: Event) -> dict[str, Column]:
    """Parts of an isoform string by the names LAYOUT uses."""
    exons = F.split(iso, "@")
    out: dict[str, Column] = {}
    for k in range(4):
        parts = F.split(F.get(exons, F.lit(k)), ":")
        if event.name == "RI":
            ends = F.split(F.get(parts, F.lit(1)), "-")
            out[f"s{k + 1}"], out[f"e{k + 1}"] = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        else:
            out[f"s{k + 1}"], out[f"e{k + 1}"] = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    if event.name in ("A3SS", "A5SS"):
        sides = F.split(out["s2"] if event.name == "A3SS" else out["e1"], r"\|")
        out["a"], out["b"] = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    return out


def _laid_out(parts: dict[str, Column], layout: str) -> list[Column]:
    return [(parts[name].cast("bigint") - int(less or 0)).cast("string") for name, _, less in (x.partition("-") for x in layout.split())]


def convert(rows: DataFrame, event: Event, bayes_low: float = 1, bayes_high: float = 100) -> DataFrame:
    """line and f, the fields of an event table, from isoform rows (line, f of 18 fields).

    On a strand other than + and - the coordinates are missing and the row is shorter.
    """
    f = F.col("f")
    bayes = f[8].cast("double")
    parts = parsed(f[9], event)
    coords = F.when(f[15] == "+", F.array(*_laid_out(parts, LAYOUT[event.name]["+"]))).when(f[15] == "-", F.array(*_laid_out(parts, LAYOUT[event.name]["-"]))).otherwise(F.array().cast("array<string>"))
    na = F.lit("NA")
    counts = [isoform_count(f[column], k).cast("string") for column in (11, 13) for k in ("0", "1")]
    head = F.array(na, na, na, f[14], f[15])
    tail = F.array(na, *counts, F.lit("0"), F.lit("0"), F.pow(F.lit(10.0), -bayes).cast("string"), false_discovery_tier(bayes, bayes_low, bayes_high).cast("string"), f[1], f[4], f[7])
    return rows.select("line", F.concat(head, coords, tail).alias("f"))


def header(event: Event) -> list[str]:
    return ["ID", "GeneID", "geneSymbol", "chr", "strand", *HEADERS[event.name].split(), "ID", "IC_SAMPLE_1", "SC_SAMPLE_1", "IC_SAMPLE_2", "SC_SAMPLE_2", "IncFormLen", "SkipFormLen", "PValue", "FDR", "IncLevel1", "IncLevel2", "IncLevelDifference"]


def exon_sets(rows: DataFrame, cuts: Cuts = EXON_SET_CUTS, least_fpkm: float = LEAST_FPKM) -> DataFrame:
    """set (up, dn, bg), cols (ten fields) and first, from rows (line, f) with expression columns; statistics count from the left here."""
    f = F.col("f")
    table = rows.select(
        "line",
        F.array_join(F.slice(f, 4, 4), ":").alias("key"),
        F.slice(f, 2, 10).alias("cols"),
        class_of(number(F.get(f, F.lit(19))), number(F.get(f, F.lit(22))), mean_of_list(F.get(f, F.lit(20)), 0.0), mean_of_list(F.get(f, F.lit(21)), 0.0), cuts, F.least(number(F.try_element_at(f, F.lit(-6))), number(F.try_element_at(f, F.lit(-5)))) > least_fpkm).alias("set"),
    )
    return exclusive(last_wins(table.where(F.col("set").isNotNull()), ["set", "key"], "cols", "line"), "key", "set")
