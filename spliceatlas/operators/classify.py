"""Events into up, down and background, and the deduplication between and within these classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import mean_of_list, number
from ..scratch import written
from ..specs import CONTRASTS, GROUPS, Event
from .numbering import first_rows, numbered


@dataclass(frozen=True)
class Cuts:
    """Thresholds of the classes. The background needs a false discovery rate above bg_fdr and levels on both sides of the cuts."""

    sig_fdr: float = 0.05
    sig_delta: float = 0.05
    bg_fdr: float = 0.5
    min_psi: float = 0.85
    max_psi: float = 0.15


MOTIF_CUTS = Cuts()
CLIP_CUTS = Cuts(bg_fdr=0.3, min_psi=0.95, max_psi=0.05)
CLIP_A5SS_CUTS = Cuts(sig_fdr=0.005, sig_delta=0.01, bg_fdr=0.3, min_psi=0.95, max_psi=0.05)
EXON_SET_CUTS = Cuts(bg_fdr=0.5)
LEAST_FPKM = 5.0


def class_of(fdr: Column, delta: Column, psi1: Column, psi2: Column, cuts: Cuts, also: Column | None = None) -> Column:
    """up, dn, bg or null. Missing values (nulls; number() makes NaN null) satisfy no comparison; `also` restricts the background."""
    significant = fdr < cuts.sig_fdr
    spread = psi1.isNotNull() & psi2.isNotNull() & (F.least(psi1, psi2) < cuts.min_psi) & (F.greatest(psi1, psi2) > cuts.max_psi)
    background = ~significant & (fdr > cuts.bg_fdr) & spread
    if also is not None:
        background &= also
    return F.when(significant & (delta >= cuts.sig_delta), "up").when(significant & (delta <= -cuts.sig_delta), "dn").when(background, "bg")


def measured(events: DataFrame, event: Event, analysis: str) -> DataFrame:
    """line, key, coords, fdr, delta, psi1, psi2 of event rows (line, f). Statistics are the last four fields."""
    f = F.col("f")
    width = event.key_columns if analysis == "motif" else 4
    return events.select(
        "line",
        F.array_join(F.slice(f, 4, width), ":").alias("key"),
        F.slice(f, 4, 2 + event.coordinates).alias("coords"),
        number(F.try_element_at(f, F.lit(-4))).alias("fdr"),
        number(F.try_element_at(f, F.lit(-1))).alias("delta"),
        mean_of_list(F.try_element_at(f, F.lit(-3))).alias("psi1"),
        mean_of_list(F.try_element_at(f, F.lit(-2))).alias("psi2"),
    )


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row for each key: the value of its last row, and `first`, the place of its first."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias("first"))


def exclusive(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows whose key is in one class only. Classes are few, so counting needs no row of a key to meet another."""
    single = df.groupBy(key).agg(F.min(kind).alias("_a"), F.max(kind).alias("_b")).where(F.col("_a") == F.col("_b")).select(key)
    return df.join(single, key, "left_semi")


def _least_change(coords: Column) -> Column:
    return F.struct(F.abs("delta").alias("a"), (-F.col("fdr")).alias("b"), coords.alias("coords"))


def fallback_background(candidates: DataFrame, taken: DataFrame, n: int) -> DataFrame:
    """The n candidates with the smallest changes: ordered by |delta|, larger fdr, key, coords; one for each key, none of `taken`.

    candidates: key, coords, fdr, delta. Returns key, coords and pos, the place in that order.
    """
    best = candidates.groupBy("key").agg(F.min(_least_change(F.col("coords"))).alias("s"))
    return _ordered(best.join(taken.select("key"), "key", "left_anti"), n)


def _ordered(best: DataFrame, n: int) -> DataFrame:
    """key, coords and pos of the n rows of best (key, s) that come first."""
    return first_rows(best, [F.col(c) for c in ("s.a", "s.b", "key", "s.coords")], n, "pos").select("key", F.col("s.coords").alias("coords"), "pos")


def classify(events: DataFrame, event: Event, cuts: Cuts, analysis: str = "motif") -> DataFrame:
    """grp, key, coords and place of the exclusive members of each class, with a fallback background where there is none at all."""
    return classified(measured(events, event, analysis), cuts, analysis)


def classified(rows: DataFrame, cuts: Cuts, analysis: str = "motif") -> DataFrame:
    """As classify, of measured rows (line, key, coords, fdr, delta, psi1, psi2).

    The fallback applies if no row is background before members of several classes are removed. It takes as many
    rows as the larger of the two sets (at least 1; for motifs a quarter of both sets together, at least 200).
    Whether there is background is seen in a scan; where there is, rows of no class play no part, and no smallest changes are kept. A key's last row and first
    place in each class are then found together and written, and the sizes of the classes are counted while that is written.
    """
    rows = rows.withColumn("grp", class_of(F.col("fdr"), F.col("delta"), F.col("psi1"), F.col("psi2"), cuts))
    own = {g: F.col("grp") == g for g in GROUPS}
    of_class = [F.struct(F.max_by(F.when(own[g], F.col("coords")), F.when(own[g], F.col("line"))).alias("coords"), F.min(F.when(own[g], F.col("line"))).alias("first")) for g in GROUPS]
    if not rows.where(own["bg"] & F.col("coords").isNotNull() & F.col("line").isNotNull()).isEmpty():
        # the class goes with its value: one pair of columns instead of one for each class
        pairs = rows.where(F.col("grp").isNotNull() & F.col("coords").isNotNull() & F.col("line").isNotNull()).groupBy("key").agg(F.min("grp").alias("grp"), F.max("grp").alias("other"), F.max_by("coords", "line").alias("coords"), F.min("line").alias("first"))
        kept = pairs.where(F.col("grp") == F.col("other"))
        return written(kept.select("grp", "key", "coords", "first", F.lit(None).cast("bigint").alias("pos")))
    possible = F.col("delta").isNotNull() & (F.col("fdr") >= cuts.sig_fdr)
    keys = rows.groupBy("key").agg(*[x.alias(g) for x, g in zip(of_class, GROUPS, strict=True)], F.min(F.when(possible, _least_change(F.col("coords")))).alias("s"))
    n_classes = sum(F.col(f"{g}.coords").isNotNull().cast("int") for g in GROUPS)
    keys = keys.withColumn("classes", n_classes).where((F.col("classes") > 0) | F.col("s").isNotNull())
    seen = Observation()
    only = {g: (F.col("classes") == 1) & F.col(f"{g}.coords").isNotNull() for g in GROUPS}
    keys = written(keys.observe(seen, *[F.count_if(only[g]).alias(f"only_{g}") for g in CONTRASTS]))
    kept = keys.where("classes = 1").select(F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), "key", f"{g}.coords", f"{g}.first") for g in GROUPS])).alias("m")).where("m.coords is not null")
    kept = kept.select("m.*", F.lit(None).cast("bigint").alias("pos"))
    sizes = seen.get
    nu, nd = sizes["only_up"], sizes["only_dn"]
    n = max(200, int((max(nu, 1) + max(nd, 1)) / 4)) if analysis == "motif" else max(1, max(nu, nd))
    extra = _ordered(keys.where("classes = 0").select("key", "s"), n)
    return kept.unionByName(extra.select(F.lit("bg").alias("grp"), "key", "coords", F.lit(None).cast(kept.schema["first"].dataType).alias("first"), "pos"))


def coordinates(members: DataFrame, event: Event) -> DataFrame:
    """grp, exon_idx (place in the group), chr, strand, c2..: typed coordinates of classified members."""
    c = F.col("coords")
    return numbered(members, "grp", ["first", "pos"], "exon_idx").select("grp", "exon_idx", c[0].alias("chr"), c[1].alias("strand"), *[c[k].cast("bigint").alias(f"c{k}") for k in range(2, 2 + event.coordinates)])


def rekeyed(coords: DataFrame, event: Event) -> DataFrame:
    """Coordinates with one exon for each key (chromosome, strand and the first positions): the last row's values in the first row's place."""
    names = [f"c{k}" for k in range(2, 2 + event.coordinates)]
    key = ["grp", "chr", "strand", *names[: event.key_columns - 2]]
    agg = coords.groupBy(*key).agg(F.max_by(F.struct(*names), "exon_idx").alias("s"), F.min("exon_idx").alias("first"))
    return numbered(agg, "grp", ["first"], "exon_idx").select("grp", "exon_idx", "chr", "strand", *[F.col(f"s.{n}").alias(n) for n in names])
