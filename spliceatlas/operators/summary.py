"""Per-position totals, p-values and their summaries. Counts come sparse; the grid of positions puts the zeros back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..shipping import session_of
from ..specs import CONTRASTS, GROUPS, SE_SUMMARY, Event

#: Keys of a position that a task permutes together.
PERMUTED = 128


def grid(spark: SparkSession, positions: list[tuple[int, int]], keys: DataFrame | None = None) -> DataFrame:
    """region, pos (and the columns of keys): every position of every region. A region table of a few rows is exploded."""
    df = spark.createDataFrame([(k, n) for k, n in positions if n > 0], "region int, n int").select("region", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return df if keys is None else keys.crossJoin(F.broadcast(df))


def group_sizes(coords: DataFrame) -> dict[str, int]:
    found = {r["grp"]: r["count"] for r in coords.groupBy("grp").count().collect()}
    return {g: found.get(g, 0) for g in GROUPS}


def totals(counts: DataFrame, cells: DataFrame, keys: list[str], value: str = "cnt") -> DataFrame:
    """keys, region, pos and the sums up, dn and bg of all exons of each group."""
    on = [*keys, "region", "pos"]
    sums = counts.groupBy(*on).pivot("grp", list(GROUPS)).agg(F.sum(value))
    return cells.join(sums, on, "left").select(*on, *[F.coalesce(F.col(g), F.lit(0)).cast("bigint").alias(g) for g in GROUPS])


def fisher(total: DataFrame, sizes: dict[str, int], scale: int = 1) -> DataFrame:
    """Adds p_up and p_dn: Fisher's one-sided test of sums against the background's, cells divided by scale."""
    for g in CONTRASTS:
        total = total.withColumn(f"p_{g}", stats.fisher_column(F.col(g), F.lit(sizes[g]), F.col("bg"), F.lit(sizes["bg"]), F.lit(scale)))
    return total


def histograms(counts: DataFrame, cells: DataFrame, keys: list[str], sizes: dict[str, int], value: str = "cnt") -> DataFrame:
    """keys, region, pos and for each group g the arrays v_g and c_g: values over all exons, zeros included, and how often they occur."""
    on = [*keys, "region", "pos"]
    bars = counts.where(F.col(value) != 0).groupBy(*on, "grp", value).agg(F.count("*").alias("c"))
    lists = bars.groupBy(*on).agg(*[F.array_sort(F.collect_list(F.when(F.col("grp") == g, F.struct(F.col(value).cast("double").alias("v"), F.col("c").cast("double").alias("c"))))).alias(g) for g in GROUPS])
    df = cells.join(lists, on, "left")
    for g in GROUPS:
        got = F.coalesce(F.col(g), F.array().cast("array<struct<v:double,c:double>>"))
        zero = F.lit(float(sizes[g])) - F.aggregate(got, F.lit(0.0), lambda a, s: a + s["c"])
        df = df.withColumn(f"v_{g}", F.concat(F.array(F.lit(0.0)), F.transform(got, lambda s: s["v"]))).withColumn(f"c_{g}", F.concat(F.array(zero), F.transform(got, lambda s: s["c"])))
    return df.drop(*GROUPS)


def rank_test(hist: DataFrame, method: str, clip: bool) -> DataFrame:
    session_of(hist)
    test = stats.rank_column(method, clip)
    for g in CONTRASTS:
        hist = hist.withColumn(f"p_{g}", test(f"v_{g}", f"c_{g}", "v_bg", "c_bg"))
    return hist


def permutation_test(counts: DataFrame, cells: DataFrame, keys: list[str], sizes: dict[str, int], permutations: int, seed: int, shared: bool, value: str = "cnt") -> DataFrame:
    """p_up and p_dn by permutation of the exons' values (whole numbers) in exon order.

    shared: one random stream runs through all positions of a key, in order of region and position; otherwise every position starts the
    stream anew. How much of it a position takes depends on sample sizes only, so its state at each position is found once, for all keys, and
    positions are then tested anywhere, PERMUTED keys of a position at a time: a permutation serves all of them. Positions without counts
    have p 1. The states of all positions of a map (bounded by its shape) go along with the function.
    """
    spark = session_of(counts)
    on = [*keys, "region", "pos"]
    states: dict[tuple[str, int, int], str] = {}
    if shared:
        places = sorted((r["region"], r["pos"]) for r in cells.select("region", "pos").distinct().collect())
        lengths = spark.createDataFrame([(g, sizes[g] + sizes["bg"]) for g in CONTRASTS if sizes[g] and sizes["bg"]], "grp string, n bigint").repartition("grp")

        def walk(frames):
            for frame in frames:
                for g, n in zip(frame["grp"], frame["n"], strict=True):
                    yield pd.DataFrame({"grp": g, "at": range(len(places)), "state": stats.stream_states(int(n), len(places), permutations, seed)})

        states = {(r["grp"], *places[r["at"]]): r["state"] for r in lengths.mapInPandas(walk, "grp string, at int, state string").collect()}

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        place = (int(frame["region"].iloc[0]), int(frame["pos"].iloc[0]))
        which = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(frame), np.int64)
        out = frame.assign(k=which).drop_duplicates("k").sort_values("k")[on].copy()
        for g in CONTRASTS:
            p = np.ones(len(out))
            if sizes[g] and sizes["bg"]:
                own = frame["grp"].isin([g, "bg"]).to_numpy()
                at = frame["exon_idx"].to_numpy()[own] + np.where(frame["grp"].to_numpy()[own] == "bg", sizes[g], 0)
                p = stats.permuted_greater(which[own], at, frame["v"].to_numpy()[own], len(out), sizes[g], sizes["bg"], permutations, stats.stream(seed, states.get((g, *place))))
            out[f"p_{g}"] = p
        return out

    rows = counts.select(*on, "grp", F.col("exon_idx").cast("bigint").alias("exon_idx"), F.col(value).cast("double").alias("v"))
    lots = F.lit(0)
    if keys:
        n = counts.select(*keys).distinct().count()
        lots = F.pmod(F.xxhash64(*keys), F.lit(-(-n // PERMUTED) or 1))
    schema = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in on) + ", p_up double, p_dn double"
    tested = rows.withColumn("lot", lots).groupBy("region", "pos", "lot").applyInPandas(test, schema)
    return cells.join(tested, on, "left").select(*on, *[F.coalesce(f"p_{g}", F.lit(1.0)).alias(f"p_{g}") for g in CONTRASTS])


def combined(total: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Adds the means per exon; empty if a group is empty."""
    out = total.select("*", *[(F.col(g) / F.lit(float(max(sizes[g], 1)))).alias(f"mean_{g}") for g in GROUPS])
    return out if all(sizes.values()) else out.limit(0)


def draw_points(tested: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Mean scores, held at 1, and -log10 of the p-values of each position (infinite for 0)."""
    scores = [F.least(F.lit(1.0), F.col(g) / F.lit(float(max(1, sizes[g])))).alias(f"mean_{g}") for g in GROUPS]
    logs = [F.when(F.col(f"p_{g}") > 0, -F.log10(f"p_{g}")).otherwise(F.lit(float("inf"))).alias(f"nlp_{g}") for g in CONTRASTS]
    return tested.select("*", *scores, *logs)


def peak_values(points: DataFrame, keys: list[str]) -> DataFrame:
    """Largest mean score and largest -log10 p of each key, from tiny starting values."""
    return points.groupBy(*keys).agg(F.greatest(F.lit(1e-52), F.max(F.greatest("mean_up", "mean_dn", "mean_bg"))).alias("max_mean"), F.greatest(F.lit(1e-65), F.max(F.greatest("nlp_up", "nlp_dn"))).alias("max_nlp"))


def min_p_summary(tested: DataFrame, event: Event, contrast: str) -> DataFrame:
    """motif (name.regex) and the smallest p of each region, 1 for an empty one; sorted by the second region, then by motif."""
    names = [f"smallest_p_in_{x}" for x in SE_SUMMARY] if event.name == "SE" else list(event.labels)
    wide = tested.withColumn("RBP", F.concat_ws(".", "motif", "regex")).groupBy("RBP").pivot("region", list(range(len(names)))).agg(F.min(f"p_{contrast}"))
    return wide.select("RBP", *[F.coalesce(F.col(str(k)), F.lit(1.0)).alias(n) for k, n in enumerate(names)]).orderBy(names[1], "RBP")


def smallest(summary: DataFrame, name: str) -> DataFrame:
    """RBP and its smallest p over all regions; values outside (0, 1] are left out, zero included."""
    values = F.array(*[c for c in summary.columns if c != "RBP"])
    best = summary.select("RBP", F.array_min(F.filter(values, lambda p: (p > 0) & (p <= 1))).alias(name))
    return best.where(F.col(name).isNotNull()).groupBy("RBP").agg(F.min(name).alias(name))


def top_motifs(up: DataFrame, dn: DataFrame, n: int = 20) -> DataFrame:
    """The n motifs with the smallest up p-values, with both p-values (1 where missing) and their -log10."""
    both = smallest(up, "pval_up_vs_bg").join(smallest(dn, "pval_dn_vs_bg"), "RBP", "full").select("RBP", *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("pval_up_vs_bg", "pval_dn_vs_bg")])
    logs = [0 - F.log10(F.greatest(F.col(f"pval_{g}_vs_bg"), F.lit(1e-300))) for g in CONTRASTS]
    return both.withColumn("log_pval_up", logs[0]).withColumn("log_pval_dn", logs[1]).orderBy("pval_up_vs_bg", "RBP").limit(n)


def count_significant(p: Column, cut: float = 0.05) -> Column:
    return F.count_if(p < cut)


def value_lists(counts: DataFrame, cells: DataFrame, sizes: dict[str, int], group: str, keys: list[str], value: str = "cnt") -> DataFrame:
    """keys, region, pos, sum and values ([a,b,...] in exon order, zeros included) of one group."""
    on = [*keys, "region", "pos"]
    got = counts.where(F.col("grp") == group).groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col("exon_idx").cast("bigint").alias("k"), F.col(value).cast("string").alias("v")))).alias("m"), F.sum(value).alias("sum"))
    n = sizes[group]
    # each value with the zeros between it and the one before, then the zeros after the last
    places = F.transform("m", lambda x: x["k"])
    previous = F.concat(F.array(F.lit(-1).cast("bigint")), places)
    each = F.zip_with(F.col("m"), F.slice(previous, 1, F.size("m")), lambda x, k: F.concat(F.repeat(F.lit("0,"), (x["k"] - k - 1).cast("int")), x["v"]))
    rest = F.lit(n - 1).cast("bigint") - F.element_at(places, -1)
    listed = F.concat(F.array_join(each, ","), F.repeat(F.lit(",0"), rest.cast("int")))
    values = F.coalesce(listed, F.lit(",".join(["0"] * n)))
    return cells.join(got, on, "left").select(*on, F.coalesce("sum", F.lit(0)).alias("sum"), F.concat(F.lit("["), values, F.lit("]")).alias("values"))
