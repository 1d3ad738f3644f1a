"""Source divergence audit: how far the term frequencies of a source lie from those of the other sources of its language, and by which terms.

Plain relational: the runs of letters of a text are exploded and counted, groups (language and source) meet the kept vocabulary of their
language, which puts zeros in, the dense table joins itself by term, squared differences are summed and windows rank them. All
arithmetic is on integers: probabilities are whole billionths, rounded down, and never 0.

The text is read once; counts are combined before the shuffle and written. A kept term of a language has an id, a group has one too, so the
dense table and its join hold numbers only. Languages are few, so what is known of one (its groups, its totals) goes to salted
copies of the vocabulary instead of meeting all of it in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, prepared

#: What lies between terms: runs of all of ASCII but A-Z and a-z.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, MOST_TERMS, SCALE = 3, 200, 1_000_000_000
#: Places over which the vocabulary of a language is spread.
SALTS = 64


def _lowered(text: str) -> Column:
    """A-Z lowered and nothing else; lower() does that to ASCII only, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it) of docs (lang, source, text).

    Splitting at what lies between terms gives the matches, several times as fast as regexp_extract_all. Each row explodes its terms
    and, behind them, its distinct terms.
    """
    rows = docs.select("lang", "source", F.split(_lowered("text"), BETWEEN).alias("words"))
    rows = rows.select("lang", "source", F.size("words").alias("k"), F.posexplode(F.concat("words", F.array_distinct("words"))).alias("i", "term"))
    rows = rows.where("term <> ''")  # what splitting leaves at the ends of a text
    once = F.col("i") >= F.col("k")
    return rows.groupBy("lang", "source", "term").agg(F.sum((~once).cast("int")).alias("n"), F.sum(once.cast("int")).alias("docs"))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), in decimals, as the product passes 64 bits."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _everywhere(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank (from 1 in each group and part: value descending, item ascending by bytes).

    A language keeps the terms that at least `least` of its rows hold. With p of a group and q of what it is held against (1 +
    floor(10^9 (count + 1) / (N + V)) over the V kept terms), f = floor((p - q)^2 / q). Part `pair`: item is each other source of the
    language, value the sum of f over all kept terms. Part `term`: item is each kept term that the group holds and whose p
    exceeds the language's, value is f, ranks up to `most` only.

    Null texts, languages and sources are empty strings; rows, repeated ones too, are documents of their own, whatever their ids;
    groups without terms have their pairs; a language that keeps no term has pairs of value 0. Texts of any length
    are read whole. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(prepared(docs.sparkSession))
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups = scratch.save(docs.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    counts = scratch.save(term_counts(docs), "counts")
    # a term with its counts in the sources of its language: as wide as a language has sources, of which the result holds all pairs
    held = F.collect_list(F.struct("source", "n")).alias("held")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), held).where(F.col("docs") >= least)
    kept = scratch.save(kept.select(F.monotonically_increasing_id().alias("id"), "lang", "term", "n", "held"), "kept")
    sizes = kept.groupBy("lang").agg((F.sum("n") + F.count("*")).alias("total"), F.count("*").alias("v"))
    own = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("own"))
    # what is known of a group: its total, and that of its language, both with the V that smoothing adds
    known = groups.join(sizes, "lang").join(own, ["lang", "source"], "left").select("g", "lang", "source", "total", (F.coalesce("own", F.lit(0)) + F.col("v")).alias("own"))
    known = scratch.save(known, "known")
    n = F.coalesce(F.try_element_at(F.map_from_entries("held"), F.col("source")), F.lit(0))
    crossed = _salted(kept.select("id", "lang", "n", "held"), "id").join(_everywhere(known), ["lang", "salt"])
    dense = crossed.select("id", "g", n.alias("n"), _share(n, F.col("own")).alias("p"), _share(F.col("n"), F.col("total")).alias("q"))
    dense = scratch.save(dense, "dense")

    sums = dense.select("id", "g", "p").join(dense.select("id", F.col("g").alias("h"), F.col("p").alias("q")).hint("merge"), "id").where("g <> h")
    sums = sums.groupBy("g", "h").agg(F.sum(_distance(F.col("p"), F.col("q"))).alias("value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").where("g <> h").join(sums, ["g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    terms = dense.where("n > 0 and p > q").select("id", "g", _distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.join(kept.select("id", F.col("term").alias("item")), "id").join(groups, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(terms.select("*", rank).where(F.col("rank") <= most))
