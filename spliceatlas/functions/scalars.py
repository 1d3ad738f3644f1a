"""Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n"


def stripped(col: Column) -> Column:
    """Without white space at both ends; trim alone takes spaces only."""
    return F.regexp_replace(col, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def number(col: Column) -> Column:
    """A double, or null for what is not a number; NaN and infinities count as missing (comparisons with NaN are false)."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x), x)


def mean_of_list(col: Column, empty: float | None = None) -> Column:
    """Mean of the numbers in a comma-separated field; quotes and other tokens are skipped; `empty` if there are none."""
    values = F.filter(F.transform(F.split(F.regexp_replace(col, '"', ""), ","), lambda t: number(t)), lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.when(F.size(values) > 0, F.size(values))
    return mean if empty is None else F.coalesce(mean, F.lit(empty))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def steps_between(low: Column, high: Column) -> Column:
    """low..high inclusive, empty if high is below low (sequence would count down)."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
