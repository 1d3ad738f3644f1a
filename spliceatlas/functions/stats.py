"""One-sided two-sample tests on counts, from sums or from value histograms, and their column forms.

Rank tests need no dense arrays: how often each value occurs in either sample gives midranks, ties and variances. Only
the permutation test takes the values themselves.
"""

from __future__ import annotations

import json
import math
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ColumnOrName = Column | str

#: Accepted names of the tests, and the header of the p-value column of each.
METHODS = {
    "fisher": "fisher",
    "mannwhitney": "mannwhitney_greater",
    "mannwhitney_greater": "mannwhitney_greater",
    "brunnermunzel": "brunnermunzel_greater",
    "brunnermunzel_greater": "brunnermunzel_greater",
    "permutation": "permutation_one_sided",
    "permutation_one_sided": "permutation_one_sided",
}
HEADERS = {
    "fisher": "fisher.exact.pVal",
    "mannwhitney_greater": "mannwhitney.greater.pVal",
    "brunnermunzel_greater": "brunnermunzel.greater.pVal",
    "permutation_one_sided": "permutation.oneSided.pVal",
}
PERMUTATIONS, SEED, LEAST_PERMUTATIONS = 500, 1337, 50


def permutation_settings() -> tuple[int, int]:
    """Number of permutations and seed: from SPLICEATLAS_STAT_PERMUTATIONS (at least 50) and SPLICEATLAS_STAT_SEED (at least 0), where these
    are set to such numbers, else the defaults."""

    def read(name: str, default: int, least: int) -> int:
        text = os.environ.get(name, "").strip()
        return int(text) if re.fullmatch(r"[+-]?[0-9]{1,18}", text) and int(text) >= least else default

    return read("SPLICEATLAS_STAT_PERMUTATIONS", PERMUTATIONS, LEAST_PERMUTATIONS), read("SPLICEATLAS_STAT_SEED", SEED, 0)


def method_name(name: str | None) -> str:
    """The test a name stands for; unknown names mean Fisher's."""
    return METHODS.get((name or "fisher").strip().lower(), "fisher")


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """P(X >= a) for the table [[a, b], [c, d]] with fixed margins; 1 if a margin is 0."""
    if min(a + b, c + d, a + c, b + d) <= 0:
        return 1.0
    row, col, total = a + b, a + c, a + b + c + d
    x = np.arange(a, min(row, col) + 1, dtype=float)

    def log_choose(n, k):
        return _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)

    logs = log_choose(float(col), x) + log_choose(float(total - col), row - x) - log_choose(float(total), float(row))
    return float(min(1.0, np.exp(logs).sum()))


def _log_gamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _normal_above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _ranked(v1, c1, v2, c2):
    values = np.union1d(v1, v2)
    n1, n2 = np.zeros(len(values)), np.zeros(len(values))
    n1[np.searchsorted(values, v1)] += c1
    n2[np.searchsorted(values, v2)] += c2
    return values, n1, n2


def _midranks(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - (counts - 1) / 2


def mann_whitney_parts(v1, c1, v2, c2) -> tuple[float, float, float, bool]:
    """U of the first sample, its mean and standard deviation without it, and whether values tie."""
    _, n1, n2 = _ranked(v1, c1, v2, c2)
    both = n1 + n2
    a, b, n = n1.sum(), n2.sum(), both.sum()
    u = float((n1 * _midranks(both)).sum() - a * (a + 1) / 2)
    ties = float((both**3 - both).sum())
    return u, a * b / 2, math.sqrt(max(0.0, a * b / 12 * ((n + 1) - (ties / (n * (n - 1)) if n > 1 else 0.0)))), ties > 0


def mann_whitney_greater(v1, c1, v2, c2) -> float:
    """Exact for a sample of at most 8 without ties, else the normal approximation with continuity correction."""
    u, mean, sd, ties = mann_whitney_parts(v1, c1, v2, c2)
    a, b = int(np.sum(c1)), int(np.sum(c2))
    if min(a, b) <= 8 and not ties:
        return _exact_above(u, a, b)
    return 1.0 if sd == 0 else _normal_above((u - mean - 0.5) / sd)


def _exact_above(u: float, a: int, b: int) -> float:
    small, large = min(a, b), max(a, b)
    # number of ways to reach each U: partitions into at most `small` parts of at most `large`
    ways = np.zeros(small * large + 1)
    ways[0] = 1
    for k in range(1, small + 1):
        top = large + k
        for s in range(len(ways) - 1, top - 1, -1):
            ways[s] -= ways[s - top]
        for s in range(k, len(ways)):
            ways[s] += ways[s - k]
    return float(ways[int(math.ceil(u)) :].sum() / ways.sum())


def brunner_munzel_statistic(v1, c1, v2, c2) -> tuple[float, float, float]:
    """The statistic (infinite or NaN without variance), its numerator and its denominator."""
    _, n1, n2 = _ranked(v1, c1, v2, c2)
    a, b = n1.sum(), n2.sum()
    pooled = _midranks(n1 + n2)
    mean1, mean2 = (n1 * pooled).sum() / a, (n2 * pooled).sum() / b
    s1 = (n1 * (pooled - _midranks(n1) - mean1 + (a + 1) / 2) ** 2).sum() / (a - 1)
    s2 = (n2 * (pooled - _midranks(n2) - mean2 + (b + 1) / 2) ** 2).sum() / (b - 1)
    top, below = float(a * b * (mean2 - mean1)), float((a + b) * math.sqrt(a * s1 + b * s2))
    return (top / below if below else math.copysign(math.inf, top) if top else math.nan), top, below


def brunner_munzel_greater(v1, c1, v2, c2, guarded: bool) -> float:
    """Normal form. guarded: samples of fewer than two or of equal values give 1; otherwise no variance gives 0 or 1 by the sign, or NaN."""
    sizes = [np.asarray(c, float) for c in (c1, c2)]
    if guarded and (min(c.sum() for c in sizes) < 2 or min((c > 0).sum() for c in sizes) < 2):
        return 1.0
    if min(c.sum() for c in sizes) < 2:
        return math.nan
    w = brunner_munzel_statistic(v1, c1, v2, c2)[0]
    return w if math.isnan(w) else 1 - _normal_above(w)


def permutation_greater(first: np.ndarray, second: np.ndarray, permutations: int, rng: np.random.Generator) -> float:
    """The test of one pair of samples."""
    pooled = np.concatenate([first, second])
    at = np.flatnonzero(pooled)
    return float(permuted_greater(np.zeros(len(at), np.int64), at, pooled[at], 1, len(first), len(second), permutations, rng)[0])


def permuted_greater(key: np.ndarray, at: np.ndarray, values: np.ndarray, keys: int, n1: int, n2: int, permutations: int, rng: np.random.Generator) -> np.ndarray:
    """p-values of several keys under the same permutations of n1 + n2 places, of which the first n1 are the first sample.

    values (whole numbers, so that sums are exact in any order) lie at places `at` of their keys; all other places hold 0.
    """
    places, column = np.unique(at, return_inverse=True)
    table = np.zeros((len(places), keys))
    np.add.at(table, (column, key), values)
    whole = table.sum(0)
    above = table[places < n1].sum(0)
    observed = above / n1 - (whole - above) / n2
    reached = np.zeros(keys, np.int64)
    for lo in range(0, permutations, 64):
        taken = np.zeros((min(64, permutations - lo), n1 + n2), bool)
        for row in taken:
            row[rng.permutation(n1 + n2)[:n1]] = True
        sums = taken[:, places].astype(float) @ table
        reached += (sums / n1 - (whole - sums) / n2 >= observed).sum(0)
    return (reached + 1.0) / (permutations + 1.0)


def stream(seed: int, state: str | None = None) -> np.random.Generator:
    """The random stream of a seed, from its start or from a state of stream_states."""
    rng = np.random.default_rng(seed)
    if state is not None:
        rng.bit_generator.state = json.loads(state)
    return rng


def stream_states(n: int, positions: int, permutations: int, seed: int) -> list[str]:
    """States of the stream before each position, if every position permutes n values so many times. What is permuted does not matter."""
    rng, values, out = stream(seed), np.zeros(n, np.int8), []
    for _ in range(positions):
        out.append(json.dumps(rng.bit_generator.state))
        for _ in range(permutations):
            rng.shuffle(values)
    return out


def bounded(p: float, clamp: bool) -> float:
    if not math.isfinite(p):
        return 1.0
    return min(1.0, max(0.0, p)) if clamp else p


#: Factorials up to this come from a table, larger ones from a series.
_TABLE = 20


def _log_factorial(n: Column) -> Column:
    """log n! of a whole number as a double, by Stirling's series from _TABLE on."""
    x = F.greatest(n, F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(_TABLE)])
    return F.when(n < _TABLE, F.get(small, n.cast("int"))).otherwise(series)


def fisher_column(s1: ColumnOrName, n1: ColumnOrName, s2: ColumnOrName, n2: ColumnOrName, scale: Column) -> Column:
    """Fisher's one-sided p-value of sums s and sample sizes n, the cells divided by scale and rounded up; empty samples and margins of 0 give 1.

    Stays in the JVM: the first term of the tail follows from log-factorials, each further one from the one before. Above the mode the
    upper tail is summed, below it the lower one, so that terms only fall; terms more than forty standard deviations on are 0.
    """
    s1, n1, s2, n2 = (F.col(c) if isinstance(c, str) else c for c in (s1, n1, s2, n2))
    cells = [F.ceil(x / scale).cast("double") for x in (s1, F.greatest(F.lit(0), n1 - s1), s2, F.greatest(F.lit(0), n2 - s2))]
    counts = F.struct(*[x.alias(n) for x, n in zip(cells, "abcd", strict=True)])

    def p_value(t: Column) -> Column:
        a, row, col, total = t["a"], t["row"], t["col"], t["total"]
        free = total - row - col  # what the fourth cell holds beyond the first one
        lf = _log_factorial

        def term(x: Column) -> Column:
            return F.exp(lf(col) - lf(x) - lf(col - x) + lf(total - col) - lf(row - x) - lf(free + x) - lf(total) + lf(row) + lf(total - row))

        spread = F.sqrt(row / total * col * ((total - row) / total) * ((total - col) / total))
        most = F.ceil(40 * spread) + 100

        def tail(first: Column, steps: Column, ratio) -> Column:
            start = F.struct(term(first).alias("t"), F.lit(0.0).alias("s"))
            return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(steps.cast("bigint"), most)), start, lambda acc, k: F.struct((acc["t"] * ratio(k.cast("double"))).alias("t"), (acc["s"] + acc["t"]).alias("s")))["s"]

        least = F.greatest(F.lit(0.0), -free)
        up = tail(a, F.least(row, col) - a, lambda k: (col - a - k) * (row - a - k) / ((a + k + 1) * (free + a + k + 1)))
        down = tail(a - 1, a - 1 - least, lambda k: (a - 1 - k) * (free + a - 1 - k) / ((col - a + 2 + k) * (row - a + 2 + k)))
        above = a > F.floor((row + 1) * (col + 1) / (total + 2))
        p = F.when(a <= least, 1.0).when(above, up).otherwise(1 - down)
        return F.when(F.least(row, col, total - row, total - col) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))

    margins = F.transform(F.array(counts), lambda t: F.struct(t["a"].alias("a"), (t["a"] + t["b"]).alias("row"), (t["a"] + t["c"]).alias("col"), (t["a"] + t["b"] + t["c"] + t["d"]).alias("total")))
    return F.when((n1 == 0) | (n2 == 0), 1.0).otherwise(F.get(F.transform(margins, p_value), F.lit(0)))


def rank_column(method: str, clip: bool):
    """A column function of two histograms: values and counts of the first sample, then of the second."""

    @F.pandas_udf(DoubleType())
    def test(v1: pd.Series, c1: pd.Series, v2: pd.Series, c2: pd.Series) -> pd.Series:
        out = []
        for a, m, b, n in zip(v1, c1, v2, c2, strict=True):
            a, m, b, n = (np.asarray(x, float) for x in (a, m, b, n))
            if not m.sum() or not n.sum():
                p = 1.0
            elif method == "mannwhitney_greater":
                p = mann_whitney_greater(a, m, b, n)
            else:
                p = brunner_munzel_greater(a, m, b, n, clip)
            out.append(bounded(p, clip))
        return pd.Series(out, dtype=float)

    return test
