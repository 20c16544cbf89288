"""Rank statistics and trends."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.ordered import running_before


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null without spread, where the built-in function fails."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rank from 1, ties sharing the mean of their ranks. Ranks come from counts of distinct values, added up by ranges of values, so that no task sees them all."""
    groups = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranks = running_before(groups, value, {"_before": "_n"}, keys)
    ranks = ranks.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, the correlation of average ranks."""
    ranked = average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(correlation("_rx", "_ry").alias("rho"))


def _tie_groups(values: Column) -> Column:
    """Sizes of the groups of equal values, without single ones."""
    return F.filter(F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v))), lambda n: n > 1)


def kendall_theilsen(series: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), with_p: bool = False) -> DataFrame:
    """Kendall's tau-b, the Theil-Sen slope, n and the concordance sum s, over all pairs of points; with_p also the two-sided p.

    A series has few points (years), so its pairs are few.
    """
    rows = series.filter(F.col(y).isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("p"))
    rows = rows.withColumn("ties_x", _tie_groups(F.col("p.x"))).withColumn("ties_y", _tie_groups(F.col("p.y")))
    sized = rows.withColumn("n", F.size("p")).withColumn("a", F.explode("p")).withColumn("b", F.explode("p")).filter("a.x < b.x or (a.x = b.x and a.y < b.y)")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tied = lambda d: F.sum(F.when(d == 0, 1).otherwise(0))
    agg = sized.groupBy(*keys, "n").agg(
        F.sum(F.signum(dx) * F.signum(dy)).cast("long").alias("s"), tied(dx).alias("tx"), tied(dy).alias("ty"), F.count("*").alias("listed"),
        F.first("ties_x").alias("ties_x"), F.first("ties_y").alias("ties_y"), F.percentile(F.when(dx > 0, dy / dx), F.lit(0.5)).alias("slope"))
    # Pairs equal in both are not listed; they are ties in both.
    same = pairs - F.col("listed")
    tau = F.try_divide(F.col("s").cast("double"), F.sqrt((pairs - F.col("tx") - same) * (pairs - F.col("ty") - same)))
    out = agg.select(*keys, "n", "s", tau.alias("tau"), "slope", "ties_x", "ties_y")
    return (out.withColumn("p", kendall_p_column()) if with_p else out).drop("ties_x", "ties_y")


@lru_cache(maxsize=64)
def _inversions(n: int) -> tuple[int, ...]:
    """Number of permutations of n with k inversions, for each k."""
    counts = [1]
    for m in range(2, n + 1):
        new = [0] * (len(counts) + m - 1)
        for k, c in enumerate(counts):
            for j in range(m):
                new[k + j] += c
        counts = new
    return tuple(counts)


def kendall_p(n: int, s: int, ties_x: list[int] = (), ties_y: list[int] = ()) -> float:
    """Two-sided p-value of the concordance sum: exactly under all orders of n untied points; with ties (sizes of their groups) by the normal approximation."""
    if n < 2:
        return 1.0
    if len(ties_x) or len(ties_y):
        over = lambda f: [sum(f(t) for t in ties) for ties in (ties_x, ties_y)]
        a, b, c = over(lambda t: t * (t - 1) * (2 * t + 5)), over(lambda t: t * (t - 1)), over(lambda t: t * (t - 1) * (t - 2))
        variance = (n * (n - 1) * (2 * n + 5) - sum(a)) / 18 + b[0] * b[1] / (2 * n * (n - 1)) + (c[0] * c[1] / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
        return math.erfc(abs(s) / math.sqrt(2 * variance)) if variance > 0 else 1.0
    counts, total = _inversions(n), math.factorial(n)
    c = (n * (n - 1) // 2 - abs(s)) // 2  # discordant pairs, at the rarer side
    return min(1.0, 2 * sum(counts[: c + 1]) / total) if s else 1.0


def kendall_p_column(n: str = "n", s: str = "s", ties_x: str = "ties_x", ties_y: str = "ties_y") -> Column:
    """kendall_p as a column; in batches, for tables of many series."""

    @F.pandas_udf("double")
    def p(n: pd.Series, s: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kendall_p(int(a), int(b), list(c), list(d)) for a, b, c, d in zip(n, s, x, y, strict=True)])

    return p(F.col(n), F.col(s), F.col(ties_x), F.col(ties_y))


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """One row: n1, n2, the rank sum of the first group, and its U; null U under three values in either group."""
    ranked = average_rank(df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()), value, "_r")
    is1 = F.col(group) == first
    sums = ranked.agg(F.count_if(is1).alias("n1"), F.count_if(~is1).alias("n2"), F.sum(F.when(is1, F.col("_r"))).alias("rank_sum"))
    enough = (F.col("n1") >= 3) & (F.col("n2") >= 3)
    return sums.withColumn("u", F.when(enough, F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2))


def mann_whitney_p(n1: int, n2: int, u: float, ties: list[int] | None = None) -> float:
    """One-sided p-value that the first group is larger: exact for small untied groups, else normal with continuity."""
    if max(n1, n2) <= 8 and not ties:
        ways = _u_counts(n1, n2)
        return sum(ways[math.ceil(u) :]) / math.comb(n1 + n2, n1)
    n = n1 + n2
    lost = sum(t**3 - t for t in ties or ()) / (n * (n - 1))
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - lost))
    return 0.5 * math.erfc((u - n1 * n2 / 2 - 0.5) / sd / math.sqrt(2)) if sd else 1.0


@lru_cache(maxsize=64)
def _u_counts(n1: int, n2: int) -> tuple[int, ...]:
    """Ways to reach each U: choices of n1 of n1 + n2 ranks."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for below in range(n1 + n2):
        for k in range(min(n1, below + 1), 0, -1):
            gain = below - (k - 1)
            if gain > n2:
                continue
            for u in range(n1 * n2, gain - 1, -1):
                ways[k][u] += ways[k - 1][u - gain]
    return tuple(ways[n1])


def mann_whitney_test(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """mann_whitney() with p, one-sided for a larger first group; null where U is. One row, whose p is worked out beside it."""
    kept = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    tied = kept.groupBy(value).agg(F.count("*").alias("t")).filter("t > 1").agg(F.collect_list("t").alias("ties"))

    @F.pandas_udf("double")
    def p(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(c) else mann_whitney_p(int(a), int(b), float(c), list(d)) for a, b, c, d in zip(n1, n2, u, ties, strict=True)])

    return mann_whitney(df, group, value, first, second).crossJoin(tied).withColumn("p", p("n1", "n2", "u", "ties")).drop("ties")
