"""Counts, distinct counts, quantiles and overlaps from sketches that merge.

A table of partial sketches has a row for each split (a day, a file, a batch) and holds a few kilobytes a row, whatever
the split holds. Totals over any choice of splits come from merging rows, so nothing is read twice; a new split is
appended. Distinct counts are HyperLogLog with 2^12 registers (standard error 1.04 / 64, 1.6 %), overlaps are theta
sketches of 2^12 entries (1 / 64), quantiles are KLL (rank error about 1.7 %).

Nulls are not counted; a split without values has empty sketches; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = 12
#: Standard errors of distinct counts, and the error of a rank.
HLL_ERROR = 1.04 / 2 ** (ENTRIES / 2)
THETA_ERROR = 1 / 2 ** (ENTRIES / 2)
RANK_ERROR = 0.0265


def partial_sketches(df: DataFrame, keys: list[str | Column], item: str | Column, value: str | Column | None = None) -> DataFrame:
    """keys, n, hll, theta, and kll with a value: one row for each split."""
    item = F.col(item) if isinstance(item, str) else item
    found = [F.count(item).alias("n"), F.hll_sketch_agg(item, F.lit(ENTRIES)).alias("hll"), F.theta_sketch_agg(item, ENTRIES).alias("theta")]
    if value is not None:
        found.append(F.kll_sketch_agg_double((F.col(value) if isinstance(value, str) else value).cast("double")).alias("kll"))
    return df.groupBy(*keys).agg(*found)


def merged_sketches(partials: DataFrame, keys: list[str]) -> DataFrame:
    """The same columns for coarser keys."""
    found = [F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", ENTRIES).alias("theta")]
    if "kll" in partials.columns:
        found.append(F.kll_merge_agg_double("kll").alias("kll"))
    return partials.groupBy(*keys).agg(*found)


def estimates(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """keys, n, distinct, distinct_theta, and a column for each named quantile."""
    keys = [c for c in sketches.columns if c not in ("n", "hll", "theta", "kll")]
    at = [F.kll_sketch_get_quantile_double("kll", F.lit(q)).alias(name) for name, q in (quantiles or {}).items()]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("hll").alias("distinct"), F.theta_sketch_estimate("theta").alias("distinct_theta"), *at)


def overlaps(sketches: DataFrame, key: str) -> DataFrame:
    """a, b, shared, jaccard for each two splits a < b: how many distinct items both have.

    Pairs are of splits, whose number is small; a sketch is a few kilobytes.
    """
    a = sketches.select(F.col(key).alias("a"), F.col("theta").alias("ta"))
    b = sketches.select(F.col(key).alias("b"), F.col("theta").alias("tb"))
    both, any_ = F.theta_sketch_estimate(F.theta_intersection("ta", "tb")), F.theta_sketch_estimate(F.theta_union("ta", "tb", ENTRIES))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", both.alias("shared"), F.when(any_ > 0, both / any_).alias("jaccard"))


def within(estimate: Column, exact: Column, error: float, sigmas: float = 4.0) -> Column:
    """Whether an estimate lies as near the exact count as its standard error allows."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), sigmas * error * exact)
