"""Robust statistics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: from the median absolute deviation to a standard deviation.
MAD_TO_SIGMA = 1.4826


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def with_group(df: DataFrame, groups: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """df with the row of its group, groups having one a group; without by, its only row.

    Each of so many parts of a group meets a copy of that row, so a group with a large share of the rows is no single task.
    """
    if not by:
        return df.crossJoin(F.broadcast(groups))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    copies = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return df.withColumn("_part", part).join(copies, [*by, "_part"]).drop("_part")


def with_robust(df: DataFrame, by: list[str], value: str, least: int = 1) -> DataFrame:
    """df with med and sigma of value in its group: 1.4826 MAD, or the population's deviation where that is 0.

    Two aggregates joined back, so the rows keep their partitioning and nothing gathers a group's rows;
    groups with fewer than least rows or no spread fall out.
    """
    middle = df.groupBy(*by).agg(F.median(value).alias("med"), F.stddev_pop(value).alias("std"), F.count(value).alias("n_group")).where(F.col("n_group") >= least)
    near = with_group(df, middle, by)
    spread = near.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    out = with_group(near, spread, by)
    sigma = F.when(F.col("mad") > 0, F.col("mad") * MAD_TO_SIGMA).otherwise(F.col("std"))
    return out.withColumn("sigma", sigma).where(F.col("sigma") >= 1e-10).drop("std", "mad", "n_group")


def equal_bins(df: DataFrame, by: list[str], value: str, per_bin: int, least_bins: int, least_rows: int) -> DataFrame:
    """df with bin: half-open equal cuts of value's range in its group, the largest value in no bin (null)."""
    ends = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n_group")).where(F.col("n_group") >= least_rows)
    bins = F.greatest(F.lit(least_bins), F.floor(F.col("n_group") / per_bin))
    at = F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    out = with_group(df, ends, by)
    return out.withColumn("n_bins", bins.cast("int")).withColumn("bin", F.when((F.col("high") > F.col("low")) & (at < bins), at.cast("int")))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def saturating(x: Column, full: float) -> Column:
    """min(x, full) / full."""
    return F.least(x, F.lit(full)) / full
