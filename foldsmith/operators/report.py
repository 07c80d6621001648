"""Counts, pivots and distributions for reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_group_stats
from .rank import group_quantiles


def value_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def frequent(rows: DataFrame, key: str, at_least: int | None = None, top: int | None = None) -> DataFrame:
    """Values seen ``at_least`` times, or the ``top`` most frequent (ties by value)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    if at_least is not None:
        counts = counts.filter(F.col("n") >= at_least)
    return counts.orderBy(F.desc("n"), key).limit(top) if top is not None else counts


def missing_share(rows: DataFrame) -> DataFrame:
    """Share of missing cells per column, one scan for all columns."""
    shares = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in rows.columns])
    return shares.unpivot([], list(rows.columns), "column", "missing").orderBy(F.desc("missing"), "column")


def describe(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per group."""
    if not group:
        return describe(rows.withColumn("_all", F.lit(0)), ["_all"], value).drop("_all")
    moments = rows.groupBy(*group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = group_quantiles(rows, group, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, list(group))


def box_summary(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR of the box) and the number of points beyond them."""
    box = group_quantiles(rows, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    sized = materialize(box.join(counted.groupBy(*group).agg(F.count("*").alias("n")), list(group)), "boxes")
    placed = join_group_stats(counted, sized, group, [value]).drop("n")
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return placed.groupBy(*group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("low_whisker"), F.max(F.when(inside, F.col(value))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"))


def histogram(rows: DataFrame, group: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; bin 0 and ``bins + 1`` hold what lies outside."""
    return (rows.groupBy(*group, F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin"))
            .agg(F.count("*").alias("n")))


def grid_counts(rows: DataFrame, x: Column, y: Column, step: float) -> DataFrame:
    return (rows.groupBy(F.floor(x / step).alias("x_bin"), F.floor(y / step).alias("y_bin"))
            .agg(F.count("*").alias("n")))


def crosstab(rows: DataFrame, index: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``column`` values per ``index``; the values are named, so no extra job looks for them."""
    return rows.groupBy(index).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def pivot_mean(rows: DataFrame, index: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    return rows.groupBy(*index).pivot(column, list(values)).agg(F.round(F.avg(value), 6))


def shares(rows: DataFrame, major: str, minor: str, value: str) -> DataFrame:
    """Sums per (major, minor), per major and overall, with each row's share of the whole."""
    sums = rows.rollup(major, minor).agg(F.grouping_id().alias("depth"), F.sum(value).alias("total"))
    return sums.withColumn("share", F.try_divide(F.col("total"), rows.agg(F.sum(value)).scalar()))


def mean_by_category(rows: DataFrame, column: str, categories: DataFrame, values: Sequence[str]) -> DataFrame:
    """Means per listed category; a category whose values are all missing gets 0, one without rows stays NULL."""
    means = rows.groupBy(column).agg(*[
        F.coalesce(F.avg(F.nanvl(F.col(v), F.lit(None).cast("double"))), F.lit(0.0)).alias(v) for v in values])
    return categories.join(means, column, "left")


def nan_mean(rows: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over folds that skip NaN as well as NULL."""
    return rows.groupBy(*group).agg(*[F.avg(F.nanvl(F.col(v), F.lit(None).cast("double"))).alias(v) for v in values])


def most_frequent(rows: DataFrame, group: Sequence[str], config: str, fold: str) -> DataFrame:
    """Most frequent configuration per group, the one met in the earliest fold where counts tie."""
    counts = rows.groupBy(*group, config).agg(F.count("*").alias("n"), F.min(fold).alias("_first"))
    return counts.groupBy(*group).agg(F.max_by(config, F.struct(F.col("n"), -F.col("_first"))).alias(config))


def multi_valued(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values of the keys measured more than once, as counted rows; the list of a key is never built."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    sizes = materialize(counted.groupBy(*keys).agg(F.sum("n").alias("_all"), F.count("*").alias("_rows")), "value-counts")
    return join_group_stats(counted, sizes, keys, [value], size="_rows", how="left_semi", keep=F.col("_all") > 1)


def class_balance(rows: DataFrame, label: str, role: str) -> DataFrame:
    """Class counts and active share overall and per role, in one pass."""
    aggs = []
    for name, test in (("all", F.lit(True)), ("train", F.col(role) == "train"), ("test", F.col(role) == "test")):
        on = F.count_if(test & (F.col(label) == 1))
        off = F.count_if(test & (F.col(label) == 0))
        aggs += [on.alias(f"active_{name}"), off.alias(f"inactive_{name}"),
                 F.try_divide(on, on + off).alias(f"ratio_{name}")]
    return rows.agg(*aggs)


def lost_values(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Distinct values of the first version that the second no longer has."""
    return before.select(column).distinct().join(after.select(column).distinct(), column, "left_anti")


def compare_runs(results: DataFrame, keys: Sequence[str], metric: str, band: float = 0.2) -> DataFrame:
    """Child against parent per key: mean difference and how often one wins by more than ``band``."""
    gap = F.col(f"child_{metric}") - F.col(f"parent_{metric}")
    return results.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.avg(F.col("parent_size") - F.col("child_size")).alias("mean_size_diff"),
        F.count_if(gap > band).alias("child_wins"), F.count_if(gap < -band).alias("parent_wins"))


def mean_vectors(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean vector per key, averaged position by position and reassembled."""
    cells = rows.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = cells.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    # one entry per dimension, so the list is as long as a vector and no longer
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return packed.select(*keys, F.transform("_v", lambda e: e["_m"]).alias(vector))


def median_vectors(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Component-wise exact median per key, in long form (keys, dim, median)."""
    cells = rows.select(*keys, F.posexplode(vector).alias("dim", "_x"))
    return group_quantiles(cells, [*keys, "dim"], "_x", {"median": 0.5})


def stage_sizes(stages: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows per key after each stage, side by side; a key a stage has lost shows NULL there."""
    sizes = [df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}")) for name, df in stages.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "outer"), sizes)
