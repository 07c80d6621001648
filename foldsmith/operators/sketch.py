"""Distinct counts and overlaps from stored sketches, without going back to the rows.

A sketch keeps the items of lowest hash, at most two to the power ``lg`` of them: exact up to that number, beyond it with a
standard error near one over its square root.  Sketches of parts merge into the sketch of the whole, so each part is read
once, and new parts are added without the old ones.  A sketch of many items may keep slightly different hashes when its
parts are merged in another order; its estimate then differs within the error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16,384 hashes: exact up to that many items, then about 0.8 % of standard error, in at most 128 KiB a sketch.
LG = 14


def _hashable(rows: DataFrame, item: str) -> Column:
    """Whole numbers, texts and bytes are sketched as they are, other items as their text."""
    kind = rows.schema[item].dataType.simpleString()
    return F.col(item) if kind in ("int", "bigint", "string", "binary") else F.col(item).cast("string")


def distinct_sketches(rows: DataFrame, keys: Sequence[str], item: str, lg: int = LG) -> DataFrame:
    """(keys, sketch, n_rows): a sketch of the distinct items per key, missing items left out.

    Partial sketches are made before the shuffle, so a hot key sends one a task, not its rows.
    """
    return rows.groupBy(*keys).agg(F.theta_sketch_agg(_hashable(rows, item), lg).alias("sketch"), F.count("*").alias("n_rows"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], lg: int = LG) -> DataFrame:
    """Sketches of finer keys, or of several batches united, rolled up to ``keys``."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sketch", lg).alias("sketch"), F.sum("n_rows").alias("n_rows"))


def estimates(sketches: DataFrame, out: str = "n_items") -> DataFrame:
    """The number of distinct items in place of each sketch."""
    return sketches.withColumn(out, F.theta_sketch_estimate("sketch")).drop("sketch")


def second_level_estimates(sketches: DataFrame, keys: Sequence[str], part: str, lg: int = LG) -> DataFrame:
    """(keys, n_parts, n_items, n_distinct): parts per key, their items summed part by part, and counted once over all parts.

    ``sketches`` has one row per (keys, ``part``).
    """
    return sketches.groupBy(*keys).agg(
        F.count(part).alias("n_parts"), F.sum(F.theta_sketch_estimate("sketch")).alias("n_items"),
        F.theta_sketch_estimate(F.theta_union_agg("sketch", lg)).alias("n_distinct"))


def overlap_estimates(parent: DataFrame, child: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Sizes, intersection and shares per pair, as the exact overlap of tests gives them; a missing side counts zero.

    Sketches are joined, a row a pair on both sides.  The error of an intersection follows the larger side: it is about the
    square root of the union's size times the intersection's, over the root of the hashes kept.
    """
    sides = parent.select(*pair, F.col("sketch").alias("_p")).join(child.select(*pair, F.col("sketch").alias("_c")), list(pair), "full")
    size = {s: F.coalesce(F.theta_sketch_estimate(f"_{s}"), F.lit(0)) for s in "pc"}
    shared = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("_p", "_c")), F.lit(0))
    out = sides.select(*pair, size["p"].alias("parent_count"), size["c"].alias("child_count"), shared.alias("intersection_count"))

    def ratio(of: str) -> Column:
        return F.coalesce(F.col("intersection_count") / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))

    return out.withColumns({"coverage": ratio("child_count"), "inclusion": ratio("parent_count"),
                            "unique_to_parent": F.greatest(F.col("parent_count") - F.col("intersection_count"), F.lit(0)),
                            "unique_to_child": F.greatest(F.col("child_count") - F.col("intersection_count"), F.lit(0))})
