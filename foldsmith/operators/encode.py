"""Dense ids and the triplet encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_dimension, join_group_stats, keep_first
from .rank import rank_by_value


def encode_ids(rows: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Dictionary (column, out, n): 0, 1, 2 ... by first appearance in ``order`` (a unique number), and row counts."""
    firsts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"), F.count("*").alias("n"))
    return rank_by_value(materialize(firsts, "first-rows"), [], "_first", out=out).select(column, out, "n")


def to_triplets(rows: DataFrame, item: str, group: str, label: str, value: str, split: str, order: str,
                group_info: Sequence[str] = ()) -> dict[str, DataFrame]:
    """``activity`` (item and group indices, label, value, split), ``items``, ``groups`` with their attributes.

    Groups keep the attributes of their first row.
    """
    items = materialize(encode_ids(rows, item, order, "compound_idx"), "items")
    groups = materialize(encode_ids(rows, group, order, "assay_idx"), "groups")
    placed = join_group_stats(rows, items, [item], [order]).drop("n")
    activity = (join_group_stats(placed, groups, [group], [order])
                .select("compound_idx", "assay_idx", F.col(label).cast("int").alias("activity"),
                        F.col(value).cast("double").alias("activity_numeric"), F.col(split).alias("split")))
    first = keep_first(rows.select(group, order, *group_info), [group], [order])
    info = first.join(groups, group).select("assay_idx", group, *group_info)
    return {"activity": activity, "items": items.drop("n"), "groups": info}


def gather_features(triplets: DataFrame, items: DataFrame, groups: DataFrame, item: str, group: str) -> DataFrame:
    """Triplets with the features of both sides; an item or group with very many triplets is spread."""
    return join_dimension(join_dimension(triplets, items, [item], [group]), groups, [group], [item])


def number_groups(groups: DataFrame, owner: str, first: str, out: str) -> DataFrame:
    """Ordinal of each group within its owner by the group's first id, from 1.  An owner may have any number of groups."""
    groups = materialize(groups, "numbered-groups")
    firsts = materialize(groups.groupBy(owner, first).agg(F.count("*").alias("n")), "first-ids")
    ranked = rank_by_value(firsts, [owner], first, out=out).withColumn(out, F.col(out) + 1).drop("n")
    return join_dimension(groups, ranked, [owner, first], [first])
