"""From relational source tables to one wide activity table, and to datasets of one experimental condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..session import materialize
from .rank import rank_by_value


def fetch_activities(activities: DataFrame, assays: DataFrame, assay_key: str, targets: DataFrame, target_key: str,
                     docs: DataFrame, doc_key: str, std_type: str, types: Sequence[str], confidence: str,
                     min_confidence: int, doc_date: str | None, text: str, drop_keywords: Sequence[str],
                     variant: str | None = None) -> DataFrame:
    """Activities of the wanted types with their assay, target and document attributes.

    Dimensions are filtered before they are joined; all types are fetched in one job.  An assay is left out when
    its confidence is low, its text names a dropped keyword or it is marked as a variant, and, where ``doc_date``
    is given, when its document has no date.
    """
    good = assays.filter((F.col(confidence) >= min_confidence) & ~P.mentions_any(F.col(text), list(drop_keywords)))
    if variant:
        good = good.filter(F.col(variant).isNull())
    dated = docs.filter(F.col(doc_date).isNotNull()) if doc_date else docs
    wanted = activities.filter(P.allowed(F.col(std_type), list(types)))
    return wanted.join(targets, target_key).join(good, assay_key).join(dated, doc_key)


def target_counts(rows: DataFrame, target: str, assay: str, item: str) -> DataFrame:
    """Assays per target and the sum of their distinct items: a rollup of a rollup."""
    per_assay = rows.groupBy(target, assay).agg(F.countDistinct(item).alias("cnt"))
    return per_assay.groupBy(target).agg(F.countDistinct(assay).alias("n_assays"), F.sum("cnt").alias("n_items"))


def hash_conditions(rows: DataFrame, fields: Sequence[str], out: str = "condition") -> DataFrame:
    return rows.withColumn(out, X.field_hash(list(fields)))


def datasets_by_condition(rows: DataFrame, target: str, fields: Sequence[str], assay: str, order: str,
                          min_size: int = 100) -> DataFrame:
    """Catalog of the (target, condition) groups of at least ``min_size`` rows, numbered within their target.

    Numbering runs over groups, not rows, by the group's first row.
    """
    hashed = hash_conditions(rows, fields)
    groups = hashed.groupBy(target, "condition").agg(
        F.count("*").alias("n_rows"), F.countDistinct(assay).alias("n_assays"), F.min(order).alias("first_id"))
    kept = materialize(groups.filter(F.col("n_rows") >= min_size), "condition-groups")
    ranked = rank_by_value(kept, [target], "first_id", [F.col("condition")], out="ordinal")
    return ranked.withColumn("ordinal", F.col("ordinal") + 1)
