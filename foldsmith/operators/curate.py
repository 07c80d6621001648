"""Cleaning, key standardization, replicate consolidation, thresholds and labels, per dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import predicates as P
from ..session import materialize
from .joins import join_group_stats
from .rank import group_quantiles

UNITS = [L.NANOMOLAR, L.MICROMOLAR]


def clean(rows: DataFrame, unit: str = "standard_units", value: str = "standard_value",
          relation: str = "standard_relation") -> DataFrame:
    """Rows with a permitted unit, a positive value and a relation; the value becomes a double."""
    kept = rows.filter(P.allowed(F.col(unit), UNITS) & P.non_blank(F.col(relation)))
    return (kept.withColumn(value, F.col(value).try_cast("double"))
            .filter(P.positive(F.col(value))))


def standardize(rows: DataFrame, item_key: Callable[[], Column], weight: Column, unit: str = "standard_units",
                value: str = "standard_value", max_weight: float = 900.0) -> DataFrame:
    """Adds ``item_key`` and ``p_value``; drops rows whose key is NULL or whose weight is above the limit.

    ``item_key`` builds the standardized key from the row's columns and yields NULL where that fails, so a bad
    row costs itself and not its dataset.
    """
    keyed = rows.withColumns({"item_key": item_key(), "weight": weight})
    kept = keyed.filter(F.col("item_key").isNotNull() & (F.col("weight") <= max_weight))
    nanomolar = L.to_nanomolar(F.col(value), F.col(unit))
    return kept.withColumns({value: nanomolar, unit: F.lit(L.NANOMOLAR)}).withColumn("p_value", L.p_value(F.col(value)))


def consolidate(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                max_std: float = 1.0) -> DataFrame:
    """One row per key: a single row as it is, agreeing replicates as their first row with the mean value.

    Replicates whose sample deviation exceeds ``max_std`` contradict each other and are all dropped, as are
    rows with a missing key.  One partial-aggregate shuffle, whatever the replicate counts.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys and c != value]
    present = rows.dropna(subset=keys)
    grouped = present.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"),
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    kept = grouped.filter(F.col("_std").isNull() | (F.col("_std") <= max_std))
    return kept.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest],
                       F.col("_mean").alias(value)).select(rows.columns)


def threshold_stats(rows: DataFrame, dataset: Sequence[str], value: str) -> DataFrame:
    """Row count, exact median and sample deviation of each dataset."""
    dataset = list(dataset)
    spread = rows.groupBy(*dataset).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("std"))
    return spread.join(group_quantiles(rows, dataset, value, {"median": 0.5}), dataset)


def apply_threshold(rows: DataFrame, dataset: Sequence[str], aim: str, row_id: str, value: str = "p_value",
                    relation: str = "standard_relation", automatic: bool = True, hard_only: bool = False) -> DataFrame:
    """Adds ``<aim>_activity_comment``, ``<aim>_activity`` and ``<aim>_threshold``; unlabelled rows are dropped.

    ``rows`` is read several times for the statistics, so give it a stored table.
    """
    if automatic:
        stats = materialize(threshold_stats(rows, dataset, value).select(
            *dataset, "n", L.auto_threshold(F.col("median"), aim).alias("_t"), (F.col("std") / 10).alias("_b")),
            "threshold-stats")
        placed = join_group_stats(rows, stats, dataset, [row_id]).drop("n")
    else:
        placed = rows.withColumns({"_t": F.lit(L.FALLBACK_THRESHOLD[aim]), "_b": F.lit(L.FIXED_BUFFER)})
    label = L.activity_label(F.col(value), F.col(relation), F.col("_t"), F.col("_b"))
    labelled = placed.withColumn(f"{aim}_activity_comment", label)
    activity = L.binary_label(F.col(f"{aim}_activity_comment"), hard_only)
    return (labelled.withColumns({f"{aim}_activity": activity, f"{aim}_threshold": F.round("_t", 2)})
            .filter(F.col(f"{aim}_activity").isNotNull()).drop("_t", "_b"))


def flag_siblings(rows: DataFrame, dataset: Sequence[str], signature: str, row_id: str,
                  out: str = "has_sibling") -> DataFrame:
    """TRUE where another row of the dataset carries the same fingerprint signature; linear, no pairs."""
    keys = [*dataset, signature]
    counts = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")), "signature-counts")
    counted = join_group_stats(rows, counts, keys, [row_id])
    return counted.withColumn(out, F.col("n") > 1).drop("n")


def curate(rows: DataFrame, dataset: Sequence[str], row_id: str, signature: Callable[[], Column],
           merge_replicates: bool = True, automatic: bool = True, hard_only: bool = False,
           relation: str = "standard_relation") -> DataFrame:
    """Consolidation, both label aims and sibling flags over cleaned, standardized rows.

    The ``lo`` threshold is taken from the rows that survived the ``vs`` labelling.  Every stage is written to the
    shared folder, as the next one reads it more than once.
    """
    dataset = list(dataset)
    merged = consolidate(rows, [*dataset, "item_key"], "p_value", [row_id]) if merge_replicates else rows
    base = materialize(merged, "consolidated")
    for aim in ("vs", "lo"):
        base = materialize(apply_threshold(base, dataset, aim, row_id, relation=relation, automatic=automatic,
                                           hard_only=hard_only), f"labelled-{aim}")
    signed = base.withColumn("_signature", signature())
    return flag_siblings(signed, dataset, "_signature", row_id).drop("_signature")


def regroup(curated: DataFrame, keys: Sequence[str], row_id: str, signature: Callable[[], Column],
            **options) -> DataFrame:
    """Pool curated datasets that share ``keys`` and curate the pool anew."""
    stale = [f"{a}_{c}" for a in ("vs", "lo") for c in ("activity_comment", "activity", "threshold")] + ["has_sibling"]
    return curate(curated.drop(*stale), keys, row_id, signature, **options)


def dataset_summary(curated: DataFrame, dataset: Sequence[str], raw_sizes: DataFrame | None = None) -> DataFrame:
    """Sizes, size levels, class counts and maxima of each dataset, with and without siblings, in one pass."""
    alone = ~F.col("has_sibling")
    aggs = [F.count("*").alias("size_all"), F.count_if("has_sibling").alias("n_siblings"),
            F.max("weight").alias("max_weight")]
    for aim in ("vs", "lo"):
        on = F.col(f"{aim}_activity") == 1.0
        aggs += [F.max(f"{aim}_threshold").alias(f"{aim}_threshold"),
                 F.count_if(on).alias(f"{aim}_active_all"), F.count_if(on & alone).alias(f"{aim}_active_alone")]
    out = curated.groupBy(*dataset).agg(*aggs)
    out = out.withColumn("size_alone", F.col("size_all") - F.col("n_siblings"))
    extra = {}
    for mode in ("all", "alone"):
        size = F.col(f"size_{mode}")
        extra[f"level_{mode}"] = L.size_level(size)
        for aim in ("vs", "lo"):
            on = F.col(f"{aim}_active_{mode}")
            extra[f"{aim}_inactive_{mode}"] = size - on
            extra[f"{aim}_percent_{mode}"] = L.percent(on, size)
    out = out.withColumns(extra)
    if raw_sizes is None:
        return out
    return (out.join(raw_sizes, list(dataset), "left")
            .withColumn("removed_size", F.col("raw_size") - F.col("size_all")))
