"""Potency transform, activity labels and class cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit names, relation signs, threshold limits and fallbacks
NANOMOLAR, MICROMOLAR = "nM", "uM"
RELATIONS_ABOVE = [">", ">="]
RELATIONS_AT_OR_BELOW = ["<", "<=", "=", "~"]
AUTO_LIMITS = {"vs": (4.0, 6.0), "lo": (5.0, 7.0)}
FALLBACK_THRESHOLD = {"vs": 5.0, "lo": 6.3}
FIXED_BUFFER = 0.5
HARD_LABELS = ["active", "inactive"]
WEAK_LABELS = ["weak active", "weak inactive"]


def p_value(nanomolar: Column) -> Column:
    """Negative log10 of a molar value given in nM; NULL unless positive."""
    return F.when(nanomolar > 0, 9.0 - F.log10(nanomolar))


def to_nanomolar(value: Column, unit: Column) -> Column:
    return F.when(unit == MICROMOLAR, value * 1000.0).otherwise(value)


def auto_threshold(median: Column, aim: str) -> Column:
    """The median where it lies inside the aim's limits, the aim's fallback elsewhere."""
    low, high = AUTO_LIMITS[aim]
    return F.when(median.between(low, high), median).when(median.isNotNull(), F.lit(FALLBACK_THRESHOLD[aim]))


def activity_label(value: Column, relation: Column, threshold: Column, buffer: Column) -> Column:
    """Five-way label around ``threshold`` with a soft band of ``buffer``; NULL where nothing can be said."""
    margin = value - threshold
    graded = (F.when(margin.isNull() | F.isnan(margin) | buffer.isNull(), None)
              .when(value >= threshold + buffer, "active")
              .when(value > threshold, "weak active")
              .when(value <= threshold - buffer, "inactive")
              .otherwise("weak inactive"))
    return (F.when(relation.isin(RELATIONS_ABOVE), "inactive")
            .when(relation.isin(RELATIONS_AT_OR_BELOW), graded))


def binary_label(label: Column, hard_only: bool = False) -> Column:
    """1.0 for active, 0.0 for inactive; weak labels count unless ``hard_only``; NULL otherwise."""
    allowed = HARD_LABELS + ([] if hard_only else WEAK_LABELS)
    return F.when(label.isin(allowed), F.when(label.isin("active", "weak active"), 1.0).otherwise(0.0))


def three_class(value: Column, high: float = 7.0, low: float = 5.0) -> Column:
    return (F.when(value > high, "active").when(value >= low, "intermediate")
            .when(value.isNotNull(), "inactive"))


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole`` to two places, 0 for an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(F.round(F.try_divide(part * 100.0, whole), 2))


def size_level(rows: Column, small: int = 50) -> Column:
    return F.when(rows < small, f"s{small}").otherwise(f"b{small}")


def cut_probability(p: Column, at: float = 0.5) -> Column:
    return (p > at).cast("int")
