"""Array-of-double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column, eps: float = 1e-13) -> Column:
    """L2-normalized copy; ``eps`` keeps a zero vector finite."""
    return F.zip_with(v, F.array_repeat(norm(v) + eps, F.size(v)), lambda x, length: x.cast("double") / length)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def log_loss_with_logits(z: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that cannot overflow."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * y
