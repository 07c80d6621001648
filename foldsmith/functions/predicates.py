"""Row predicates.  Each is TRUE or FALSE, never NULL, so ``~`` is safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _settled(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def matches(text: Column, include: str, exclude: str | None = None) -> Column:
    """Text found by ``include`` and not by ``exclude``; missing text matches nothing."""
    hit = text.rlike(include)
    return _settled(hit & ~text.rlike(exclude)) if exclude else _settled(hit)


def mentions_any(text: Column, keywords: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [_settled(F.contains(low, F.lit(k.lower()))) for k in keywords], F.lit(False))


def positive(value: Column) -> Column:
    return _settled((value > 0) & ~F.isnan(value))


def non_blank(text: Column) -> Column:
    return _settled(F.trim(text) != "")


def allowed(value: Column, accepted: list) -> Column:
    return _settled(value.isin(accepted))


def any_below(columns: list[Column], bound: float) -> Column:
    """At least one of the columns lies under ``bound``."""
    return _settled(F.exists(F.array(*columns), lambda x: x < bound))


def equals_all(**wanted) -> Column:
    """Conjunction over columns: a scalar must be equal, a list must contain, ``None`` is skipped."""
    tests = []
    for name, value in wanted.items():
        if value is None:
            continue
        column = F.col(name)
        tests.append(column.isin(list(value)) if isinstance(value, (list, tuple, set)) else column == F.lit(value))
    return _settled(reduce(lambda a, b: a & b, tests, F.lit(True)))


def in_box(i: Column, j: Column, i_low=None, i_high=None, j_low=None, j_high=None) -> Column:
    """Inclusive two-dimensional index box; an open side is left out."""
    tests = [t for bound, t in ((i_low, i >= F.lit(i_low)), (i_high, i <= F.lit(i_high)),
                                (j_low, j >= F.lit(j_low)), (j_high, j <= F.lit(j_high))) if bound is not None]
    return _settled(reduce(lambda a, b: a & b, tests, F.lit(True)))
