"""Joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_SHARE = 1000
HOT_ROWS = 100_000


def join_group_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str], salt: Sequence[str], size: str = "n",
                     how: str = "inner", keep: Column | None = None) -> DataFrame:
    """Attach per-group ``stats`` to ``rows`` by ``keys`` without gathering a hot group in one task.

    ``stats``, a stored table since it is read three times, has one row per group and its row count in ``size``.  A group above 1/1000 of all rows (and
    ``HOT_ROWS``) is hot; there can be at most 1000 such groups, which bounds the broadcast.  Their rows are spread
    by a hash of the ``salt`` columns (a row id) over as many shares as bring each back to that size, and only
    their stats rows are repeated.  ``keep`` limits the groups joined; a hot group it rejects is spread all the same.
    Rows with a missing key are spread too.
    """
    keys = list(keys)
    share = F.greatest(stats.agg(F.sum(size)).scalar() / F.lit(HOT_SHARE), F.lit(HOT_ROWS))
    flagged = stats.withColumn("_shares", F.ceil(F.col(size) / share).cast("int"))
    hot = flagged.filter("_shares > 1").select(*keys, "_shares")
    # a key that is missing matches nothing, so its rows may go anywhere
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False))
    shares = F.when(missing, F.lit(HOT_SHARE)).otherwise(F.coalesce("_shares", F.lit(1)))
    spread = F.pmod(F.xxhash64(*salt), shares).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_shares")
    kept = flagged if keep is None else flagged.filter(keep)
    right = kept.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest("_shares", F.lit(1)) - 1))).drop("_shares")
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys, "_salt")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_dimension(rows: DataFrame, dim: DataFrame, keys: Sequence[str], salt: Sequence[str], how: str = "inner") -> DataFrame:
    """:func:`join_group_stats` for a dimension (one row per key) that does not carry the sizes of its groups."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = materialize(sizes.join(dim, list(keys), how), "dimension")
    return join_group_stats(rows, sized, keys, salt, size="_n", how=how).drop("_n")


def gate_by_size(rows: DataFrame, keys: Sequence[str], salt: Sequence[str], low: int | None = None,
                 high: int | None = None) -> DataFrame:
    """Rows of the groups with ``low <= size <= high``; an open bound is not tested."""
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")), "group-sizes")
    tests = [t for bound, t in ((low, F.col("n") >= F.lit(low)), (high, F.col("n") <= F.lit(high)))
             if bound is not None]
    return join_group_stats(rows, sizes, keys, salt, how="left_semi", keep=reduce(lambda a, b: a & b, tests, F.lit(True)))


def anti_all_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` with no equal row in ``right``, a missing value being equal to a missing value.

    Repeated rows on the left stay repeated, unlike EXCEPT.
    """
    right = right.select(left.columns).distinct()
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in left.columns])
    return left.join(right, same, "left_anti")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (which must end in a unique column)."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(rows.columns)


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, Column | str | list[str]]]) -> DataFrame:
    """Inner joins of ``fact`` with each dimension in turn.

    No broadcast is forced: the optimizer broadcasts a dimension only if its measured size is under the
    session's threshold, and shuffles otherwise.
    """
    return reduce(lambda acc, d: acc.join(d[0], d[1]), dims, fact)
