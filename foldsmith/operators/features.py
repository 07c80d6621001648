"""Sparse text features in long form (id, bit, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize
from .joins import join_group_stats


def term_frequencies(rows: DataFrame, text: str, stop_words: Sequence[str], top: int) -> DataFrame:
    """The ``top`` most frequent words that are no stop words."""
    terms = rows.select(F.explode(X.words(F.col(text))).alias("term")).filter(~F.col("term").isin(list(stop_words)))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def count_fingerprint(rows: DataFrame, row_id: str, text: str, n_bits: int, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """How often each folded bit occurs; features that collide are summed."""
    cells = rows.select(row_id, F.explode(X.features(F.col(text), sizes)).alias("_f"))
    return (cells.select(row_id, X.bit_of(F.col("_f"), n_bits).alias("bit")).groupBy(row_id, "bit")
            .agg(F.count("*").alias("n")))


def combine_fingerprints(rows: DataFrame, row_id: str, text: str, kinds: Sequence[tuple[int, ...]], n_bits: int,
                         modes: dict[str, bool]) -> DataFrame:
    """(row_id, bit, value, mode): log(1 + count) of several fingerprints in ``n_bits``, for every named mode.

    A mode folds the fingerprints onto each other (False) or gives each a slice of its own (True).  Slices are equal shares
    of what is left, so the last one takes up any remainder.  A feature is made and hashed once for all modes.
    """
    layouts = {}
    for mode, concatenate in modes.items():
        widths, starts, used = [], [], 0
        for i in range(len(kinds)):
            widths.append((n_bits - used) // (len(kinds) - i) if concatenate else n_bits)
            starts.append(used if concatenate else 0)
            used += widths[-1]
        layouts[mode] = list(zip(widths, starts))
    tagged = F.array(*[F.struct(F.lit(i).alias("kind"), X.features(F.col(text), sizes).alias("f")) for i, sizes in enumerate(kinds)])
    parts = rows.select(row_id, F.explode(tagged).alias("_p"))
    hashed = parts.select(row_id, "_p.kind", F.explode("_p.f").alias("_f")).select(row_id, "kind", X.hash_of(F.col("_f")).alias("_h"))

    def place(layout: list[tuple[int, int]]) -> Column:
        spots = [(F.col("_h") % width + start).cast("int") for width, start in layout]
        return F.element_at(F.array(*spots), F.col("kind") + 1)

    cells = F.array(*[F.struct(F.lit(mode).alias("mode"), place(layout).alias("bit")) for mode, layout in layouts.items()])
    return (hashed.select(row_id, F.inline(cells)).groupBy(row_id, "mode", "bit")
            .agg(F.log1p(F.count("*").cast("double")).alias("value")).select(row_id, "bit", "value", "mode"))


def max_pool_bits(rows: DataFrame, keys: Sequence[str], bits: str) -> DataFrame:
    """On-bits of the element-wise maximum over a group's fingerprints, in long form."""
    return rows.select(*keys, F.explode(bits).alias("bit")).distinct()


def group_softmax(rows: DataFrame, group: Sequence[str], logit: str, row_id: str) -> DataFrame:
    """Softmax within each group, shifted by the group's maximum."""
    tops = materialize(rows.groupBy(*group).agg(F.count("*").alias("n"), F.max(logit).alias("_max")), "softmax-max")
    shifted = join_group_stats(rows, tops, group, [row_id]).withColumn("_e", F.exp(F.col(logit) - F.col("_max"))).drop("n")
    sums = materialize(shifted.groupBy(*group).agg(F.count("*").alias("n"), F.sum("_e").alias("_sum")), "softmax-sum")
    return (join_group_stats(shifted, sums, group, [row_id])
            .withColumn("p", F.col("_e") / F.col("_sum")).drop("n", "_e", "_max", "_sum"))
