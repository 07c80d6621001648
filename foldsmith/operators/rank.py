"""Ranks, running sums and quantiles that never sort a whole group in one task.

A group may hold a third of the table, so a plain ``Window.partitionBy(group)``
is ruled out.  Every routine here cuts a group's order into buckets, sums the
buckets in a small table, and sorts only inside ``(group, bucket)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4_000_000


def seeded_order(seed: int | str, *ids: Column | str) -> Column:
    """Shuffle key: md5 of ``seed:id``.  The same string orders the same way in any engine."""
    parts = [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _prefix_sum(counts: DataFrame, part: Sequence[str], order: Sequence[Column], values: Sequence[str],
                outs: Sequence[str]) -> DataFrame:
    keys = [F.col(p) for p in part] or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({o: F.coalesce(F.sum(v).over(before), F.lit(0)) for v, o in zip(values, outs)})


def distributed_rank(df: DataFrame, part: Sequence[str], key: Column, tie: Sequence[Column] = (), out: str = "rank",
                     digits: int | None = None) -> DataFrame:
    """0-based rank of each row within ``part`` by a hex string ``key`` (then ``tie``), e.g. :func:`seeded_order`.

    Rows are bucketed by the first ``digits`` characters of ``key``; by default as many as keep a bucket of the
    largest group near ``ROWS_PER_BUCKET`` rows, so ordinary groups need no cutting at all.
    Give it a stored table: the narrow key columns are read once more for the bucket counts.
    """
    part = list(part)
    keyed = df.withColumn("_key", key)
    if digits is None:
        largest = df.groupBy(*part).count().agg(F.coalesce(F.max("count"), F.lit(0))) if part else df.agg(F.count("*"))
        need = F.ceil(F.log2(F.greatest(largest.scalar() / F.lit(float(ROWS_PER_BUCKET)), F.lit(1.0))) / 4)
        width = need.cast("int")
    else:
        width = F.lit(digits)
    keyed = keyed.withColumn("_bucket", F.substr("_key", F.lit(1), width))
    return _rank_in_buckets(keyed, part, [F.col("_key"), *tie], out).drop("_key")


def rank_by_value(df: DataFrame, part: Sequence[str], value: str, tie: Sequence[Column] = (), out: str = "rank",
                  buckets: int = 1024, repeats: str | None = None) -> DataFrame:
    """0-based rank within ``part`` by a numeric column, then ``tie``, bucketed by the column's quantiles.

    Where many rows may share a value, ``repeats`` names the numeric column that orders them (the only ``tie``): rows of
    a crowded value are cut by its quantiles too.  Give it a stored table, which is read several times.
    """
    cut = with_value_bucket(df, value, buckets)
    if repeats is not None:
        cut = with_value_bucket(cut, repeats, buckets, out="_second")
        # a crowded value is the upper edge of its bucket, so its rows come after the bucket's others
        within = F.when(F.col("_crowded"), F.lit(1 << 31) + F.col("_second")).otherwise(F.lit(0))
        cut = cut.withColumn("_bucket", F.col("_bucket") * F.lit(1 << 32) + within).drop("_second", "_second_crowded")
    return _rank_in_buckets(cut.drop("_crowded"), list(part), [F.col(value), *tie], out)


def _rank_in_buckets(cut: DataFrame, part: list[str], order: Sequence[Column], out: str) -> DataFrame:
    counts = cut.groupBy(*part, "_bucket").agg(F.count("*").alias("_n"))
    offsets = _prefix_sum(counts, part, [F.col("_bucket")], ["_n"], ["_off"]).drop("_n")
    within = Window.partitionBy(*part, "_bucket").orderBy(*order)
    # without this, rows that arrive partitioned by ``part`` alone would be sorted where they are, a group to a task
    cut = cut.repartition(*part, "_bucket")
    ranked = cut.withColumn("_rn", F.row_number().over(within))
    return (ranked.join(offsets, [*part, "_bucket"])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_bucket", "_rn", "_off"))


def with_value_bucket(df: DataFrame, value: str, buckets: int = 256, out: str = "_bucket") -> DataFrame:
    """Adds the index of the approximate quantile cut ``value`` falls in, and ``_crowded``: the value fills cuts alone.

    The index is monotone in the value.  The cuts are one sketch row computed inside the plan; each lookup is a binary
    search over them.  Where ``buckets`` of them would hold more than ``ROWS_PER_BUCKET`` rows each, every cut range is
    divided evenly into as many more as that takes, so the number of buckets follows the data.
    """
    probs = ", ".join(f"{i / buckets}D" for i in range(buckets + 1))
    sketch = df.agg(F.struct(F.expr(f"percentile_approx(`{value}`, array({probs}), {10 * buckets})").alias("edges"),
                             F.ceil(F.count(value) / F.lit(float(buckets * ROWS_PER_BUCKET))).alias("parts")).alias("s")).scalar()
    steps, step = [], buckets // 2
    while step:
        steps.append(str(step))
        step //= 2
    edge = lambda i: F.get("_sketch.edges", i)
    found = F.aggregate(F.expr(f"array({', '.join(steps)})"), F.lit(0),
                        lambda at, s: F.when(F.col(value) > edge(at + s), at + s).otherwise(at))
    low, high = edge(F.col("_at")).cast("double"), edge(F.col("_at") + 1).cast("double")
    parts = F.greatest(F.col("_sketch.parts"), F.lit(1))
    share = (F.col(value).cast("double") - low) / F.nullif(high - low, F.lit(0.0))
    # values that sort last, and ranges without a width, stay in the last part
    part = F.floor(F.least(F.greatest(F.coalesce(share * parts, parts - F.lit(1.0)), F.lit(0.0)), parts - F.lit(1.0)))
    crowded = (F.col(value) == edge(F.col("_at") + 1)) & (edge(F.col("_at") + 1) == edge(F.col("_at") + 2))
    flag = "_crowded" if out == "_bucket" else f"{out}_crowded"
    return (df.withColumn("_sketch", sketch).withColumn("_at", found)
            .withColumns({out: F.col("_at") * parts + part, flag: F.coalesce(crowded, F.lit(False))}).drop("_sketch", "_at"))


def group_cumsum(df: DataFrame, part: Sequence[str], value: str, sums: Sequence[str], descending: bool = False,
                 buckets: int = 256) -> DataFrame:
    """For rows unique on ``(part, value)``: ``before_<col>``, the sum over earlier values, and ``total_<col>``."""
    part, sums = list(part), list(sums)
    cut = with_value_bucket(df, value, buckets).drop("_crowded")
    per = cut.groupBy(*part, "_bucket").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    offsets = _prefix_sum(per, part, [way("_bucket")], [f"_s_{s}" for s in sums], [f"_o_{s}" for s in sums])
    whole = Window.partitionBy(*([F.col(p) for p in part] or [F.lit(0)]))
    offsets = offsets.select(*part, "_bucket", *[f"_o_{s}" for s in sums],
                             *[F.sum(f"_s_{s}").over(whole).alias(f"total_{s}") for s in sums])
    within = (Window.partitionBy(*part, "_bucket").orderBy(way(value))
              .rowsBetween(Window.unboundedPreceding, -1))
    running = cut.withColumns({f"_r_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    out = running.join(offsets, [*part, "_bucket"])
    return (out.withColumns({f"before_{s}": F.col(f"_r_{s}") + F.col(f"_o_{s}") for s in sums})
            .drop("_bucket", *[f"_r_{s}" for s in sums], *[f"_o_{s}" for s in sums]))


def group_quantiles(df: DataFrame, part: Sequence[str], value: str, probs: dict[str, float],
                    buckets: int = 256) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``.

    Equal values are counted before the shuffle; only the buckets that hold a wanted position are sorted.
    NULL values are ignored.
    """
    part = list(part)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("_n"))
    cut = with_value_bucket(counted, value, buckets).drop("_crowded")
    per = cut.groupBy(*part, "_bucket").agg(F.sum("_n").alias("_bn"))
    placed = _prefix_sum(per, part, [F.col("_bucket")], ["_bn"], ["_off"])
    totals = per.groupBy(*part).agg(F.sum("_bn").alias("_total"))
    placed = placed.join(totals, part) if part else placed.withColumn("_total", totals.scalar())

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    def holds(start: str, count: str) -> Column:
        hit = F.lit(False)
        for p in probs.values():
            for at in (F.floor(position(p)), F.ceil(position(p))):
                hit = hit | ((at >= F.col(start)) & (at < F.col(start) + F.col(count)))
        return hit

    wanted = placed.filter(holds("_off", "_bn")).select(*part, "_bucket", "_off", "_total")
    inside = Window.partitionBy(*part, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = (cut.join(wanted, [*part, "_bucket"])
            .withColumn("_start", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0))))
    aggs = []
    for name, p in probs.items():
        for tag, at in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            here = (at >= F.col("_start")) & (at < F.col("_start") + F.col("_n"))
            aggs.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
    picked = rows.groupBy(*part).agg(F.max("_total").alias("_total"), *aggs)
    return picked.select(*part, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (position(p) - F.floor(position(p)))).alias(n)
        for n, p in probs.items()])
