"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies follow its weight, at a rate per source at which the words expected are the source's target
and no document exceeds the limit: documents that would are certain at the limit and the rate of the others rises.
Whole copies are certain.  For the rest, documents are ranked within their source by Pareto's key, the odds of
a seeded uniform number over the odds of inclusion, and taken in that order until the source's words reach the target.
Every step works on the narrow (id, source, size) table; the order of a source is cut into buckets of its key range
and only the one bucket in which the target falls is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import distributed_rank, group_cumsum
from ..session import materialize, spread

SPACE = "[\\x20\\x09-\\x0D]"
ROWS_PER_BUCKET = 20_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    marks = F.regexp_replace(text, f"{SPACE}*[^\\x20\\x09-\\x0D]+{SPACE}*", "x")
    return F.when(text.rlike("[^\\x20\\x09-\\x0D]"), F.length(marks)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size).

    Sources weigh ``weights`` in turn, by code point with null last, and share ``share`` times all words; none gets
    more than ``most`` times its own, and what is over goes to the others by weight until none is above.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
                      "mix-sources")
    # hex digits keep the order of the bytes, which is that of the code points; Z comes after all of them
    key = F.coalesce(F.hex(F.encode("source", "UTF-8")), F.lit("Z"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    per = materialize(distributed_rank(per, [], key, out="k").withColumn("weight", turn), "mix-weights")
    # the level up to which sources fill, once all that meet their limit below it are full
    steps = materialize(per.groupBy((F.col("source_size") / F.col("weight")).alias("full_at")).agg(
        F.sum(F.col("source_size") * most).alias("limit"), F.sum("weight").alias("weight")), "mix-levels")
    goal = per.agg(F.sum("source_size")).scalar() * F.lit(float(share))
    reached = (goal - F.col("before_limit")) / (F.col("total_weight") - F.col("before_weight"))
    level = (group_cumsum(steps, [], "full_at", ["limit", "weight"]).withColumn("level", reached)
             .filter(F.col("level") < F.col("full_at") * most).agg(F.max("level")))
    # no level: every source is full
    return per.select("source", "source_size", "n_docs",
                      F.least(level.scalar() * F.col("weight"), F.col("source_size") * float(most)).alias("target"))


def inclusion_rates(sizes: DataFrame, most: float) -> DataFrame:
    """(named, rate) of ``sizes`` (named, weight, size, target): expected copies are least(rate * weight, most).

    At that rate the words expected are the target.  Works on one row per source and weight.
    """
    per = sizes.filter("weight > 0 AND size > 0").groupBy("named", "weight").agg(
        F.sum("size").alias("words"), F.first("target").alias("target"))
    down = Window.partitionBy("named").orderBy(F.desc("weight"))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(most)
    open_ = F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rated = per.withColumn("rate", (F.col("target") - full) / open_)
    return rated.groupBy("named").agg(F.coalesce(
        F.max(F.when(F.col("rate") * F.col("weight") <= most, F.col("rate"))), F.lit(float(most)) / F.min("weight")).alias("rate"))


def uniform(seed: str, row_id: Column, text: Column) -> Column:
    """A number inside (0, 1) from an md5 digest of id and text, the same in any engine."""
    parts = [F.lit(seed), F.coalesce(row_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def length_weight(size: Column) -> Column:
    """Binary digits of the word count: a long document is likelier than a short one, by far less than its length."""
    return F.length(F.bin(size)).cast("double")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
        seed: str = "mix") -> DataFrame:
    """(id, size, source_size, target, copies) of every row of ``docs``.

    Within a source the expected copies are in proportion to ``weight_col`` (three digits of it count; null,
    negative and not finite weigh nothing) or, without one, to :func:`length_weight`.  ``copies`` is at most ``most`` rounded up.  Where
    rows of weight cannot hold the target, they get the most and the source falls short.  A null text has no words, a
    null source is a source of its own.  A row of no words gets its whole copies and takes no part in the rest.  Rows
    that are equal in id, source and text are interchangeable: which of them gets a copy at the cut is not defined, how
    many do is.  An empty table gives an empty result.
    """
    return _mix(docs, weights, share, most, id_col, text_col, source_col, weight_col, seed).drop("u")


def _mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
         seed: str = "mix") -> DataFrame:
    """:func:`mix` with the seeded number of each row."""
    taken = {"id": F.col(id_col), "source": F.col(source_col), "text": F.col(text_col)}
    if weight_col:  # few different weights, however fine the column
        given = F.col(weight_col).cast("double")
        taken["weight"] = F.when((given > 0) & (given < float("inf")), F.format_string("%.2e", given).cast("double")).otherwise(0.0)
    rows = spread(docs.select(*[c.alias(n) for n, c in taken.items()])).withColumns(
        {"size": word_count(F.col("text")), "u": uniform(seed, F.col("id"), F.col("text")),
         "named": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))}).drop("text")
    if not weight_col:
        rows = rows.withColumn("weight", length_weight(F.col("size")))
    rows = materialize(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, most)
    targets = materialize(targets.withColumn("named", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"),
                          "mix-targets")
    rows = rows.join(targets, "named")
    rates = materialize(inclusion_rates(rows, most), "mix-rates")
    rows = rows.join(rates, "named", "left")

    rate = F.coalesce("rate", F.lit(0.0))  # a source without a word to take has none
    copies = F.least(rate * F.col("weight"), F.lit(float(most)))
    whole = F.floor(copies + 1e-9)
    drawn = (rows.withColumn("whole", whole.cast("long")).withColumn("p", copies - whole)
             .withColumn("p", F.when((F.col("size") > 0) & (F.col("p") > 1e-9), F.col("p")).otherwise(0.0)))
    drawn = materialize(drawn, "mix-drawn")
    budget = drawn.groupBy("named").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"),
                                        F.sum(F.when(F.col("p") > 0, F.col("size"))).alias("open_size"),
                                        F.sum(F.col("p") * F.col("size")).alias("open_share"))
    budget = materialize(budget, "mix-budget")
    buckets = F.greatest(F.lit(64.0), F.least(F.lit(float(1 << 20)), F.ceil(F.col("n_docs") / ROWS_PER_BUCKET)))
    odds = lambda p: F.log(p / (1 - p))
    # Pareto's key, as log odds; shifted by the source's mean odds its logistic is even over (0, 1)
    ranked = (drawn.filter(F.col("p") > 0).join(budget, "named")
              .withColumn("typical", F.least(F.greatest(F.col("open_share") / F.col("open_size"), F.lit(1e-9)), F.lit(1 - 1e-9)))
              .withColumn("key", odds(F.col("u")) - odds(F.col("p")))
              .withColumn("bucket", F.floor(buckets / (1 + F.exp(-(F.col("key") + odds(F.col("typical")))))))
              .withColumn("rest", F.col("target") - F.col("certain"))
              .select("id", "source", "named", "size", "source_size", "target", "u", "whole", "key", "bucket", "rest"))
    ranked = materialize(ranked, "mix-ranked")
    sums = ranked.groupBy("named", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = Window.partitionBy("named").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
           .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
           .select("named", F.col("bucket").alias("cut"), "before"))
    cut = materialize(cut, "mix-cut")  # at most one row a source
    placed = ranked.join(cut, "named", "left")
    inside = placed.filter(F.col("bucket") == F.col("cut"))
    order = (Window.partitionBy("named").orderBy("key", "id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    inside = (inside.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
              .withColumn("extra", F.col("before") + F.col("size") / 2 <= F.col("rest")))
    outside = placed.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn(
        "extra", F.when(F.col("cut").isNull(), F.col("rest") > 0).otherwise(F.col("bucket") < F.col("cut")))
    keep = ["id", "source", "size", "source_size", "target", "u"]
    out = [d.select(*keep, (F.col("whole") + F.col("extra").cast("long")).alias("copies")) for d in (inside, outside)]
    out.append(drawn.filter(F.col("p") <= 0).select(*keep, F.col("whole").alias("copies")))
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumnsRenamed({"id": id_col, "source": source_col})


def repeat(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns kept, whatever they are named."""
    names = docs.columns
    place = {name: f"c{k}" for k, name in enumerate(names)}
    id_col, text_col, source_col = (place[options.pop(f"{n}_col", d)] for n, d in
                                    (("id", "doc_id"), ("text", "text"), ("source", "source")))
    if options.get("weight_col"):
        options["weight_col"] = place[options["weight_col"]]
    rows = docs.toDF(*place.values())

    def key(u: Column) -> Column:  # rows that agree here are interchangeable
        return F.to_json(F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"), u.alias("u")))

    mixed = _mix(rows, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    per = materialize(mixed.withColumn("_key", key(F.col("u"))).groupBy("_key").agg(
        F.min("copies").alias("_least"), F.max("copies").alias("_most"), F.sum("copies").alias("_sum"),
        F.count("*").alias("_rows")).filter("_most > 0"), "mix-copies")
    keyed = rows.withColumn("_key", key(uniform(options.get("seed", "mix"), F.col(id_col), F.col(text_col))))
    even = keyed.join(per.filter("_least = _most"), "_key").withColumn("_copies", F.col("_least"))
    # the cut of a source may run through equal rows: the first of them get one more
    number = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))
    more = F.col("_sum") - F.col("_least") * F.col("_rows")
    uneven = keyed.join(per.filter("_least <> _most"), "_key").withColumn("_copies", F.col("_least") + (number <= more).cast("long"))
    taken = even.select(*rows.columns, "_copies").unionByName(uneven.select(*rows.columns, "_copies")).filter("_copies > 0")
    return (taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .select(*rows.columns).toDF(*names))
