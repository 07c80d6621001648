"""Train/test assignments as long tables: (dataset key, row id, fold, role)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_dimension, join_group_stats
from .rank import distributed_rank, rank_by_value, seeded_order

# fixed values: which levels a level is aligned with, and the key parts that must agree
ALIGNMENT = {"hhd": ("mhd", "lhd"), "mhd-effect": ("mhd", "lhd"), "mhd": ("lhd",)}
SHARED_KEY = {"hhd": ("target", "std_type"), "mhd-effect": ("target", "effect"),
              "mhd": ("target", "effect", "assay", "std_type")}
KEY_PARTS = ("target", "effect", "assay", "std_type", "assay_id")


def folds_to_roles(tests: DataFrame, dataset: Sequence[str], row_id: str, k: str = "k") -> DataFrame:
    """From each row's test fold to one row per (row, fold) with its role; ``k`` folds per dataset."""
    folds = F.sequence(F.lit(0), F.col(k).cast("int") - 1)
    spread = tests.select(*dataset, row_id, F.col("test_fold"), F.explode(folds).alias("fold"))
    role = F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train")
    return spread.select(*dataset, row_id, "fold", role.alias("role"))


def stratified_folds(rows: DataFrame, dataset: Sequence[str], row_id: str, label: str, k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Test fold of each row, classes dealt out evenly in seeded order.

    ``k`` falls to the size of the dataset's smallest class where that is less; below two folds the dataset is left
    out.
    """
    dataset = list(dataset)
    labelled = rows.filter(F.col(label).isNotNull()).select(*dataset, row_id, label)
    per_class = labelled.groupBy(*dataset, label).agg(F.count("*").alias("n"))
    sizes = (per_class.groupBy(*dataset).agg(F.min("n").alias("_min"), F.sum("n").alias("n"))
             .withColumn("k", F.least(F.lit(k), F.col("_min")).cast("int")).filter("k >= 2").drop("_min"))
    ranked = distributed_rank(labelled, [*dataset, label], seeded_order(seed, row_id), [F.col(row_id)])
    if dataset:
        placed = join_group_stats(ranked, materialize(sizes, "fold-counts"), dataset, [row_id])
    else:
        placed = ranked.withColumn("k", sizes.select("k").scalar()).filter("k IS NOT NULL")
    return placed.select(*dataset, row_id, F.pmod("rank", "k").cast("int").alias("test_fold"), "k")


def stratified_kfold(rows: DataFrame, dataset: Sequence[str], row_id: str, label: str, k: int = 5,
                     seed: int = 42) -> DataFrame:
    return folds_to_roles(stratified_folds(rows, dataset, row_id, label, k, seed), dataset, row_id)


def sibling_variants(rows: DataFrame, split, flag: str = "has_sibling") -> DataFrame:
    """``split`` applied to all rows and to the rows without siblings, told apart by ``drop_siblings``."""
    every = split(rows).withColumn("drop_siblings", F.lit(False))
    return every.unionByName(split(rows.filter(~F.col(flag))).withColumn("drop_siblings", F.lit(True)))


def holdout_by_group(rows: DataFrame, group: str, test_groups: Column, row_id: str, ratio: int = 100,
                     seed: int = 42, by_group: bool = False) -> DataFrame:
    """Rows of the test groups become ``test``; of the rest one part in ``ratio + 1``, at least one, is ``valid``.

    With ``by_group`` whole groups are drawn for validation instead of rows.
    """
    unit = group if by_group else row_id
    rest = rows.filter(~F.coalesce(test_groups, F.lit(False)))
    pool = rest.select(unit).distinct()
    ranked = distributed_rank(pool, [], seeded_order(seed, unit), [F.col(unit)])
    n_valid = F.greatest(F.lit(1), F.floor(pool.agg(F.count("*")).scalar() / (ratio + 1)))
    drawn = ranked.withColumn("_n", n_valid).filter("rank < _n").select(unit, F.lit("valid").alias("_drawn"))
    joined = join_dimension(rows, drawn, [unit], [row_id], "left")
    role = F.when(test_groups, "test").when(F.col("_drawn").isNotNull(), "valid").otherwise("train")
    return joined.select(row_id, group, role.alias("role"))


def cut_points(n: Column, train_size: float) -> tuple[Column, Column]:
    """Ends of the first and second chunk: ``train_size`` of ``n``, then half of the rest, rounded half to even."""
    first = F.bround(n * train_size, 0)
    return first, first + F.bround((n - first) / 2, 0)


def ordered_split(ranked: DataFrame, rank: str, train_size: float = 0.6) -> DataFrame:
    """Oldest ``train_size`` for training, the older half of the rest for validation, the newest for test."""
    total = ranked.agg(F.count("*").cast("double")).scalar()
    placed = ranked.withColumn("_n", total)
    first, second = cut_points(F.col("_n"), train_size)
    role = F.when(F.col(rank) < first, "train").when(F.col(rank) < second, "valid").otherwise("test")
    return placed.withColumn("role", role).drop("_n")


def undersample(rows: DataFrame, label: str, row_id: str, seed: int = 42, cap: int | None = None) -> DataFrame:
    """All positives and as many negatives, drawn in seeded order; ``cap`` then limits the whole draw."""
    ranked = distributed_rank(rows, [label], seeded_order(seed, row_id), [F.col(row_id)], out="_r")
    n_pos = rows.agg(F.count_if(F.col(label) == 1)).scalar()
    kept = ranked.withColumn("_p", n_pos).filter((F.col(label) == 1) | (F.col("_r") < F.col("_p"))).drop("_r", "_p")
    return kept if cap is None else subsample(kept, row_id, seed + 1, size=cap)


def subsample(rows: DataFrame, row_id: str, seed: int = 42, size: int | None = None,
              share: float | None = None) -> DataFrame:
    """Exactly ``size`` rows, or ``share`` of them, drawn in seeded order."""
    ranked = distributed_rank(rows, [], seeded_order(seed, row_id), [F.col(row_id)], out="_r")
    total = rows.agg(F.count("*")).scalar()
    limit = F.lit(size) if size is not None else F.floor(F.col("_n") * share)
    return ranked.withColumn("_n", total).filter(F.col("_r") < limit).drop("_r", "_n")


def unique_folds(assignments: DataFrame, dataset: Sequence[str], row_id: str) -> DataFrame:
    """Drops a whole fold where an earlier fold of the dataset has the same test rows.

    Test sets are compared by size and two order-free 64-bit digests, never by collecting them.
    """
    tests = assignments.filter(F.col("role") == "test")
    second = F.xxhash64(F.lit("2"), F.col(row_id))
    digests = tests.groupBy(*dataset, "fold").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64(row_id)).alias("_a"), F.bit_xor(second).alias("_b"))
    kept = digests.groupBy(*dataset, "_n", "_a", "_b").agg(F.min("fold").alias("fold")).select(*dataset, "fold")
    return join_dimension(assignments, kept, [*dataset, "fold"], [row_id])


def pair_datasets(datasets: DataFrame) -> DataFrame:
    """Parent/child pairs over distinct dataset keys: one equi-join for each entry of the alignment map."""
    pairs = []
    for parent, children in ALIGNMENT.items():
        left = datasets.filter(F.col("level") == parent).alias("p")
        right = datasets.filter(F.col("level").isin(list(children))).alias("c")
        same = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"c.{k}") for k in SHARED_KEY[parent]])
        pairs.append(left.join(right, same).select(
            *[F.col(f"p.{k}").alias(f"parent_{k}") for k in ("level", *KEY_PARTS)],
            *[F.col(f"c.{k}").alias(f"child_{k}") for k in ("level", *KEY_PARTS)]))
    return reduce(lambda a, b: a.unionByName(b), pairs)


def aligned_split(parent_rows: DataFrame, child_assignments: DataFrame, pair: Sequence[str], row_id: str,
                  flag: str = "has_sibling") -> dict[str, DataFrame]:
    """Carry a child's folds over to its parent, and back.

    ``parent_rows`` holds (pair, row_id, flag); ``child_assignments`` holds (pair, drop_siblings, fold, row_id,
    role).  Parent: a row in the child's test set is test, any other train; where siblings are dropped, sibling
    rows get no role.  Child: its own role, except that a test row the parent does not test gets none.
    """
    pair = list(pair)
    cell = [*pair, "drop_siblings", "fold"]
    sizes = parent_rows.groupBy(*pair).agg(F.count("*").alias("n"))
    # a pair has a handful of folds, so the list of them is short
    folds = child_assignments.select(*cell).distinct().groupBy(*pair).agg(F.collect_list(F.struct("drop_siblings", "fold")).alias("_cells"))
    tests = child_assignments.filter(F.col("role") == "test").select(*cell, row_id, F.lit(True).alias("_in_test"))
    listed = join_group_stats(parent_rows.select(*pair, row_id, flag), materialize(sizes.join(folds, pair), "pair-folds"), pair, [row_id])
    wide = listed.select(*pair, row_id, flag, F.explode("_cells").alias("_cell")).select(*pair, row_id, flag, "_cell.*")
    marked = wide.join(tests, [*cell, row_id], "left")
    role = (F.when(F.col("drop_siblings") & F.col(flag), None)
            .when(F.coalesce("_in_test", F.lit(False)), "test").otherwise("train"))
    parent = marked.select(*cell, row_id, role.alias("role"))
    tested = parent.filter(F.col("role") == "test").select(*cell, row_id, F.lit(True).alias("_tested"))
    child = child_assignments.join(tested, [*cell, row_id], "left")
    kept = F.when((F.col("role") == "test") & F.col("_tested").isNull(), None).otherwise(F.col("role"))
    return {"parent": parent, "child": child.select(*cell, row_id, kept.alias("role"))}


def fold_balance(assignments: DataFrame, dataset: Sequence[str], label: str) -> DataFrame:
    """Smaller class count of each fold's train and test side; folds lacking a class on either side are left out."""
    def smaller(role: str, name: str) -> Column:
        here = F.col("role") == role
        return F.least(F.count_if(here & (F.col(label) == 1)), F.count_if(here & (F.col(label) == 0))).alias(name)

    counts = assignments.groupBy(*dataset, "fold").agg(smaller("train", "train_min"), smaller("test", "test_min"))
    return counts.filter("train_min > 0 AND test_min > 0")


def best_fold(balance: DataFrame, dataset: Sequence[str], at_least: int = 2) -> DataFrame:
    """Fold with both minima at ``at_least`` and the largest sum, the first such; else the first fold."""
    good = (F.col("train_min") >= at_least) & (F.col("test_min") >= at_least)
    order = F.struct(F.when(good, F.col("train_min") + F.col("test_min")).otherwise(F.lit(-1)), -F.col("fold"))
    return balance.groupBy(*dataset).agg(F.max_by("fold", order).alias("best_fold"))


def nested_splits(assignments: DataFrame, rows: DataFrame, dataset: Sequence[str], row_id: str, label: str,
                  k: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """Inner stratified folds within the train side of every outer fold, and the best outer fold.

    The outer fold is one more dataset column, so all inner splits are one job.
    """
    labelled = assignments.join(rows.select(*dataset, row_id, label), [*dataset, row_id])
    balance = fold_balance(labelled, dataset, label)
    train = (labelled.filter(F.col("role") == "train")
             .transform(lambda rows_: join_dimension(rows_, balance.select(*dataset, "fold"), [*dataset, "fold"], [row_id]))
             .withColumnRenamed("fold", "outer_fold"))
    inner = stratified_kfold(materialize(train.drop("role"), "outer-train"), [*dataset, "outer_fold"], row_id, label, k, seed)
    usable = inner.select(*dataset, F.col("outer_fold").alias("fold")).distinct()
    return {"inner": inner, "best": best_fold(balance.join(usable, [*dataset, "fold"], "left_semi"), dataset)}


def fold_audit(assignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return assignments.groupBy(*keys, "fold", "role").agg(F.count("*").alias("n"))


def schemes_available(assignments: DataFrame, dataset: Sequence[str], schemes: Sequence[str]) -> DataFrame:
    """Fold count of each scheme per dataset, one column a scheme."""
    return assignments.groupBy(*dataset).agg(
        *[F.count_distinct(F.when(F.col("scheme") == s, F.col("fold"))).alias(f"folds_{s}") for s in schemes])


def interleaved_cut(rows: DataFrame, cluster: Sequence[str], row_id: str, share: float, seed: int = 42) -> DataFrame:
    """First ``share`` of the rows when clusters are drawn from evenly, by each member's position in its cluster.

    Positions lie in [0, 1) and repeat: every cluster's first member has position 0.  ``row_id``, a number, orders those.
    """
    cluster = list(cluster)
    sizes = materialize(rows.groupBy(*cluster).agg(F.count("*").alias("n")), "cluster-sizes")
    ranked = distributed_rank(rows, cluster, seeded_order(seed, row_id), [F.col(row_id)], out="_r")
    placed = (join_group_stats(ranked, sizes, cluster, [row_id])
              .withColumn("position", F.col("_r") / F.col("n")).drop("_r", "n"))
    placed = materialize(placed, "positions")
    ordered = rank_by_value(placed, [], "position", [F.col(row_id)], out="place", repeats=row_id)
    total = sizes.agg(F.sum("n")).scalar()
    return ordered.withColumn("_n", total).filter(F.col("place") < F.col("_n") * share).drop("_n")
