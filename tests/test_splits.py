from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldsmith.operators import splits as S


def labelled(spark, sizes):
    """``sizes``: dataset -> (negatives, positives)."""
    data, i = [], 0
    for ds, counts in sizes.items():
        for y, n in enumerate(counts):
            for _ in range(n):
                data.append((i, ds, y, i % 7 == 0))
                i += 1
    return spark.createDataFrame(data, "id long, ds string, y int, has_sibling boolean")


def test_folds_partition_the_rows_and_keep_the_class_shares(spark, small_blocks):
    df = labelled(spark, {"big": (50, 23), "three": (9, 3), "one": (9, 1), "alone": (0, 1)})
    out = S.stratified_kfold(df, ["ds"], "id", "y").join(df.select("id", "y"), "id").collect()
    assert {r["ds"] for r in out} == {"big", "three"}
    tests = Counter(r["id"] for r in out if r["role"] == "test")
    assert set(tests.values()) == {1} and len(tests) == 85
    assert {r["fold"] for r in out if r["ds"] == "three"} == {0, 1, 2}
    per_fold = Counter((r["fold"], r["y"]) for r in out if r["ds"] == "big" and r["role"] == "test")
    assert max(per_fold[f, 1] for f in range(5)) - min(per_fold[f, 1] for f in range(5)) <= 1


def test_folds_do_not_depend_on_partitioning(spark):
    df = labelled(spark, {"a": (40, 20)})
    first, second = [sorted(map(tuple, S.stratified_kfold(df.repartition(n), ["ds"], "id", "y").collect())) for n in (1, 6)]
    assert first == second


def test_sibling_variants(spark):
    df = labelled(spark, {"a": (40, 20)})
    out = S.sibling_variants(df, lambda rows: S.stratified_kfold(rows, ["ds"], "id", "y")).collect()
    alone = {r["id"] for r in out if r["drop_siblings"]}
    assert alone == {i for i in range(60) if i % 7} and len({r["id"] for r in out if not r["drop_siblings"]}) == 60


def test_all_siblings_leave_no_dropped_variant(spark):
    df = labelled(spark, {"a": (4, 4)}).withColumn("has_sibling", F.lit(True))
    out = S.sibling_variants(df, lambda rows: S.stratified_kfold(rows, ["ds"], "id", "y"))
    assert out.filter("drop_siblings").count() == 0 and out.count() == 32


@pytest.mark.parametrize("tr_te, want", [
    ([(3, 2), (5, 4), (5, 4)], 1), ([(1, 9), (9, 1)], 0), ([(9, 1), (2, 2)], 1)])
def test_best_fold(spark, tr_te, want):
    df = spark.createDataFrame([("d", f, a, b) for f, (a, b) in enumerate(tr_te)], "ds string, fold int, train_min long, test_min long")
    assert S.best_fold(df, ["ds"]).first()["best_fold"] == want


def test_a_fold_with_one_class_on_a_side_is_no_candidate(spark):
    df = spark.createDataFrame([("d", 0, "train", 1), ("d", 0, "train", 0), ("d", 0, "test", 1)], "ds string, fold int, role string, y int")
    assert S.fold_balance(df, ["ds"], "y").count() == 0


def test_nested_folds_stay_in_their_train_side(spark):
    df = labelled(spark, {"a": (30, 15)})
    outer = S.stratified_kfold(df, ["ds"], "id", "y", 3)
    inner = S.nested_splits(outer, df, ["ds"], "id", "y", 3)["inner"].collect()
    train = defaultdict(set)
    for r in outer.collect():
        if r["role"] == "train":
            train[r["fold"]].add(r["id"])
    tested = Counter((r["outer_fold"], r["id"]) for r in inner if r["role"] == "test")
    assert set(tested.values()) == {1} and {o: {i for p, i in tested if p == o} for o in train} == dict(train)


def test_duplicate_folds_go_as_a_whole(spark):
    data = [(f, i, "test" if i in test else "train") for f, test in enumerate([{1, 2}, {2, 1}, {3}]) for i in range(5)]
    df = spark.createDataFrame(data, "fold int, id long, role string")
    assert {r["fold"] for r in S.unique_folds(df, [], "id").collect()} == {0, 2}


def test_aligned_split_edges(spark):
    # id 3 is missing in the parent, id 2 is a sibling there; pair q has no parent rows
    parent = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("p", 4, False)], "pair string, id long, has_sibling boolean")
    child = spark.createDataFrame([(q, d, 0, i, "test" if i < 4 else "train") for q in "pq" for d in (False, True) for i in (1, 2, 3, 4)],
                                  "pair string, drop_siblings boolean, fold int, id long, role string")
    sides = S.aligned_split(parent, child, ["pair"], "id")
    got = {(r["drop_siblings"], r["id"]): r["role"] for r in sides["parent"].collect()}
    assert got == {(False, 1): "test", (False, 2): "test", (False, 4): "train", (True, 1): "test", (True, 2): None, (True, 4): "train"}
    back = {(r["pair"], r["drop_siblings"], r["id"]): r["role"] for r in sides["child"].collect()}
    assert [back["p", False, i] for i in (1, 2, 3, 4)] == ["test", "test", None, "train"]
    assert [back["p", True, i] for i in (1, 2, 3, 4)] == ["test", None, None, "train"]
    assert [back["q", False, i] for i in (1, 2, 3, 4)] == [None, None, None, "train"]


def test_pairs_agree_on_what_the_parent_level_asks(spark):
    keys = "level string, target string, effect string, assay string, std_type string, assay_id string"
    df = spark.createDataFrame([
        ("hhd", "t", None, None, "Ki", None), ("mhd-effect", "t", "bind", None, None, None), ("mhd", "t", "bind", "RBA", "Ki", None),
        ("lhd", "t", "bind", "RBA", "Ki", "a"), ("mhd", "t", "agon", "B", "EC50", None), ("lhd", "u", "bind", "RBA", "Ki", "b")], keys)
    got = {(r["parent_level"], r["child_level"], r["child_assay"]) for r in S.pair_datasets(df).collect()}
    assert got == {("hhd", "mhd", "RBA"), ("hhd", "lhd", "RBA"), ("mhd-effect", "mhd", "RBA"), ("mhd-effect", "lhd", "RBA"), ("mhd", "lhd", "RBA")}


def test_holdout_and_draws(spark, small_blocks):
    df = spark.createDataFrame([(i, f"g{i % 5}", int(i % 4 == 0)) for i in range(100)], "id long, g string, y int")
    out = Counter(r["role"] for r in S.holdout_by_group(df, "g", F.col("g") == "g0", "id", ratio=9).collect())
    assert out == {"test": 20, "valid": 8, "train": 72}
    assert Counter(r["role"] for r in S.holdout_by_group(df, "g", F.col("g") == "g0", "id").collect())["valid"] == 1
    assert Counter(r["y"] for r in S.undersample(df, "y", "id").collect()) == {0: 25, 1: 25}
    assert S.undersample(df, "y", "id", cap=10).count() == 10
    assert S.subsample(df, "id", share=0.33).count() == 33
    ranked = df.withColumn("rank", F.col("id"))
    assert Counter(r["role"] for r in S.ordered_split(ranked, "rank", 0.6).collect()) == {"train": 60, "valid": 20, "test": 20}
