import random

import pytest
from pyspark.sql import functions as F

from foldsmith.operators import ml
from foldsmith.operators.splits import nested_splits, stratified_kfold


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(5 * (i % 2), 1), rng.gauss(0, 1)], i % 2) for i in range(60)]
    return spark.createDataFrame(data, "id long, features array<double>, label int").cache()


def test_every_algorithm_learns_a_gap(spark, rows):
    fold = stratified_kfold(rows, [], "id", "label", 3).filter("fold = 0")
    jobs = [({"algo": a}, fold, a, p) for a, p in (("RF", {"numTrees": 5}), ("GB", {"maxIter": 3}), ("SVM", {"maxIter": 10}), ("KNN", {"k": 5}))]
    scored = ml.score(ml.fit_all(rows, jobs, "id"), rows, ["algo"], "id").collect()
    assert {r["algo"] for r in scored} == set(ml.ALGORITHMS) and all(r["auroc"] > 0.85 and r["accuracy"] > 0.7 for r in scored)


def test_one_class_in_training_gives_no_fit(rows):
    only = rows.select("id", F.when(F.col("label") == 1, "train").otherwise("test").alias("role"))
    assert ml.train_predict(rows, only, "KNN", {"k": 3}) is None
    assert ml.fit_all(rows, [({"x": 1}, only, "KNN", {"k": 3})], "id") is None


def test_grid_keeps_the_first_of_equals_and_falls_back_to_accuracy(rows):
    inner = stratified_kfold(rows, [], "id", "label", 2).withColumn("outer_fold", F.lit(3))
    (outer, config, value), = ml.grid_search(rows, inner, "KNN", {"k": [5, 5]})
    assert (outer, config) == (3, {"k": 5}) and value > 0.8
    # validation rows of one class have no AUROC
    sided = rows.select(F.lit(0).alias("outer_fold"), "id", F.lit(0).alias("fold"),
                        F.when((F.col("label") == 1) & (F.col("id") < 20), "test").otherwise("train").alias("role"))
    (_, _, value), = ml.grid_search(rows, sided, "KNN", {"k": [3]})
    assert value > 0.7


def test_pipelines(rows):
    outer = stratified_kfold(rows, [], "id", "label", 2)
    out = {r["pipeline"]: r for r in ml.run_pipelines(rows, outer, "KNN", {"k": [3, 5]}, list(ml.PIPELINES), inner_folds=2).collect()}
    assert set(out) == set(ml.PIPELINES) and all(r["auroc"] > 0.85 for r in out.values())


def test_no_usable_outer_fold_is_an_error(rows):
    outer = rows.select("id", F.lit(0).alias("fold"), F.when(F.col("label") == 1, "test").otherwise("train").alias("role"))
    splits = nested_splits(outer, rows, [], "id", "label", 2)
    with pytest.raises(ValueError):
        ml.holdout_cv(rows, outer, splits, "KNN", {"k": [3]})


def test_aligned_benchmark(rows):
    out = ml.benchmark_aligned(rows, rows.filter("id < 40"), {"SVM": {"maxIter": [5]}}, ["HoldoutCV"], folds=2, inner_folds=2).first()
    assert (out["parent_size"], out["child_size"]) == (60, 40) and out["parent_auroc"] > 0.85 and out["child_auroc"] > 0.85


def test_grid_is_the_product_of_its_lists():
    assert ml.expand_grid({"a": [1, 2], "b": 3}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_pipelines_share_their_fits(spark, monkeypatch):
    tuned, fits = [], []

    def search(features, inner, algo, grid, metric, row_id):
        folds = sorted(r["outer_fold"] for r in inner.select("outer_fold").distinct().collect())
        tuned.extend(folds)
        return [(o, {"c": o % 2}, 0.5) for o in folds]

    def fit(features, jobs, row_id):
        cells = [(tags["fold"], c["c"]) for tags, _, _, c in jobs]
        fits.extend(cells)
        return spark.createDataFrame(cells, "fold int, c int")

    monkeypatch.setattr(ml, "grid_search", search)
    monkeypatch.setattr(ml, "fit_all", fit)
    monkeypatch.setattr(ml, "score", lambda found, *_: found.select("fold", *[(F.col("fold") * 10.0 + F.col("c")).alias(m) for m in ml.METRICS]))
    monkeypatch.setattr(ml, "nested_splits", lambda *_: {"inner": spark.createDataFrame([(0,), (1,), (2,)], "outer_fold int"),
                                                         "best": spark.createDataFrame([(1,)], "best_fold int")})
    rows = spark.createDataFrame([(1, [1.0], 1)], "id long, features array<double>, label int")
    outer = spark.createDataFrame([(1, 0, "train")], "id long, fold int, role string")
    out = {r["pipeline"]: r["auroc"] for r in ml.run_pipelines(rows, outer, "KNN", {"c": [0, 1]}, list(ml.PIPELINES)).collect()}
    assert out == pytest.approx({"HoldoutCV": 11.0, "SingleNestedCV": 11.0, "NestedCV": 31 / 3, "ConsensusNestedCV": 10.0})
    assert sorted(tuned) == [0, 1, 2] and sorted(fits) == [(f, c) for f in range(3) for c in range(2)]  # each once


def test_neighbors_are_searched_once_a_fold(rows, monkeypatch):
    searched, votes = [], ml.knn_votes
    monkeypatch.setattr(ml, "knn_votes", lambda train, test, k, *rest: searched.append(k) or votes(train, test, k, *rest))
    outer = stratified_kfold(rows, [], "id", "label", 2)
    ml.run_pipelines(rows, outer, "KNN", {"k": [3, 5]}, list(ml.PIPELINES), inner_folds=2)
    assert searched == [5] * (2 * 2 + 2)  # every inner and outer fold, whatever the number of configurations and pipelines


def test_a_smaller_k_is_read_off_the_largest_search(rows):
    fold = stratified_kfold(rows, [], "id", "label", 2).filter("fold = 0")
    search = ml.Search([{"k": 3}, {"k": 9}])
    for k in (9, 3, 1):
        shared, own = (sorted(tuple(r) for r in ml.train_predict(rows, fold, "KNN", {"k": k} | more).collect()) for more in ({"search": search}, {}))
        assert shared == own and len(own) == 30
