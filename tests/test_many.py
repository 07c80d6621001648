"""Models of many datasets against plain ones fitted one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.operators import many
from foldsmith.operators.splits import sibling_variants, stratified_kfold


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(f"d{i % 3}", i, [rng.gauss((1 + i % 3) * (i // 3 % 2), 1), rng.gauss(3, 2), 7.0, rng.gauss(0, 1)], i // 3 % 2, i % 5 == 0)
            for i in range(240)]
    data += [("one", 1000 + i, [float(i), 0.0, 7.0, 0.0], 1, False) for i in range(6)]
    return spark.createDataFrame(data, "ds string, id long, features array<double>, label int, sib boolean").cache()


@pytest.fixture(scope="module")
def outer(rows):
    return sibling_variants(rows, lambda kept: stratified_kfold(kept, ["ds"], "id", "label", 3), "sib").cache()


KEYS = ["ds", "drop_siblings", "fold"]


def plain_linear(x, y, reg, steps):
    mean, std = x.mean(0), x.std(0, ddof=1)
    scale = np.where(std > 1e-12, 1 / np.where(std > 1e-12, std, 1), 0)
    z, w, b = (x - mean) * scale, np.zeros(x.shape[1]), 0.0
    v, vb = w.copy(), b
    rate = 1 / (0.25 * ((scale > 0).sum() + 1) + reg)
    for k in range(steps):
        e = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new, new_b = v - rate * (z.T @ e / len(y) + reg * v), vb - rate * e.mean()
        v, vb, w, b = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b), new, new_b
    return lambda t: 1 / (1 + np.exp(-((t - mean) * scale @ w + b)))


def units_of(rows, outer):
    data = {(r.ds, r.id): r for r in rows.collect()}
    units = {}
    for r in outer.collect():
        units.setdefault((r.ds, r.drop_siblings, r.fold), {"train": [], "test": []})[r.role].append(data[r.ds, r.id])
    return {k: sides for k, sides in units.items() if len({r.label for r in sides["train"]}) == 2}


def test_linear_models_equal_one_fit_per_unit(rows, outer):
    configs = [{"reg": 0.01, "iterations": 6}, {"reg": 0.5}]
    got = {(r.ds, r.drop_siblings, r.fold, r.config, r.id): r.probability
           for r in many.fit_many(rows, outer, KEYS, ["ds"], "LINEAR", configs).collect()}
    want = {}
    for key, sides in units_of(rows, outer).items():
        x, y = np.array([r.features for r in sides["train"]]), np.array([r.label for r in sides["train"]])
        for c, config in enumerate(configs):
            p = plain_linear(x, y, config["reg"], 6)(np.array([r.features for r in sides["test"]]))
            want |= {(*key, c, r.id): v for r, v in zip(sides["test"], p)}
    assert got.keys() == want.keys() and len({k[:2] for k in got}) == 6  # three datasets, two sibling modes
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def plain_tree(rows, depth):
    """Share of positives by greedy Gini splits at the bins; rows are (bins, label)."""
    pos = sum(y for _, y in rows)
    share = pos / len(rows)
    purity = lambda rs: (sum(y for _, y in rs) ** 2 + sum(1 - y for _, y in rs) ** 2) / len(rs)
    best = None
    for f in range(len(rows[0][0])) if depth else ():
        for b in sorted({r[0][f] for r in rows})[:-1]:
            left, right = [r for r in rows if r[0][f] <= b], [r for r in rows if r[0][f] > b]
            gain = round(purity(left) + purity(right) - purity(rows), 9)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, f, b, left, right
    if best is None:
        return lambda bins: share
    _, f, b, left, right = best
    low, high = plain_tree(left, depth - 1), plain_tree(right, depth - 1)
    return lambda bins: low(bins) if bins[f] <= b else high(bins)


def test_trees_equal_greedy_ones_grown_unit_by_unit(rows, outer):
    placed = many.place_units(rows, outer, KEYS, ["ds"], "id").cache()
    binned = many._binned(placed, "id", 8).cache()
    model = many.forests(binned, "id", trees=1, depth=3, features=None, bootstrap=False)
    configs = [{"trees": 1, "depth": d} for d in (0, 1, 3)]
    got = {(r.unit, r.id): r.probabilities for r in many.predict_forests(binned, model, configs, "id").collect()}
    units = {}
    for r in binned.collect():
        units.setdefault(r.unit, {"train": [], "test": []})[r.role].append(r)
    assert len(units) == 18 and len(got) == sum(len(s["test"]) for s in units.values())
    for unit, sides in units.items():
        for c, config in enumerate(configs):
            tree = plain_tree([(r.bins, r.label) for r in sides["train"]], config["depth"])
            for r in sides["test"]:
                assert got[unit, r.id][c] == pytest.approx(tree(r.bins))


def test_forests_learn_and_do_not_depend_on_the_other_datasets(rows, outer):
    configs = [{"trees": 6, "depth": 3}, {"trees": 3, "depth": 1}]
    fit = lambda some: {tuple(r) for r in many.fit_many(rows.filter(some), outer.filter(some), KEYS, ["ds"], "FOREST", configs).collect()}
    together = fit(F.lit(True))
    assert {r for r in together if r[0] == "d1"} == fit(F.col("ds") == "d1")
    far = [r for r in together if r[0] == "d2" and r[3] == 0]  # (ds, drop_siblings, fold, config, id, label, probability, ...)
    assert far and sum((r[6] > 0.5) == (r[5] == 1) for r in far) > 0.8 * len(far)


def jobs_of(spark, run):
    group = f"count {random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return found


def test_jobs_do_not_follow_the_number_of_datasets(spark, rows, outer):
    run = lambda some: lambda: many.fit_many(rows.filter(some), outer.filter(some), KEYS, ["ds"], "LINEAR", [{"iterations": 2}]).count()
    assert abs(jobs_of(spark, run(F.lit(True))) - jobs_of(spark, run(F.col("ds") == "d1"))) <= 5


def test_pipelines_over_all_datasets(rows, outer):
    out = many.run_pipelines_many(rows, outer, ["ds", "drop_siblings"], ["ds"], "LINEAR", [{"reg": 0.01, "iterations": 4}, {"reg": 1e6}],
                                  ["HoldoutCV", "SingleNestedCV", "NestedCV", "ConsensusNestedCV"], inner_folds=2).collect()
    assert len({(r.ds, r.drop_siblings, r.pipeline) for r in out}) == len(out) == 3 * 2 * 4
    assert all(r.auroc > 0.8 for r in out if r.ds == "d2") and not any(math.isnan(r.auroc) for r in out)


def test_algorithms_share_folds_and_units(rows, outer, monkeypatch):
    placed, place = [], many.place_units
    monkeypatch.setattr(many, "place_units", lambda *args: placed.append(args[2]) or place(*args))
    grids = {"LINEAR": [{"reg": 0.01, "iterations": 2}], "FOREST": [{"trees": 2, "depth": 1}]}
    some = F.col("ds") == "d2"
    out = many.benchmark_many(rows.filter(some), outer.filter(some), ["ds", "drop_siblings"], ["ds"], grids, ["NestedCV"], inner_folds=2).collect()
    assert {(r.algo, r.drop_siblings) for r in out} == {(a, s) for a in grids for s in (True, False)}
    assert sorted(map(len, placed)) == [3, 4]  # the outer and the inner units once, not once an algorithm


def test_registered_benchmark_does_the_whole_job(monkeypatch):
    from foldsmith.plans import learning
    given = {}
    monkeypatch.setattr(learning, "vector_datasets", lambda t: None)
    monkeypatch.setattr(learning, "sibling_variants", lambda rows, split: split(rows))
    monkeypatch.setattr(learning, "stratified_kfold", lambda *args: given.setdefault("folds", args[4:]))
    monkeypatch.setattr(many, "benchmark_many", lambda rows, outer, keys, dataset, grids, pipelines, **more: given.update(grids=grids, pipelines=pipelines, more=more))
    learning.benchmark_datasets(None)
    linear, forest = given["grids"]["LINEAR"], given["grids"]["FOREST"]
    # the five outer and inner folds, 25 steps, 10 trees and 4 levels that the operators take if not told otherwise
    assert given["folds"] == () and "inner_folds" not in given["more"] and len(given["pipelines"]) == 4
    assert linear[0].get("iterations", 25) >= 25 and max(c["trees"] for c in forest) >= 10 and max(c["depth"] for c in forest) >= 4
