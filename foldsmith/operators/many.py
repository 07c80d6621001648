"""Classifiers of many datasets, folds and configurations fitted together.

A unit is one training set: a dataset under one sibling mode, scheme and fold.  All units are fitted by the same jobs:
linear models by sums of gradients grouped by unit, forests level by level from histograms grouped by unit, tree and
node.  The number of jobs follows the iterations or the depth, never the number of units; a unit's rows are summed where
they lie, so no task holds a dataset, and what is kept of a model is as large as the model.  Configurations of one
algorithm share their passes: penalties are weighed side by side, and a smaller or shallower forest is read off the
largest one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import forget, materialize
from . import metrics as M
from .joins import HOT_ROWS, HOT_SHARE, join_dimension, join_group_stats
from .ml import METRICS
from .report import most_frequent, nan_mean
from .splits import nested_splits

BINS = 16
BLOCK_VALUES = 8192  # features of a block of training rows, which numpy multiplies at once
NODES = 1 << 16  # nodes of a tree are numbered below this, so trees have at most 15 levels
# fixed values: shares of a Poisson count of mean one that are at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)


def place_units(rows: DataFrame, assignments: DataFrame, keys: Sequence[str], dataset: Sequence[str], row_id: str) -> DataFrame:
    """(unit, share, shares, keys, row_id, role, label, features, n_train): the rows of units that train on two classes.

    The rows of a unit above 1/1000 of all rows (and ``HOT_ROWS``) are dealt to ``shares``, so that what is joined to them by
    unit can be repeated as often and no task gets a unit whole.
    """
    unit = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    wide = join_dimension(assignments.select(*keys, row_id, "role"), rows.select(*dataset, row_id, "label", "features"),
                          [*dataset, row_id], list(keys))
    named = materialize(wide.select(unit.alias("unit"), *keys, row_id, "role", F.col("label").cast("int").alias("label"),
                                    F.col("features").cast("array<double>").alias("features")), "unit-rows")
    train = F.col("role") == "train"
    sizes = materialize(named.groupBy("unit").agg(
        F.count("*").alias("n"), F.count_if(train).alias("n_train"), F.min(F.when(train, F.col("label"))).alias("_low"),
        F.max(F.when(train, F.col("label"))).alias("_high")).filter("_low < _high").drop("_low", "_high"), "unit-sizes")
    share = max((sizes.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE, HOT_ROWS)
    sizes = materialize(sizes.withColumn("shares", F.ceil(F.col("n") / share).cast("int")), "unit-shares")
    return join_group_stats(named, sizes, ["unit"], [row_id]).drop("n").withColumn(
        "share", F.pmod(F.xxhash64(row_id), F.col("shares")).cast("int"))


def join_units(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` (unit, share, ...) with the columns of their unit's row in ``models`` (unit, shares, ...)."""
    copies = models.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return rows.drop("shares").join(copies, ["unit", "share"])


def _blocks(train: DataFrame) -> DataFrame:
    """(unit, share, shares, x, y): training rows laid end to end in blocks of a unit, where they lie and without a shuffle."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (unit, share), part in pdf.groupby(["unit", "share"], sort=False):
                rows = max(1, BLOCK_VALUES // max(1, len(part["features"].iloc[0])))
                for at in range(0, len(part), rows):
                    some = part.iloc[at:at + rows]
                    out.append((unit, share, some["shares"].iloc[0], np.concatenate(some["features"].tolist()), some["label"].to_numpy(float)))
            yield pd.DataFrame(out, columns=["unit", "share", "shares", "x", "y"])

    return train.select("unit", "share", "shares", "features", "label").mapInPandas(
        pack, "unit string, share int, shares int, x array<double>, y array<double>")


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The gradients of each block under the weights joined to it, then the sums of its errors, configuration after configuration."""
    for pdf in batches:
        out = []
        for x, y, rw, rb in zip(pdf["x"], pdf["y"], pdf["rw"], pdf["rb"]):
            rows = x.reshape(len(y), -1)
            with np.errstate(over="ignore"):
                e = 1 / (1 + np.exp(-(rows @ np.stack(rw).T + rb))) - y[:, None]
            out.append(np.concatenate([(e.T @ rows).ravel(), e.sum(0)]))
        yield pd.DataFrame({"unit": pdf["unit"], "g": out})


def linear_models(placed: DataFrame, configs: Sequence[dict], row_id: str) -> DataFrame:
    """(unit, shares, w): logistic weights of every unit, an array per configuration, the intercept last.

    The loss is the mean log loss plus ``reg`` / 2 times the squared weights of the standardized features, brought down
    by ``iterations`` accelerated gradient steps (of the first configuration); the step follows from a bound on the
    curvature.  Features without spread get no weight.
    """
    train = placed.filter("role = 'train'")
    regs, steps = [float(c.get("reg", 0.01)) for c in configs], int(configs[0].get("iterations", 25))
    vector = array_to_vector("features")
    stats = train.groupBy("unit").agg(F.max("shares").alias("shares"), F.max("n_train").alias("n_train"),
                                      Summarizer.metrics("mean", "std").summary(vector).alias("s"))
    state = materialize(stats.select("unit", "shares", "n_train", vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"),
                                     F.array(*[F.transform(vector_to_array("s.mean"), lambda x: x * 0.0) for _ in regs]).alias("w"),
                                     F.array(*[F.lit(0.0) for _ in regs]).alias("b")), "linear-start")
    state = materialize(state.select("*", F.col("w").alias("v"), F.col("b").alias("vb"),
                                     F.col("w").alias("rw"), F.col("b").alias("rb")), "linear-state")
    schema = state.schema
    blocks = materialize(_blocks(train), "linear-blocks")

    def update(batches: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in pdf.index:
                r = pdf.loc[at]
                n, mean, std = float(r["n_train"]), np.array(r["mean"]), np.array(r["std"])
                scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
                w, b, v, vb = [], [], [], []
                slopes, errors = np.array(r["g"][:-len(regs)]).reshape(len(regs), -1), r["g"][-len(regs):]
                for c, reg in enumerate(regs):
                    old, at_v = np.array(r["w"][c]), np.array(r["v"][c])
                    slope = (slopes[c] - mean * errors[c]) * scale / n + reg * at_v
                    rate = 1 / (0.25 * ((scale > 0).sum() + 1) + reg)
                    new, new_b = at_v - rate * slope, r["vb"][c] - rate * errors[c] / n
                    speed = step / (step + 3)
                    w.append(new)
                    b.append(new_b)
                    v.append(new + speed * (new - old))
                    vb.append(new_b + speed * (new_b - r["b"][c]))
                out = {"w": w, "b": b, "v": v, "vb": vb, "rw": [x * scale for x in v],
                       "rb": [i - float((x * scale) @ mean) for x, i in zip(v, vb)]}
                yield pd.DataFrame([{k: r[k] for k in ("unit", "shares", "n_train", "mean", "std")} | out])[schema.names]

    for step in range(steps):
        joined = join_units(blocks, state.select("unit", "shares", "rw", "rb"))
        parts = joined.select("unit", "x", "y", "rw", "rb").mapInPandas(_sums, "unit string, g array<double>")
        sums = parts.groupBy("unit").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
        new = state.join(sums, "unit").mapInPandas(lambda batches, step=step: update(batches, step), schema)
        state, old = materialize(new, "linear-state"), state
        forget(old)
    forget(blocks)
    scale = F.transform("std", lambda s: F.when(s > 0, 1.0 / s).otherwise(0.0))
    raw = F.transform("w", lambda w: F.zip_with(w, scale, lambda x, s: x * s))
    shift = F.transform(F.arrays_zip(raw.alias("w"), F.col("b").alias("b")), lambda z: z["b"] - V.dot(z["w"], F.col("mean")))
    return state.select("unit", "shares", F.zip_with(raw, shift, lambda w, b: F.concat(w, F.array(b))).alias("w"))


def predict_linear(placed: DataFrame, models: DataFrame, configs: Sequence[dict], row_id: str) -> DataFrame:
    """(unit, row_id, probabilities) of the test rows, a probability per configuration."""
    joined = join_units(placed.filter("role = 'test'"), models)
    ones = F.concat("features", F.array(F.lit(1.0)))
    return joined.select("unit", row_id, F.transform("w", lambda w: V.sigmoid(V.dot(ones, w))).alias("probabilities"))


def _binned(placed: DataFrame, row_id: str, bins: int) -> DataFrame:
    """Features as bin numbers, cut at quantiles of the unit's training rows."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    cells = placed.filter("role = 'train'").select("unit", "shares", F.posexplode("features").alias("f", "x"))
    cuts = cells.groupBy("unit", "f").agg(F.max("shares").alias("shares"), F.array_distinct(F.percentile_approx("x", shares, F.lit(1000))).alias("cuts"))
    per = materialize(cuts.groupBy("unit").agg(F.max("shares").alias("shares"), F.transform(  # a row per feature
        F.array_sort(F.collect_list(F.struct("f", "cuts"))), lambda s: s["cuts"]).alias("cuts")), "forest-cuts")
    joined = join_units(placed.withColumn("_shares", F.col("shares")), per).withColumnRenamed("_shares", "shares")
    binned = F.zip_with("features", "cuts", lambda x, cut: F.size(F.filter(cut, lambda c: c < x)))
    return materialize(joined.select("unit", "share", "shares", row_id, "role", "label", binned.alias("bins")), "forest-bins")


def _route(trees: int, levels: int) -> Column:
    """For every tree the node a row reaches after ``levels`` steps, or where it ends before."""
    def step(tree: Column, node: Column) -> Column:
        split = F.try_element_at("splits", tree * NODES + node)
        return F.when(split.isNull(), node).otherwise(
            2 * node + 1 + (F.try_element_at("bins", split["f"] + 1) > split["bin"]).cast("int"))

    start = F.lit(0)
    if not levels:
        return F.array_repeat(start, trees)
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.aggregate(
        F.sequence(F.lit(1), F.lit(levels)), start, lambda node, _: step(tree, node)))


def forests(binned: DataFrame, row_id: str, trees: int, depth: int, features: int | None, bootstrap: bool = True,
            seed: int = 42) -> DataFrame:
    """(unit, shares, splits, leaves): for every unit the splits of ``trees`` trees and the share of positives of each node.

    Each tree weighs rows by a seeded Poisson count, each node looks at ``features`` seeded features (None: all), and
    splits where the Gini impurity falls most; ties go to the lowest feature, then bin.
    """
    units = binned.groupBy("unit").agg(F.max("shares").alias("shares"), F.max(F.size("bins")).alias("d"))
    empty_s, empty_p = "map<int,struct<f:int,bin:int>>", "map<int,double>"
    model = materialize(units.select("unit", "shares", "d", F.create_map().cast(empty_s).alias("splits"),
                                     F.create_map().cast(empty_p).alias("leaves")), "forest-0")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), F.col(row_id)), F.lit(1 << 24)) / float(1 << 24)
    weight = sum(((draw >= p).cast("int") for p in POISSON), F.lit(0)) if bootstrap else F.lit(1)
    train = binned.filter("role = 'train'")
    for level in range(depth + 1):
        joined = join_units(train, model.select("unit", "shares", "d", "splits"))
        at = joined.select("unit", row_id, "label", "bins", "d", F.posexplode(_route(trees, level)).alias("tree", "node")).filter(
            F.col("node") >= (1 << level) - 1)  # others ended above
        at = at.withColumn("w", weight).filter("w > 0")
        totals = at.groupBy("unit", "tree", "node").agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("label")).alias("all_pos"))
        if level < depth:
            every = F.sequence(F.lit(0), F.col("d") - 1)
            some = every if features is None else F.array_distinct(F.transform(
                F.sequence(F.lit(1), F.lit(features)),
                lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit("f"), F.col("tree"), F.col("node"), k), F.col("d")).cast("int")))
            cells = at.select("unit", "tree", "node", "w", "label", "bins", F.explode(some).alias("f"))
            counts = materialize(cells.groupBy("unit", "tree", "node", "f", F.try_element_at("bins", F.col("f") + 1).alias("bin")).agg(
                F.sum("w").alias("m"), F.sum(F.col("w") * F.col("label")).alias("pos")), "forest-counts")
            feature = Window.partitionBy("unit", "tree", "node", "f")  # at most a row per bin
            so_far = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            c = counts.select("*", F.sum("m").over(so_far).alias("l"), F.sum("pos").over(so_far).alias("lp"),
                              F.sum("m").over(feature).alias("t"), F.sum("pos").over(feature).alias("tp")).filter("l < t")

            def purity(n: Column, pos: Column) -> Column:
                return (pos * pos + (n - pos) * (n - pos)) / n

            gain = (purity(F.col("l"), F.col("lp")) + purity(F.col("t") - F.col("l"), F.col("tp") - F.col("lp"))
                    - purity(F.col("t"), F.col("tp")))
            best = (c.withColumn("gain", gain).filter("gain > 1e-9").groupBy("unit", "tree", "node").agg(
                F.max_by(F.struct("f", "bin"), F.struct(F.round("gain", 9), -F.col("f"), -F.col("bin"))).alias("split")))
            totals = totals.join(best, ["unit", "tree", "node"], "left")
        else:
            totals = totals.withColumn("split", F.lit(None).cast("struct<f:int,bin:int>"))
        key = (F.col("tree") * NODES + F.col("node")).cast("int")
        added = totals.select("unit", key.alias("key"), (F.col("all_pos") / F.col("all")).alias("share"), "split").groupBy("unit").agg(
            F.map_from_entries(F.collect_list(F.struct("key", "share"))).alias("more_leaves"),  # of one level of the unit's trees
            F.map_from_entries(F.collect_list(F.when(F.col("split").isNotNull(), F.struct("key", "split")))).alias("more_splits"))
        grown = model.join(added, "unit", "left").select(
            "unit", "shares", "d", F.map_concat("splits", F.coalesce(F.col("more_splits"), F.create_map().cast(empty_s))).alias("splits"),
            F.map_concat("leaves", F.coalesce(F.col("more_leaves"), F.create_map().cast(empty_p))).alias("leaves"))
        model, old = materialize(grown, f"forest-{level + 1}"), model
        forget(old)
    return model.drop("d")


def predict_forests(binned: DataFrame, models: DataFrame, configs: Sequence[dict], row_id: str) -> DataFrame:
    """(unit, row_id, probabilities) of the test rows: the mean share of the nodes they reach, per configuration.

    A node that no drawn training row reached counts as the last one above it that had some.
    """
    def known(tree: Column, node: Column) -> Column:
        share = lambda x: F.try_element_at("leaves", tree * NODES + x)
        above = lambda x: F.floor((x - 1) / 2).cast("int")
        return F.coalesce(share(node), share(above(node)), share(above(above(node))), share(F.lit(0)), F.lit(0.5))

    def mean(config: dict) -> Column:
        trees, depth = int(config.get("trees", 10)), int(config.get("depth", 4))
        return V.total(F.transform(_route(trees, depth), lambda node, tree: known(tree, node))) / float(trees)

    joined = join_units(binned.filter("role = 'test'"), models)
    return joined.select("unit", row_id, F.array(*[mean(c) for c in configs]).alias("probabilities"))


def fit_many(rows: DataFrame, assignments: DataFrame, keys: Sequence[str], dataset: Sequence[str], algo: str,
             configs: Sequence[dict], row_id: str = "id", placed: DataFrame | None = None) -> DataFrame:
    """Predictions (keys, config, row_id, label, probability, prediction) of the test rows of every unit.

    ``rows`` holds (dataset, row_id, features, label), ``assignments`` (keys, row_id, role), ``keys`` telling units apart
    and containing ``dataset``.  ``algo`` is ``LINEAR`` (``reg``, ``iterations``) or ``FOREST`` (``trees``, ``depth``);
    ``config`` counts the configurations.  Units that train on one class have no rows.  ``placed``, where algorithms share
    it, is the stored result of :func:`place_units` on the same arguments.
    """
    if placed is None:
        placed = materialize(place_units(rows, assignments, keys, dataset, row_id), "units")
    if algo == "LINEAR":
        found = predict_linear(placed, linear_models(placed, configs, row_id), configs, row_id)
    elif algo == "FOREST":
        binned = _binned(placed, row_id, BINS)
        d = placed.agg(F.max(F.size("features"))).first()[0] or 1
        model = forests(binned, row_id, max(int(c.get("trees", 10)) for c in configs), max(int(c.get("depth", 4)) for c in configs),
                        max(1, round(d ** 0.5)))
        found = predict_forests(binned, model, configs, row_id)
    else:
        raise ValueError(f"no algorithm {algo}")
    named = placed.filter("role = 'test'").select("unit", *keys, row_id, "label")
    each = found.select("unit", row_id, F.posexplode("probabilities").alias("config", "probability"))
    return named.join(each, ["unit", row_id]).select(
        *keys, "config", row_id, "label", "probability", (F.col("probability") > 0.5).cast("double").alias("prediction"))


def score_many(predictions: DataFrame, group: Sequence[str], row_id: str) -> DataFrame:
    """The benchmark metrics per group of labelled predictions."""
    out = M.evaluate(predictions, group, score="probability", label="label", row_id=row_id, predicted="prediction",
                     alpha=M.ALPHA_TWO_PERCENT)
    return out.withColumnRenamed("pr_auc", "auprc").select(*group, *METRICS)


def grid_search_many(rows: DataFrame, inner: DataFrame, keys: Sequence[str], dataset: Sequence[str], algo: str,
                     configs: Sequence[dict], metric: str = "auroc", row_id: str = "id", placed: DataFrame | None = None) -> DataFrame:
    """(keys, outer_fold, config, score): the best configuration of every outer fold of every dataset, in one pass.

    A configuration scores its mean over inner folds that have a value; where none of an outer fold has one, accuracy
    decides; without that it scores 0.  Ties go to the first configuration.
    """
    outer = [*keys, "outer_fold"]
    predictions = materialize(fit_many(rows, inner, [*outer, "fold"], dataset, algo, configs, row_id, placed), "grid-predictions")
    scored = score_many(predictions, [*outer, "fold", "config"], row_id)
    means = nan_mean(scored, [*outer, "config"], list(dict.fromkeys([metric, "accuracy"])))
    every = inner.select(*outer).distinct().withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1))))
    whole = Window.partitionBy(*outer)  # a row per configuration
    rated = every.join(means, [*outer, "config"], "left").withColumn(
        "score", F.coalesce(F.when(F.max(metric).over(whole).isNotNull(), F.col(metric)).otherwise(F.col("accuracy")), F.lit(0.0)))
    return rated.groupBy(*outer).agg(F.max_by(F.struct("config", "score"), F.struct(F.col("score"), -F.col("config"))).alias("_b")).select(
        *outer, "_b.config", "_b.score")


def _prepared(rows: DataFrame, outer: DataFrame, keys: list[str], dataset: Sequence[str], inner_folds: int, row_id: str) -> dict[str, DataFrame]:
    """What the pipelines need of the folds, whatever the algorithm: ``inner``, ``best``, and the units of the inner and the outer fits."""
    labels = join_dimension(outer.select(*keys, row_id).distinct(), rows.select(*dataset, row_id, "label"), [*dataset, row_id], keys)
    splits = nested_splits(outer, materialize(labels, "outer-labels"), keys, row_id, "label", inner_folds)
    inner = materialize(splits["inner"], "inner-folds")
    best = materialize(splits["best"].select(*keys, F.col("best_fold").alias("outer_fold")), "best-folds")
    folds = inner.select(*keys, F.col("outer_fold").alias("fold")).distinct()
    usable = join_dimension(outer, folds, [*keys, "fold"], [row_id])
    return {"inner": inner, "best": best,
            "inner_units": materialize(place_units(rows, inner, [*keys, "outer_fold", "fold"], dataset, row_id), "units"),
            "outer_units": materialize(place_units(rows, usable, [*keys, "fold"], dataset, row_id), "units")}


def run_pipelines_many(rows: DataFrame, outer: DataFrame, keys: Sequence[str], dataset: Sequence[str], algo: str,
                       configs: Sequence[dict], pipelines: Sequence[str], inner_folds: int = 5, metric: str = "auroc",
                       row_id: str = "id", prepared: dict[str, DataFrame] | None = None) -> DataFrame:
    """(keys, pipeline, metrics): the four cross-validation pipelines over all datasets at once.

    ``outer`` holds (keys, row_id, fold, role).  Two fits do for all: one over the inner folds, one over the outer ones.
    """
    keys = list(keys)
    given = prepared or _prepared(rows, outer, keys, dataset, inner_folds, row_id)
    inner, best = given["inner"], given["best"]
    chosen = materialize(grid_search_many(rows, inner, keys, dataset, algo, configs, metric, row_id, given["inner_units"]), "chosen")
    at_best = chosen.join(best, [*keys, "outer_fold"]).select(*keys, "outer_fold", "config")
    folds = chosen.select(*keys, "outer_fold")
    consensus = most_frequent(chosen, keys, "config", "outer_fold")
    plan = {"HoldoutCV": at_best, "SingleNestedCV": folds.join(at_best.drop("outer_fold"), keys),
            "NestedCV": chosen.select(*keys, "outer_fold", "config"), "ConsensusNestedCV": folds.join(consensus, keys)}
    wanted = reduce(lambda a, b: a.unionByName(b), [plan[p].withColumn("pipeline", F.lit(p)) for p in pipelines])
    wanted = materialize(wanted.withColumnRenamed("outer_fold", "fold"), "pipeline-plan")
    predictions = materialize(fit_many(rows, outer, [*keys, "fold"], dataset, algo, configs, row_id, given["outer_units"]), "outer-predictions")
    scored = materialize(score_many(predictions, [*keys, "fold", "config"], row_id), "outer-scores")
    return nan_mean(wanted.join(scored, [*keys, "fold", "config"]), [*keys, "pipeline"], METRICS)


def benchmark_many(rows: DataFrame, outer: DataFrame, keys: Sequence[str], dataset: Sequence[str], grids: dict[str, Sequence[dict]],
                   pipelines: Sequence[str], inner_folds: int = 5, row_id: str = "id") -> DataFrame:
    """Every algorithm under every pipeline for every dataset, scheme and sibling mode named in ``keys``: one row each."""
    prepared = _prepared(rows, outer, list(keys), dataset, inner_folds, row_id)
    return reduce(lambda a, b: a.unionByName(b), [
        run_pipelines_many(rows, outer, keys, dataset, algo, configs, pipelines, inner_folds, row_id=row_id, prepared=prepared)
        .withColumn("algo", F.lit(algo)) for algo, configs in grids.items()])
