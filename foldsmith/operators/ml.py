"""Classifiers over the assignment tables: fitting, grid search and the four cross-validation pipelines.

A fit is a Spark job of its own; fits of one stage are submitted together from a few threads and their predictions
are evaluated as one table.  Only configurations and their mean scores come to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialize
from . import metrics as M
from .neighbors import knn_shares, knn_votes
from .report import most_frequent, nan_mean
from .splits import aligned_split, nested_splits, stratified_kfold

METRICS = ["auroc", "auprc", "balanced", "kappa", "bedroc", "f1", "mcc", "accuracy"]
PARALLEL_FITS = 4
# rows are (row_id, features array<double>, label)
Fit = Callable[[DataFrame, DataFrame, dict, str], DataFrame]


def _with_vector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_v", array_to_vector("features")).withColumn("_y", F.col("label").cast("double"))


def _probability(scored: DataFrame, row_id: str) -> DataFrame:
    return scored.select(row_id, vector_to_array("probability")[1].alias("probability"), "prediction")


def _forest(train: DataFrame, test: DataFrame, params: dict, row_id: str) -> DataFrame:
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", seed=42, **params).fit(_with_vector(train))
    return _probability(model.transform(_with_vector(test)), row_id)


def _boosted(train: DataFrame, test: DataFrame, params: dict, row_id: str) -> DataFrame:
    model = GBTClassifier(featuresCol="_v", labelCol="_y", seed=42, **params).fit(_with_vector(train))
    return _probability(model.transform(_with_vector(test)), row_id)


def _linear_svm(train: DataFrame, test: DataFrame, params: dict, row_id: str) -> DataFrame:
    """Linear margin; Spark has no kernel machine.  The margin is squashed to serve as a probability."""
    scored = LinearSVC(featuresCol="_v", labelCol="_y", **params).fit(_with_vector(train)).transform(_with_vector(test))
    return scored.select(row_id, V.sigmoid(vector_to_array("rawPrediction")[1]).alias("probability"), "prediction")


class Search:
    """The nearest training rows of one fold's test rows, looked for once by whichever fit comes first, for the largest ``k``."""

    def __init__(self, configs: Iterable[dict]):
        self.k, self.lock, self.votes = max(_k(c) for c in configs), Lock(), None

    def __call__(self, train: DataFrame, test: DataFrame, row_id: str) -> DataFrame:
        with self.lock:
            if self.votes is None:
                self.votes = materialize(knn_votes(train, test, self.k, row_id, "label", "features"), "neighbor-labels")
            return self.votes


def _k(params: dict) -> int:
    return params.get("k", 5)


def _neighbors(train: DataFrame, test: DataFrame, params: dict, row_id: str) -> DataFrame:
    votes = params.get("search", Search([params]))(train, test, row_id)
    return knn_shares(votes, _k(params), row_id, "label")


def _searching(algo: str, config: dict, search: Search | None) -> dict:
    """``config``, with the search that the fold's fits have in common."""
    return config if algo != "KNN" or search is None else {**config, "search": search}


ALGORITHMS: dict[str, Fit] = {"RF": _forest, "GB": _boosted, "SVM": _linear_svm, "KNN": _neighbors}


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """All combinations of a grid, single values taken as lists of one."""
    lists = {k: v if isinstance(v, list) else [v] for k, v in grid.items()}
    return [dict(zip(lists, values)) for values in product(*lists.values())]


def train_predict(features: DataFrame, assignments: DataFrame, algo: str, params: dict, row_id: str = "id") -> DataFrame | None:
    """Fit on the ``train`` rows of one fold and score its ``test`` rows; ``None`` where training has one class."""
    def side(role: str) -> DataFrame:
        return features.join(assignments.filter(F.col("role") == role).select(row_id), row_id, "left_semi")

    train = side("train")
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    return ALGORITHMS[algo](train, side("test"), params, row_id)


def fit_all(features: DataFrame, jobs: Iterable[tuple[dict, DataFrame, str, dict]], row_id: str) -> DataFrame | None:
    """Predictions of many fits as one table.  A job is (tags, assignments of one fold, algorithm, parameters)."""
    def run(job) -> DataFrame | None:
        tags, assignments, algo, params = job
        scored = train_predict(features, assignments, algo, params, row_id)
        if scored is None:
            return None
        return materialize(scored.select(*[F.lit(v).alias(k) for k, v in tags.items()], row_id, "probability", "prediction"), "predictions")

    with ThreadPool(PARALLEL_FITS) as pool:
        parts = [p for p in pool.map(run, list(jobs)) if p is not None]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def score(predictions: DataFrame, features: DataFrame, group: Sequence[str], row_id: str) -> DataFrame:
    """The eight benchmark metrics per group of predictions."""
    labelled = materialize(predictions.join(features.select(row_id, "label"), row_id), "labelled-predictions")
    out = M.evaluate(labelled, group, score="probability", label="label", row_id=row_id, predicted="prediction",
                     alpha=M.ALPHA_TWO_PERCENT)
    return out.withColumnRenamed("pr_auc", "auprc").select(*group, *METRICS)


def grid_search(features: DataFrame, inner: DataFrame, algo: str, grid: dict[str, list], metric: str = "auroc",
                row_id: str = "id") -> list[tuple[int, dict, float]]:
    """Best configuration for every outer fold of ``inner`` (outer_fold, row_id, fold, role): (outer, config, score).

    A configuration scores its mean over inner folds, skipping folds without a value; where no configuration has
    one, accuracy decides.  A configuration that still has none scores 0.  Ties go to the first in the grid.
    """
    configs = expand_grid(grid)
    cells = sorted((r["outer_fold"], r["fold"]) for r in inner.select("outer_fold", "fold").distinct().collect())
    shared = {cell: Search(configs) for cell in cells} if algo == "KNN" else {}
    jobs = [({"outer_fold": o, "config": i, "fold": f}, inner.filter((F.col("outer_fold") == o) & (F.col("fold") == f)), algo,
             _searching(algo, c, shared.get((o, f)))) for i, c in enumerate(configs) for o, f in cells]
    predictions = fit_all(features, jobs, row_id)
    means = {}
    if predictions is not None:
        scored = score(predictions, features, ["outer_fold", "config", "fold"], row_id)
        for r in nan_mean(scored, ["outer_fold", "config"], list(dict.fromkeys([metric, "accuracy"]))).collect():
            means[r["outer_fold"], r["config"]] = r
    best = []
    for outer in sorted({o for o, _ in cells}):
        rows = [means.get((outer, i)) for i in range(len(configs))]
        use = metric if any(r is not None and r[metric] is not None for r in rows) else "accuracy"
        values = [0.0 if r is None or r[use] is None else r[use] for r in rows]
        top = max(range(len(configs)), key=lambda i: (values[i], -i))
        best.append((outer, configs[top], values[top]))
    return best


def _key(config: dict) -> str:
    return json.dumps(config, sort_keys=True)


def _on_folds(features: DataFrame, outer: DataFrame, algo: str, chosen: dict[int, dict], row_id: str, done: dict | None) -> DataFrame:
    """Metrics of the chosen configuration of every fold; what ``done`` holds from another pipeline is not fitted again."""
    known = {} if done is None else done.setdefault("scored", {})
    new = {f: c for f, c in chosen.items() if (f, _key(c)) not in known}
    searches: dict[int, Search] = {} if done is None else done.setdefault("searches", {})
    for f in new if algo == "KNN" and done and "configs" in done else ():
        searches.setdefault(f, Search(done["configs"]))
    jobs = [({"fold": f}, outer.filter(F.col("fold") == f), algo, _searching(algo, c, searches.get(f))) for f, c in new.items()]
    predictions = fit_all(features, jobs, row_id) if new else None
    scored = None if predictions is None else materialize(score(predictions, features, ["fold"], row_id), "fold-scores")
    known.update({(f, _key(c)): None if scored is None else scored.filter(F.col("fold") == f) for f, c in new.items()})
    parts = [p for p in (known[f, _key(c)] for f, c in chosen.items()) if p is not None]
    if not parts:
        raise ValueError("no outer fold has both classes to train on")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _tuned(features: DataFrame, inner: DataFrame, folds: Sequence[int], algo: str, grid: dict[str, list], metric: str, row_id: str,
           done: dict | None) -> list[tuple[int, dict, float]]:
    """:func:`grid_search` for the given outer folds, those left out that ``done`` holds from another pipeline."""
    known = {} if done is None else done.setdefault("tuned", {})
    missing = [f for f in folds if f not in known]
    if missing:
        found = grid_search(features, inner.filter(F.col("outer_fold").isin(missing)), algo, grid, metric, row_id)
        known.update({o: (o, config, value) for o, config, value in found})
    return [known[f] for f in sorted(folds)]


def _mean(scored: DataFrame) -> DataFrame:
    return nan_mean(scored, [], METRICS)


def _best_outer(splits: dict[str, DataFrame]) -> int:
    best = splits["best"].first()
    if best is None or best["best_fold"] is None:
        raise ValueError("no outer fold has both classes on both sides")
    return best["best_fold"]


def _usable(splits: dict[str, DataFrame]) -> list[int]:
    return sorted(r["outer_fold"] for r in splits["inner"].select("outer_fold").distinct().collect())


def holdout_cv(features, outer, splits, algo, grid, metric="auroc", row_id="id", done=None) -> DataFrame:
    """Tune within the best outer fold and test there."""
    fold = _best_outer(splits)
    (_, config, _), = _tuned(features, splits["inner"], [fold], algo, grid, metric, row_id, done)
    return _mean(_on_folds(features, outer, algo, {fold: config}, row_id, done))


def single_nested_cv(features, outer, splits, algo, grid, metric="auroc", row_id="id", done=None) -> DataFrame:
    """Tune within the best outer fold, test on all."""
    fold = _best_outer(splits)
    (_, config, _), = _tuned(features, splits["inner"], [fold], algo, grid, metric, row_id, done)
    return _mean(_on_folds(features, outer, algo, dict.fromkeys(_usable(splits), config), row_id, done))


def nested_cv(features, outer, splits, algo, grid, metric="auroc", row_id="id", done=None) -> DataFrame:
    """Tune and test within every outer fold on its own."""
    chosen = {o: c for o, c, _ in _tuned(features, splits["inner"], _usable(splits), algo, grid, metric, row_id, done)}
    return _mean(_on_folds(features, outer, algo, chosen, row_id, done))


def consensus_nested_cv(features, outer, splits, algo, grid, metric="auroc", row_id="id", done=None) -> DataFrame:
    """Tune within every outer fold, then test on all with the configuration chosen most often."""
    found = _tuned(features, splits["inner"], _usable(splits), algo, grid, metric, row_id, done)
    rows = features.sparkSession.createDataFrame([(_key(c), o) for o, c, _ in found], "config string, fold int")
    consensus = json.loads(most_frequent(rows, [], "config", "fold").first()["config"])
    return _mean(_on_folds(features, outer, algo, dict.fromkeys([o for o, _, _ in found], consensus), row_id, done))


PIPELINES = {"HoldoutCV": holdout_cv, "SingleNestedCV": single_nested_cv, "NestedCV": nested_cv,
             "ConsensusNestedCV": consensus_nested_cv}


def run_pipelines(features: DataFrame, outer: DataFrame, algo: str, grid: dict[str, list], pipelines: Sequence[str],
                  inner_folds: int = 5, row_id: str = "id") -> DataFrame:
    """One row of mean metrics per pipeline; the splits, and fits that several pipelines need, are made once and shared."""
    rows = materialize(features.select(row_id, "features", "label"), "features")
    outer = materialize(outer.select(row_id, "fold", "role"), "outer-folds")
    splits = {k: materialize(v, f"nested-{k}") for k, v in nested_splits(outer, rows, [], row_id, "label", inner_folds).items()}
    done: dict = {"configs": expand_grid(grid)}
    parts = [PIPELINES[p](rows, outer, splits, algo, grid, row_id=row_id, done=done).withColumn("pipeline", F.lit(p)) for p in pipelines]
    return reduce(lambda a, b: a.unionByName(b), parts)


def benchmark_internal(features: DataFrame, schemes: dict[str, DataFrame], grids: dict[str, dict], pipelines: Sequence[str],
                       inner_folds: int = 5, row_id: str = "id") -> DataFrame:
    """Every algorithm under every split scheme and pipeline: one row each, ready to be appended to a result store."""
    parts = [run_pipelines(features, outer, algo, grid, pipelines, inner_folds, row_id)
             .withColumns({"algo": F.lit(algo), "scheme": F.lit(scheme)})
             for scheme, outer in schemes.items() for algo, grid in grids.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def benchmark_aligned(parent: DataFrame, child: DataFrame, grids: dict[str, dict], pipelines: Sequence[str], folds: int = 5,
                      inner_folds: int = 5, row_id: str = "id") -> DataFrame:
    """Parent and child trained apart and tested on the same rows; metrics of the two side by side.

    The child's folds are carried over to the parent, so both test sets agree fold by fold.
    """
    marked = stratified_kfold(child, [], row_id, "label", folds).select(
        F.lit("pair").alias("pair"), F.lit(False).alias("drop_siblings"), "fold", row_id, "role")
    rows = parent.select(F.lit("pair").alias("pair"), row_id, F.lit(False).alias("has_sibling"))
    sides = aligned_split(rows, materialize(marked, "child-folds"), ["pair"], row_id)
    parts = []
    for algo, grid in grids.items():
        both = {}
        for side, features in (("parent", parent), ("child", child)):
            outer = sides[side].filter(F.col("role").isNotNull())
            scored = run_pipelines(features, outer, algo, grid, pipelines, inner_folds, row_id)
            both[side] = scored.withColumnsRenamed({m: f"{side}_{m}" for m in METRICS})
        parts.append(both["parent"].join(both["child"], "pipeline").withColumn("algo", F.lit(algo)))
    sizes = {"parent_size": parent.agg(F.count("*")).scalar(), "child_size": child.agg(F.count("*")).scalar()}
    return reduce(lambda a, b: a.unionByName(b), parts).withColumns(sizes)
