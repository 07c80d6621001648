"""Evaluation metrics per group.  A group with one class only gets NULL, never an error."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialize
from .joins import join_group_stats
from .rank import distributed_rank, group_cumsum, group_quantiles, seeded_order

# fixed values: early-recognition weights in use
ALPHA_BROAD, ALPHA_TWO_PERCENT, ALPHA_HALF_PERCENT = 20.0, 80.5, 321.9


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ranking_metrics(scored: DataFrame, group: Sequence[str], score: str, label: str, row_id: str,
                    alpha: float = ALPHA_BROAD) -> DataFrame:
    """AUROC, AP, negative AP, their lifts over the base rate, PR-AUC, BEDROC and the Youden threshold per group.

    Rows are counted per (group, score) first; everything else works on those counts and running sums over them,
    so neither a huge group nor a huge tie is ever sorted in one task.  Ties count half in AUROC; BEDROC needs an
    order and takes the seeded order of ``row_id`` within a tie.
    """
    group = list(group)
    rows = scored.select(*group, F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y"),
                         F.col(row_id).alias("_id")).filter("_s IS NOT NULL AND _y IS NOT NULL")
    counts = materialize(rows.groupBy(*group, "_s").agg(
        F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")), "score-counts")
    placed = materialize(group_cumsum(counts, group, "_s", ["pos", "neg"], descending=True), "score-sums")

    pos, neg, above_pos, above_neg, all_pos, all_neg = (
        F.col(c).cast("double") for c in ("pos", "neg", "before_pos", "before_neg", "total_pos", "total_neg"))
    above, size = above_pos + above_neg, all_pos + all_neg
    precision = (above_pos + pos) / (above + pos + neg)
    precision_before = F.coalesce(F.try_divide(above_pos, above), F.lit(1.0))
    precision_below = (all_neg - above_neg) / (size - above)
    # a run of positives at ranks above+1 .. above+pos weighs as a geometric series
    decay = F.exp(-F.lit(alpha) / size)
    pure = F.when(neg == 0, F.pow(decay, above + 1) * (1 - F.pow(decay, pos)) / (1 - decay)).otherwise(0.0)
    youden = (above_pos + pos) * all_neg - (above_neg + neg) * all_pos
    sums = placed.groupBy(*group).agg(
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"),
        F.sum(pos * (above_neg + neg / 2)).alias("_lost"), F.sum(pos * precision).alias("_ap"),
        F.sum(neg * precision_below).alias("_nap"), F.sum(pos * (precision + precision_before) / 2).alias("_pr"),
        F.sum(pure).alias("_pure"), F.max(youden).alias("_j"),
        F.max_by("_s", F.struct(youden, F.col("_s"))).alias("_at"))

    mixed = placed.filter("pos > 0 AND neg > 0").select(
        *group, "_s", above.alias("_above"), size.alias("_size"), (F.col("pos") + F.col("neg")).alias("n"))
    tied = join_group_stats(rows, mixed, [*group, "_s"], ["_id"])
    ordered = distributed_rank(tied, [*group, "_s"], seeded_order(0, "_id"), [F.col("_id")], out="_tie")
    weight = F.exp(-F.lit(alpha) * (F.col("_above") + F.col("_tie") + 1) / F.col("_size"))
    in_ties = ordered.filter("_y = 1").groupBy(*group).agg(F.sum(weight).alias("_mixed"))

    out = sums.join(in_ties, group, "left")
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    share = p / (p + n)
    a = F.lit(float(alpha))
    rie = ((F.col("_pure") + F.coalesce("_mixed", F.lit(0.0))) / p
           / ((1 - math.exp(-alpha)) / ((p + n) * (F.exp(a / (p + n)) - 1))))
    # sinh(a/2) / (cosh(a/2) - cosh(a/2 - a*share)) with e^(a/2) divided out, so a large alpha cannot overflow
    spread = (1 - F.exp(-a)) / (1 + F.exp(-a) - F.exp(-a * share) - F.exp(-a * (1 - share)))
    bedroc = rie * share * spread + 1 / (1 - F.exp(a * (1 - share)))
    two_classes = (p > 0) & (n > 0)
    metrics = {
        "auroc": 1 - F.col("_lost") / (p * n), "ap": F.col("_ap") / p, "neg_ap": F.col("_nap") / n,
        "delta_ap": F.col("_ap") / p - share, "delta_neg_ap": F.col("_nap") / n - (1 - share),
        "pr_auc": F.col("_pr") / p, "bedroc": bedroc,
        "youden_threshold": F.when(F.col("_j") > 0, F.col("_at")).otherwise(F.lit(math.inf)),
    }
    return out.select(*group, "n_pos", "n_neg", *[F.when(two_classes, v).alias(k) for k, v in metrics.items()])


def count_single_class(metrics: DataFrame) -> DataFrame:
    """How many groups could be scored and how many have one class only."""
    return metrics.agg(F.count("auroc").alias("scored"), F.count_if(F.col("auroc").isNull()).alias("single_class"))


def confusion_counts(rows: DataFrame, group: Sequence[str], truth: str, predicted: str) -> DataFrame:
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.groupBy(*group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                                    F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


TP, FP, TN, FN = "tp", "fp", "tn", "fn"


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _accuracy() -> Column:
    return _ratio(_c(TP) + _c(TN), _c(TP) + _c(FP) + _c(TN) + _c(FN))


def _precision() -> Column:
    return F.coalesce(_ratio(_c(TP), _c(TP) + _c(FP)), F.lit(0.0))


def _recall() -> Column:
    return F.coalesce(_ratio(_c(TP), _c(TP) + _c(FN)), F.lit(0.0))


def _f1() -> Column:
    return F.coalesce(_ratio(2 * _c(TP), 2 * _c(TP) + _c(FP) + _c(FN)), F.lit(0.0))


def _mcc() -> Column:
    over = F.sqrt(_c(TP) + _c(FP)) * F.sqrt(_c(TP) + _c(FN)) * F.sqrt(_c(TN) + _c(FP)) * F.sqrt(_c(TN) + _c(FN))
    return F.coalesce(_ratio(_c(TP) * _c(TN) - _c(FP) * _c(FN), over), F.lit(0.0))


def _balanced() -> Column:
    hit, spared = _ratio(_c(TP), _c(TP) + _c(FN)), _ratio(_c(TN), _c(TN) + _c(FP))
    return F.coalesce((hit + spared) / 2, hit, spared)


def _kappa() -> Column:
    n = _c(TP) + _c(FP) + _c(TN) + _c(FN)
    chance = ((_c(TP) + _c(FP)) * (_c(TP) + _c(FN)) + (_c(TN) + _c(FN)) * (_c(TN) + _c(FP))) / (n * n)
    return _ratio(_accuracy() - chance, 1 - chance)


# metric name -> column over the confusion counts
CONFUSION_METRICS: dict[str, Callable[[], Column]] = {
    "accuracy": _accuracy, "precision": _precision, "recall": _recall, "f1": _f1, "mcc": _mcc,
    "balanced": _balanced, "kappa": _kappa,
}


def confusion_metrics(rows: DataFrame, group: Sequence[str], truth: str, predicted: str,
                      names: Sequence[str] = tuple(CONFUSION_METRICS)) -> DataFrame:
    counts = confusion_counts(rows, group, truth, predicted)
    return counts.select("*", *[CONFUSION_METRICS[n]().alias(n) for n in names])


def regression_metrics(rows: DataFrame, group: Sequence[str], truth: str, predicted: str,
                       flag: str | None = None) -> DataFrame:
    """RMSE and R² per group, and on the flagged rows alone where a flag column is named."""
    def block(test: Column, tag: str) -> list[Column]:
        y = F.when(test, F.col(truth).cast("double"))
        err = y - F.col(predicted)
        total = F.var_pop(y) * F.count(y)
        return [F.sqrt(F.avg(err * err)).alias(f"rmse{tag}"), (1 - F.try_divide(F.sum(err * err), total)).alias(f"r2{tag}")]

    columns = block(F.lit(True), "") + (block(F.col(flag), "_flagged") if flag else [])
    return rows.groupBy(*group).agg(F.count("*").alias("n"), *columns)


def mean_log_loss(rows: DataFrame, group: Sequence[str], logit: str, label: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.avg(V.log_loss_with_logits(F.col(logit), F.col(label))).alias("log_loss"))


def rank_accuracy(ranks: DataFrame, group: Sequence[str], rank: str, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Top-k accuracy, mean and median rank over 1-based ranks of the correct choice."""
    means = ranks.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(rank).alias("mean_rank"),
        *[F.avg((F.col(rank) <= k).cast("double")).alias(f"top{k}") for k in ks])
    return means.join(group_quantiles(ranks, group, rank, {"median_rank": 0.5}), list(group))


def overlap_of_tests(parent: DataFrame, child: DataFrame, pair: Sequence[str], row_id: str) -> DataFrame:
    """Test-set overlap per pair: sizes, intersection, both shares and what is unique to each side.

    Both inputs hold (pair, row_id) of test rows.  Tagged and united, they are counted by two partial aggregates;
    no join is needed and an empty side simply counts zero.
    """
    both = (parent.select(*pair, row_id, F.lit(1).alias("_p"), F.lit(0).alias("_c"))
            .unionByName(child.select(*pair, row_id, F.lit(0).alias("_p"), F.lit(1).alias("_c"))))
    ids = both.groupBy(*pair, row_id).agg(F.max("_p").alias("_p"), F.max("_c").alias("_c"))
    out = ids.groupBy(*pair).agg(F.sum("_p").alias("parent_count"), F.sum("_c").alias("child_count"),
                                 F.sum(F.col("_p") * F.col("_c")).alias("intersection_count"))
    shared = F.col("intersection_count")
    return out.withColumns({
        "coverage": F.coalesce(_ratio(shared, F.col("child_count")), F.lit(0.0)),
        "inclusion": F.coalesce(_ratio(shared, F.col("parent_count")), F.lit(0.0)),
        "unique_to_parent": F.col("parent_count") - shared, "unique_to_child": F.col("child_count") - shared})


def evaluate(rows: DataFrame, group: Sequence[str], score: str, label: str, row_id: str, predicted: str | None = None,
             logit: str | None = None, alpha: float = ALPHA_BROAD) -> DataFrame:
    """Ranking metrics per group, with confusion metrics and log loss where a prediction or a logit is named."""
    out = ranking_metrics(rows, group, score, label, row_id, alpha)
    if predicted:
        out = out.join(confusion_metrics(rows, group, label, predicted), list(group))
    if logit:
        out = out.join(mean_log_loss(rows, group, logit, label), list(group))
    return out
