import hashlib
import math
import random

import pytest

from foldsmith.operators import metrics as M

ALPHA = 20.0


def brute(rows):
    """Ranking metrics of (id, score, label) rows, straight from their definitions."""
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    if not pos or not neg:
        return None
    auroc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)

    def average_precision(pairs):
        ap = recall = 0.0
        total = sum(y for _, y in pairs)
        for s in sorted({s for s, _ in pairs}, reverse=True):
            seen = [y for t, y in pairs if t >= s]
            now = sum(seen) / total
            ap += (now - recall) * sum(seen) / len(seen)
            recall = now
        return ap

    ap = average_precision([(s, y) for _, s, y in rows])
    nap = average_precision([(-s, 1 - y) for _, s, y in rows])
    points = [(0.0, 1.0)]
    best, at = 0.0, math.inf
    for s in sorted({s for _, s, _ in rows}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(n >= s for n in neg)
        points.append((tp / len(pos), tp / (tp + fp)))
        j = tp / len(pos) - fp / len(neg)
        if j > best + 1e-12:
            best, at = j, s
    pr = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    order = sorted(rows, key=lambda r: (-r[1], hashlib.md5(f"0:{r[0]}".encode()).hexdigest()))
    n, ra = len(rows), len(pos) / len(rows)
    rie = sum(math.exp(-ALPHA * (i + 1) / n) for i, r in enumerate(order) if r[2]) / len(pos)
    rie /= (1 - math.exp(-ALPHA)) / (n * (math.exp(ALPHA / n) - 1))
    bed = rie * ra * math.sinh(ALPHA / 2) / (math.cosh(ALPHA / 2) - math.cosh(ALPHA / 2 - ALPHA * ra)) + 1 / (1 - math.exp(ALPHA * (1 - ra)))
    return dict(auroc=auroc, ap=ap, neg_ap=nap, delta_ap=ap - ra, delta_neg_ap=nap - 1 + ra, pr_auc=pr, bedroc=bed, youden_threshold=at)


def test_ranking_metrics_against_their_definitions(spark, small_blocks):
    rng, groups = random.Random(3), {}
    for g in range(8):
        n = rng.randrange(5, 60)
        groups[f"g{g}"] = [(g * 1000 + i, round(rng.random(), 1 if g % 2 else 6), int(rng.random() < 0.4)) for i in range(n)]
    groups["single class"] = [(9000, 0.2, 1), (9001, 0.4, 1)]
    groups["one row"] = [(9100, 0.2, 0)]
    groups["all tied"] = [(9200 + i, 0.5, i % 2) for i in range(9)]
    groups["perfect"] = [(9300 + i, i / 10, int(i >= 6)) for i in range(10)]
    groups["reversed"] = [(9400 + i, i / 10, int(i < 4)) for i in range(10)]
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g string, id long, s double, y int")
    out = {r["g"]: r for r in M.ranking_metrics(df.repartition(5), ["g"], "s", "y", "id", ALPHA).collect()}
    assert set(out) == set(groups)
    for g, rows in groups.items():
        want = brute(rows)
        for name in ("auroc", "ap", "neg_ap", "delta_ap", "delta_neg_ap", "pr_auc", "bedroc", "youden_threshold"):
            got = out[g][name]
            assert (got is None) if want is None else got == pytest.approx(want[name], abs=1e-9), (g, name)
    assert out["perfect"]["bedroc"] == pytest.approx(1, abs=1e-6) and out["perfect"]["auroc"] == 1
    assert out["reversed"]["youden_threshold"] == math.inf


def test_large_alpha_stays_finite(spark):
    df = spark.createDataFrame([("g", i, i / 50, int(i > 40)) for i in range(50)], "g string, id long, s double, y int")
    out = M.ranking_metrics(df, ["g"], "s", "y", "id", M.ALPHA_HALF_PERCENT).first()
    assert out["bedroc"] == pytest.approx(1, abs=1e-6)


def test_confusion_with_empty_sides(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0), ("b", 1, 0), ("c", 0, 0)], "g string, y int, p int")
    out = {r["g"]: r for r in M.confusion_metrics(df, ["g"], "y", "p").collect()}
    assert out["a"]["mcc"] == 1 and out["a"]["kappa"] == 1
    assert (out["b"]["precision"], out["b"]["f1"], out["b"]["mcc"], out["b"]["balanced"]) == (0, 0, 0, 0)
    assert out["c"]["kappa"] is None and out["c"]["accuracy"] == 1 and out["c"]["balanced"] == 1


def test_single_class_groups_are_counted(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 1), ("b", 2, 0.2, 1), ("b", 3, 0.1, 0)], "g string, id long, s double, y int")
    out = M.count_single_class(M.ranking_metrics(df, ["g"], "s", "y", "id")).first()
    assert (out["scored"], out["single_class"]) == (1, 1)


def test_overlap_with_an_empty_side(spark):
    parent = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "pair string, id long")
    child = spark.createDataFrame([("a", 2), ("c", 5)], "pair string, id long")
    out = {r["pair"]: r for r in M.overlap_of_tests(parent, child, ["pair"], "id").collect()}
    assert (out["a"]["coverage"], out["a"]["inclusion"], out["a"]["unique_to_parent"]) == (1.0, 0.5, 1)
    assert (out["b"]["child_count"], out["b"]["coverage"], out["c"]["inclusion"], out["c"]["unique_to_child"]) == (0, 0.0, 0.0, 1)
