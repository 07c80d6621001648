import math
from collections import Counter

import numpy as np
import pytest

from foldsmith.operators import neighbors as N
from foldsmith.operators import textfeat as T


def points(n=90, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    base = np.concatenate([rng.normal(c, 0.3, (n // 3, dim)) for c in (0, 3, 9)])
    # a third of the points coincide, so ties are decided by id
    base[:: 3] = base[0]
    return base


def frame(spark, x, labels=None):
    rows = [(i, v.tolist(), int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>, y int")


@pytest.mark.parametrize("k, own", [(1, False), (4, False), (4, True), (200, True)])
def test_neighbors_equal_all_pairs(spark, small_blocks, k, own):
    x = points()
    df = frame(spark, x).select("id", "vec")
    got = {}
    for r in N.knn_join(df, df, k, skip_self=own).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    for i, v in enumerate(x):
        far = np.sqrt(((x - v) ** 2).sum(axis=1))
        order = sorted((j for j in range(len(x)) if not (own and j == i)), key=lambda j: (far[j], j))[:k]
        mine = sorted(got[i])
        assert [m[1] for m in mine] == order
        np.testing.assert_allclose([m[2] for m in mine], far[order], atol=1e-12)


@pytest.mark.parametrize("k, own", [(1, True), (4, False)])
def test_blocks_read_in_tiles_equal_all_pairs(spark, small_blocks, monkeypatch, k, own):
    monkeypatch.setattr(N, "BLOCK_BYTES", 8 * 5 * 20)  # blocks of 20 rows, tiles of 7
    monkeypatch.setattr(N, "ROUTED_ROWS", 3)
    x = points(120, seed=8)
    df = frame(spark, x).select("id", "vec")
    got = {}
    for r in N.knn_join(df, df, k, skip_self=own).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    for i, v in enumerate(x):
        far = np.sqrt(((x - v) ** 2).sum(axis=1))
        order = sorted((j for j in range(len(x)) if not (own and j == i)), key=lambda j: (far[j], j))[:k]
        assert [m[1] for m in sorted(got[i])] == order


def test_a_task_holds_tiles_not_the_product_of_its_blocks():
    import tracemalloc
    import pandas as pd
    x = np.random.default_rng(3).normal(size=(9_000, 4))
    left = pd.DataFrame({"vec": list(x)})
    right = pd.DataFrame({"vec": list(x), "ids": [[i] for i in range(len(x))]})
    tracemalloc.start()
    found = N._closest(left, right, 2, np.full(len(x), np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2 * len(x) and (found["nid"].to_numpy()[::2] == found["at"].to_numpy()[::2]).all()
    assert peak < 9_000 * 9_000 * 8 / 3


def test_tree_visits_little_beyond_the_own_leaf():
    rng = np.random.default_rng(4)
    share = {}
    for n in (2_000, 18_000):
        x = np.concatenate([rng.normal(c, 0.2, (n // 40, 6)) for c in rng.uniform(-20, 20, (40, 6))])
        tree = N._Tree(x[rng.permutation(len(x))[:math.isqrt(len(x))]])
        leaf, far = tree.place(x)
        own = [np.flatnonzero(leaf == c) for c in range(len(tree.leaves))]
        held = [c for c in range(len(own)) if len(own[c])]
        tree.measure(held, [len(own[c]) for c in held], [far[own[c]].min() for c in held], [far[own[c]].max() for c in held])
        asked = x[::50]
        exact = np.sqrt(((asked[:, None] - x[None]) ** 2).sum(axis=2))
        limit = np.sort(exact, axis=1)[:, 4]
        row, cell = tree.open(asked, limit)
        seen = [np.zeros(len(x), dtype=bool) for _ in asked]
        for r, c in zip(row, cell):
            seen[r][own[c]] = True
        assert all(seen[r][exact[r] <= limit[r]].all() for r in range(len(asked)))  # no neighbour is missed
        share[n] = np.mean([m.mean() for m in seen])
    assert share[18_000] < 0.06 and share[18_000] <= share[2_000]


def test_copies_and_vectors_that_are_not_whole(spark, small_blocks):
    rows = [(i, [1.0, 1.0]) for i in range(40)] + [(50, [1.0, 2.0]), (51, [9.0, -0.0]), (52, None), (53, [1.0, None]),
                                                   (54, [float("nan"), 0.0]), (55, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in N.knn_join(df, df, 2, skip_self=True).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["neighbor_id"], r["distance"])
    assert set(got) == {*range(40), 50, 51}
    assert got[0] == {1: (1, 0.0), 2: (2, 0.0)} and got[1] == {1: (0, 0.0), 2: (2, 0.0)} and got[30] == {1: (0, 0.0), 2: (1, 0.0)}
    assert got[50] == {1: (0, 1.0), 2: (1, 1.0)}
    with pytest.raises(ValueError):
        N.knn_join(df, df.filter("id >= 52"), 1)


def test_queries_far_from_the_base(spark, small_blocks):
    base, asked = frame(spark, points()).select("id", "vec"), spark.createDataFrame([(5, [100.0] * 5), (6, [-3.0] * 5)], "id long, vec array<double>")
    out = N.knn_join(asked, base, 2).collect()
    assert Counter(r["query_id"] for r in out) == {5: 2, 6: 2}


def test_dense_scores_and_ranks(spark, small_blocks):
    x = points()
    labels = np.arange(len(x)) % 9
    groups = np.stack([x[labels == g].mean(axis=0) + g for g in range(9)])
    items = frame(spark, x, labels)
    protos = spark.createDataFrame([(g, v.tolist()) for g, v in enumerate(groups)], "gid int, group_vec array<double>")
    unit = (x / np.linalg.norm(x, axis=1)[:, None]) @ (groups / np.linalg.norm(groups, axis=1)[:, None]).T
    scores = {(r["id"], r["gid"]): r["score"] for r in N.dense_scores(items, protos, "id", "gid").collect()}
    assert len(scores) == unit.size and all(abs(scores[i, g] - unit[i, g]) < 1e-9 for i in range(len(x)) for g in range(9))
    ranks = {r["id"]: r["rank"] for r in N.truth_ranks(items, protos, "id", "y", "gid").collect()}
    for i in range(len(x)):
        others = np.delete(unit[i], labels[i])
        assert ranks[i] == 1 + (others >= unit[i, labels[i]] - 1e-9).sum()


def test_smote_evens_the_classes_between_neighbors(spark, small_blocks):
    x = points(60)
    labels = (np.arange(60) % 10 == 1).astype(int)
    df = frame(spark, x, labels)
    made = N.smote(df, "id", "vec", "y", k=3).collect()
    assert len(made) == 60 - 2 * labels.sum() and len({r["copy"] for r in made}) == len(made)
    own = df.filter("y = 1").select("id", "vec")
    links = {(r["query_id"], r["neighbor_id"]) for r in N.knn_join(own, own, 3, skip_self=True).collect()}
    for r in made:
        a, b, v = x[r["parent_id"]], x[r["neighbor_id"]], np.array(r["vec"])
        assert (r["parent_id"], r["neighbor_id"]) in links
        assert math.isclose(np.linalg.norm(v - a) + np.linalg.norm(v - b), np.linalg.norm(a - b), abs_tol=1e-9)
    again = N.smote(df.repartition(3), "id", "vec", "y", k=3).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))


def test_tomek_links(spark, small_blocks):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [0.1], 1), (3, [5.0], 0), (4, [5.1], 0), (5, [9.0], 1)], "id long, vec array<double>, y int")
    links = N.tomek_links(df, "id", "vec", "y")
    assert [(r["a"], r["b"]) for r in links.collect()] == [(1, 2)]
    assert sorted(r["id"] for r in N.without_links(df, links, "id").collect()) == [3, 4, 5]


def test_latent_features_keep_the_leading_products(spark):
    words = ["red blue", "red green", "blue green red", "cat dog", "dog bird cat", "bird cat", "red cat", "blue bird"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, text string")
    weights = T.tfidf_weights(df, "id", "text", [], fit_share=1.0)
    dense = np.zeros((8, 6))
    names = {}
    for r in weights.collect():
        dense[r["id"], names.setdefault(r["term"], len(names))] = r["weight"]
    np.testing.assert_allclose(np.linalg.norm(dense, axis=1), 1)
    found = T.lsa_features(df, "id", "text", [], n_components=4, fit_share=1.0)
    got = np.array([r["features"] for r in found.orderBy("id").collect()])
    _, _, vt = np.linalg.svd(dense, full_matrices=False)
    want = dense @ vt[:4].T
    np.testing.assert_allclose(got @ got.T, want @ want.T, atol=1e-6)


def test_principal_components(spark):
    x = points(60)
    got = np.array([r["components"] for r in T.pca(frame(spark, x), "id", "vec").orderBy("id").collect()])
    values, axes = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(np.abs(got), np.abs(x @ axes[:, ::-1][:, :2]), atol=1e-8)


@pytest.mark.parametrize("unit", [True, False])
def test_best_groups_equal_the_full_matrix(spark, small_blocks, unit):
    rng = np.random.default_rng(8)
    items = rng.normal(size=(40, 4))
    groups = rng.normal(size=(60, 4)) * rng.uniform(0.1, 5, (60, 1))
    groups[10] = groups[50]  # a tie, decided by id
    groups[20] = 0
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "id long, vec array<double>")
    right = spark.createDataFrame([(f"g{j:02}", v.tolist()) for j, v in enumerate(groups)] + [("none", None), ("nan", [float("nan")] * 4)],
                                  "gid string, group_vec array<double>")
    lengths = np.linalg.norm(groups, axis=1, keepdims=True) + 1e-13
    scores = items @ groups.T if not unit else (items / np.linalg.norm(items, axis=1, keepdims=True)) @ (groups / lengths).T
    got = {(r["id"], r["rank"]): (r["gid"], r["score"]) for r in N.best_groups(left, right, 5, "id", "gid", unit=unit).collect()}
    assert len(got) == 40 * 5
    for i in range(40):
        order = sorted(range(60), key=lambda j: (-round(scores[i, j], 12), j))[:5]
        assert [got[i, r + 1][0] for r in range(5)] == [f"g{j:02}" for j in order]
        np.testing.assert_allclose([got[i, r + 1][1] for r in range(5)], scores[i, order], atol=1e-12)


def test_best_groups_of_no_groups_and_fewer_than_asked(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vec array<double>")
    right = spark.createDataFrame([(7, [0.0, 2.0]), (8, [1.0, 1.0])], "gid long, group_vec array<double>")
    assert N.best_groups(left, right.limit(0), 3, "id", "gid").count() == 0
    got = N.best_groups(left, right, 3, "id", "gid", unit=False).orderBy("rank").collect()
    assert [(r["id"], r["gid"], r["score"]) for r in got] == [(1, 8, 1.0), (1, 7, 0.0)]
