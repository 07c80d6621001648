"""Joins of near copies and their components, against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from foldsmith.llm import nn_descent as D
from foldsmith.llm import ngram_join as N
from foldsmith.llm.components import components


def united(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_stars_chains_and_hubs(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, 2), (2, 3), (None, 4)]
    links += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(120)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == united({x for ab in real for x in ab}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    rows = []
    base = [[word() for _ in range(rnd.randint(1, 120))] for _ in range(25)]
    for k in range(260):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            words[rnd.randrange(len(words))] = word()
        rows.append((1000 - k, " ".join(words).upper() if k % 9 == 0 else "\n".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "One"), (5005, "one two"), (5006, "two one")]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_components_agree_with_all_pairs(spark, size, percent):
    rows = corpus(size)
    docs = spark.createDataFrame([(k, t, 1, "d") for k, t in rows], "doc_id bigint, text string, n int, digest string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(docs, size, percent).collect()}
    sets = {k: shingles(t, size) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    part = united(sets, links)
    assert got == {k: (len(s), part[k]) for k, s in sets.items()}
    kept = N.one_of_each(docs, size, percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, c in part.items() if k == c)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (1, "other words stand here now"), (None, text), (None, "alone one two three"), (2, None),
            (2, None), (3, text + " i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(docs).collect())
    assert got == Counter([(1, 6, 1), (1, 6, 1), (1, 3, 1), (None, 6, 1), (None, 2, None), (2, 0, 2), (2, 0, 2), (3, 7, 3)])
    kept = Counter(tuple(r) for r in N.one_of_each(docs).collect())
    assert kept == Counter([(1, text), (1, rows[2][1]), (None, rows[4][1]), (2, None), (3, text + " i")])
    assert N.jaccard_components(docs.limit(0)).count() == 0 and N.one_of_each(docs.limit(0)).count() == 0


def test_one_large_family_makes_few_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        words = list(base)
        words[rnd.randrange(200)] = f"x{k}"
        words[rnd.randrange(200)] = f"y{k}"
        rows.append((k, " ".join(words)))
    seen = []
    real = N.verify
    monkeypatch.setattr(N, "verify", lambda pairs, *x: seen.append(pairs.count()) or real(pairs, *x))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in N.jaccard_components(docs).collect()} == {0}
    assert sum(seen) < 5 * len(rows)


def brute(rows, threshold):
    links = []
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[i + 1:]:
            if p is not None and p == q and x is not None and y is not None and len(x) == len(y):
                u, v = np.array(x, float), np.array(y, float)
                if np.isfinite(u).all() and np.isfinite(v).all() and u.any() and v.any():
                    if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                        links.append((a, b))
    return links


def test_nn_descent_agrees_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 20)
    monkeypatch.setattr(D, "WINDOW", 64)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16))
    rows = [(1000 + k, (centres[k % 12] * rnd.uniform(0.5, 3) + rnd.normal(size=16) * 0.08).tolist(), int(k % 2)) for k in range(160)]
    rows += [(k, rnd.normal(size=16).tolist(), 0) for k in range(100)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None] * 8, 0),
             (2004, centres[0].tolist(), None), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0),
             (2008, rows[0][1], rows[0][2]), (2009, [1e300] * 16, 1)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<double>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in D.near_components(table).collect()}
    usable = [(a, x if x is None or None not in x else None, p) for a, x, p in rows]
    links = brute([r if r[0] != 2009 else (2009, [1.0] * 16, 1) for r in usable], 0.98)
    degree, part = Counter(x for ab in links for x in ab), united([r[0] for r in rows], links)
    assert got == {k: (degree[k], part[k], part[k] == k) for k in part}
    assert D.near_components(table.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)],
                                  "vec_id bigint, embedding array<double>, label int")
    assert Counter(tuple(r) for r in D.near_components(twice).collect()) == Counter(
        [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)])


def test_two_saturated_clumps_are_one_component(spark):
    rnd = np.random.default_rng(8)
    axes = np.linalg.qr(rnd.normal(size=(64, 2)))[0].T
    angle = np.arccos(0.985)
    ends = [axes[0], axes[0] * np.cos(angle) + axes[1] * np.sin(angle)]
    rows = [(20 * c + k, (ends[c] + rnd.normal(size=64) * 1e-4).tolist(), 0) for c in (0, 1) for k in range(20)]
    links = brute(rows, 0.98)
    assert len(links) == 40 * 39 // 2  # every list of 8 holds only its own clump
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in D.near_components(table).collect()} == {(39, 0)}


def test_a_recall_that_no_order_reaches_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_ORDERS", D.ORDERS)
    table = spark.createDataFrame([(k, [1.0, k / 1000], 0) for k in range(5)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="recall"):
        D.near_components(table, recall=1.1)


def test_isolated_pairs_of_a_hot_label_are_found(spark):
    rnd = np.random.default_rng(9)
    one = rnd.normal(size=(8000, 32))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = rnd.normal(size=one.shape)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.985 * one + np.sqrt(1 - 0.985 ** 2) * other
    hot = [(k, x.tolist(), "hot") for k, x in enumerate(np.stack([one, near], axis=1).reshape(-1, 32))]
    dense = one[0] + rnd.normal(size=(1500, 32)) * 1e-3  # nearly all links, which must not hide the pairs' recall
    rows = hot + [(20_000 + k, x.tolist(), "dense") for k, x in enumerate(dense)]
    rows += [(30_000 + k, rnd.normal(size=32).tolist(), f"l{k % 1000}") for k in range(2000)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in D.near_components(table).collect()}
    assert {got[r[0]] for r in rows if r[2] == "dense"} == {(1499, 20_000)}
    met = sum(got[k + 1][1] == k for k in range(0, len(hot), 2))
    assert met >= D.RECALL * len(one)


def test_labels_that_agree_in_their_first_bytes_stay_apart(spark):
    from foldsmith.llm import nn_descent as D

    long = "x" * 100
    rows = [(k, [1.0, float(k % 3), 2.0], long + "ab"[k % 2]) for k in range(24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in D.near_components(df).collect()}
    assert got == {k: (3, k % 6) for k in range(24)}
