"""Whitening against one dense computation."""

import math
import random

import numpy as np
import pytest

from foldsmith.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, n string, x int, k1 int"


def dense(rows, components=4, weights="one"):
    """{(id, x): (n, deviation, whitened without sign, explained)} by plain numpy and exact integers."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dims in {len(x) for _, x in kept}:
        mine = [(i, x) for i, x in kept if len(x) == dims]
        fit = [x for _, x in mine] if weights == "count" else sorted({x for _, x in mine})
        n, total = len(fit), [sum(c) for c in zip(*fit)]
        a = np.array(fit, dtype=np.float64) - np.array([s / n for s in total])
        cov = a.T @ a / n
        values, vectors = np.linalg.eigh(cov)
        for k in range(min(components, dims)):
            e, v = values[-1 - k], vectors[:, -1 - k]
            if e <= 1e-10 * np.trace(cov):
                break
            for i, x in mine:
                dev = sum((n * c - s) ** 2 for c, s in zip(x, total))
                out.append((i, k + 1, n, dev if dev < 1 << 63 else None,
                            (np.array(x, dtype=np.float64) - np.array([s / n for s in total])) @ v / math.sqrt(e), e / np.trace(cov)))
    return out


def compare(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[2], str(r[3]), round(abs(r[4]), 5), r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and abs(g[4]) == pytest.approx(abs(w[4]), rel=1e-6, abs=1e-7)
        assert g[5] == pytest.approx(w[5], rel=1e-8)
    signs, by_key = {}, {}
    for w in want:
        by_key.setdefault((w[0], w[1], w[3]), []).append(w[4])
    for g in got:
        match = by_key[g[0], g[1], g[3]]
        if abs(g[4]) > 1e-3 and len(match) == 1:
            signs.setdefault((g[1], g[2]), set()).add(np.sign(g[4] * match[0]))
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def made(seed=1, rows=600, dims=7):
    rnd = random.Random(seed)
    out = [(k, [rnd.gauss(0, 1 + j) for j in range(dims)]) for k in range(rows)]
    out += [(1000 + k, out[3][1]) for k in range(400)] + [(None, out[5][1]), (None, out[6][1]), (7, out[7][1]), (7, out[7][1])]
    out += [(2000, None), (2001, []), (2002, [float("nan")] * dims), (2003, [float("inf")] + [0.0] * (dims - 1)),
            (2004, [None] + [1.0] * (dims - 1))]
    return out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_a_dense_computation(spark, weights):
    rows = made()
    for parts in (1, 5):
        df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA).repartition(parts)
        got = W.whiten(df, weights=weights).collect()
        compare(got, dense(rows, weights=weights))
        assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_lengths_apart_and_huge_entries(spark):
    rows = made(2, 60, 3) + [(5000 + k, [float(k % 4), float(k % 3)]) for k in range(30)] + [(6000, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA)
    got = W.whiten(df).collect()
    compare(got, dense(rows))
    assert not [r for r in got if r.vec_id == 6000]  # one vector has no variance
    rows = [(k, [1e12 * (-1) ** k, 3e13, float(k)]) for k in range(40)]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA)
    got = W.whiten(df).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} == {1}
    assert W.whiten(spark.createDataFrame([(1, [3e38, -3e38], "", 0, 0)] * 3, SCHEMA)).count() == 0


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in [(1, [1.0, 2.0, 5.0]), (2, [2.0, 4.0, 1.0]), (3, [1.0, 2.0, 5.0])]], SCHEMA)
    got = W.whiten(df).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert {round(abs(r.whitened), 9) for r in got} == {1.0}
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.filter("vec_id = 1")).count() == 0
    assert W.whiten(df.selectExpr("vec_id", "cast(null as array<float>) as embedding")).count() == 0


def test_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = entry.queries()["op11_embedding_whitening"](spark, folder).collect()
    compare(got, dense(rows))
    assert got[0].identity_error < 1e-4
