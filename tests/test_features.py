import hashlib
import math
import re
from collections import Counter
from types import SimpleNamespace

import pytest

from foldsmith.operators import features as FE
from foldsmith.operators import textfeat as T
from foldsmith.plans.aggregates import second_level_rollup

TEXTS = [(1, "a b a b c"), (2, "c"), (3, ""), (4, None), (5, "x y z x y")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_hashed_once_for_all_modes(spark):
    rows = spark.createDataFrame(TEXTS, "id long, t string")
    out = FE.combine_fingerprints(rows, "id", "t", [(1,), (2,)], 16, {"folded": False, "concatenated": True})
    want = Counter()
    for at, text in TEXTS:
        words = (text or "").split()
        for kind, grams in enumerate((words, [f"{x} {y}" for x, y in zip(words, words[1:])])):
            for g in grams:
                h = int(hashlib.md5(g.encode()).hexdigest()[:8], 16)
                want[at, "folded", h % 16] += 1
                want[at, "concatenated", h % 8 + 8 * kind] += 1
    got = {(r["id"], r["mode"], r["bit"]): r["value"] for r in out.collect()}
    assert got == pytest.approx({k: math.log1p(n) for k, n in want.items()})
    assert plan_of(out).count("md5(") == 1


def test_weights_are_made_once_for_norm_and_result(spark):
    rows = spark.createDataFrame([(1, "red blue red"), (2, "blue green"), (None, "red green")], "id long, t string")
    out = T.tfidf_weights(rows, "id", "t", [], fit_share=1.0)
    squares = Counter()
    for r in out.collect():
        squares[r["id"]] += r["weight"] ** 2
    assert dict(squares) == pytest.approx({1: 1.0, 2: 1.0})  # a row without an id has no weights
    assert len(re.findall(r"Relation \[[^]]*\btf#", plan_of(out))) == 1  # the counts are read once


def test_decomposition_reads_a_stored_matrix(spark, monkeypatch):
    stored, store = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, label: stored.append(label) or store(df, label))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["red blue", "red green", "blue green red", "cat dog"])], "id long, t string")
    assert T.lsa_features(rows, "id", "t", [], n_components=2, fit_share=1.0).count() == 4
    assert "lsa-matrix" in stored


def test_second_level_holds_one_table_of_distinct_parts(spark):
    lines = [(1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, None, 3), (2, 5, None), (None, 1, 1)]
    t = SimpleNamespace(lineitem=spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_orderkey long"))
    out = second_level_rollup(t)
    assert {tuple(r) for r in out.collect()} == {(1, 2, 4), (2, 1, 0), (None, 1, 1)}
    assert out._jdf.queryExecution().analyzed().toString().count("distinct") == 1
