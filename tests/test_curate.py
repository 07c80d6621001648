import math

import pytest
from pyspark.sql import functions as F

from foldsmith.functions import labels as L
from foldsmith.functions import predicates as P
from foldsmith.operators import curate as C
from foldsmith.operators import joins as J

NAN = float("nan")


def label_of(spark, value, relation, threshold=5.0, buffer=0.5):
    df = spark.createDataFrame([(value, relation, threshold, buffer)], "v double, r string, t double, b double")
    return df.select(L.activity_label(F.col("v"), F.col("r"), F.col("t"), F.col("b")).alias("x")).first()["x"]


@pytest.mark.parametrize("value, relation, want", [
    (5.5, "=", "active"), (5.4, "~", "weak active"), (5.0, "<", "weak inactive"), (4.6, "<=", "weak inactive"),
    (4.5, "=", "inactive"), (9.0, ">", "inactive"), (9.0, ">=", "inactive"), (9.0, "?", None), (9.0, None, None),
    (NAN, "=", None), (None, "=", None), (NAN, ">", "inactive")])
def test_labels_at_the_edges(spark, value, relation, want):
    assert label_of(spark, value, relation) == want


def test_no_buffer_gives_no_label(spark):
    assert label_of(spark, 6.0, "=", buffer=None) is None
    assert label_of(spark, 6.0, ">", buffer=None) == "inactive"


def test_auto_threshold_limits(spark):
    df = spark.createDataFrame([(3.9,), (4.0,), (6.0,), (6.1,), (7.0,), (7.1,)], "m double")
    got = [tuple(r) for r in df.select(L.auto_threshold(F.col("m"), "vs"), L.auto_threshold(F.col("m"), "lo")).collect()]
    assert got == [(5.0, 6.3), (4.0, 6.3), (6.0, 6.0), (5.0, 6.1), (5.0, 7.0), (5.0, 6.3)]


def test_percent_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(L.percent(F.col("a"), F.col("b"))).collect()] == [0.0, 33.33]


def test_clean_drops_what_cannot_be_used(spark):
    df = spark.createDataFrame([
        (1, "nM", "5", "="), (2, "mg", "5", "="), (3, "uM", "0", "="), (4, "uM", "-1", "="), (5, "nM", None, "="),
        (6, "nM", "NaN", "="), (7, "nM", "x", "="), (8, "nM", "5", " "), (9, "nM", "5", None), (10, None, "5", "=")],
        "id long, standard_units string, standard_value string, standard_relation string")
    assert [r["id"] for r in C.clean(df).collect()] == [1]


def test_standardize_costs_only_the_bad_row(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "uM", 10.0), (2, None, 1.0, "nM", 10.0), (3, "c", 1.0, "nM", 901.0)],
                               "id long, k string, standard_value double, standard_units string, w double")
    out = C.standardize(df, lambda: F.col("k"), F.col("w")).collect()
    assert [(r["id"], r["standard_value"], round(r["p_value"], 9), r["standard_units"]) for r in out] == [(1, 1000.0, 6.0, "nM")]


def test_replicates(spark):
    data = [("single", 1, 3.0), ("close", 2, 4.0), ("close", 3, 5.0), ("far", 4, 1.0), ("far", 5, 9.0), (None, 6, 1.0),
            ("tie", 8, 2.0), ("tie", 7, 2.0)]
    df = spark.createDataFrame(data, "k string, id long, v double")
    for parts in (1, 4):
        out = {r["k"]: (r["id"], r["v"]) for r in C.consolidate(df.repartition(parts), ["k"], "v", ["id"]).collect()}
        assert out == {"single": (1, 3.0), "close": (2, 4.5), "tie": (7, 2.0)}


def curated(spark, data, **options):
    df = spark.createDataFrame(data, "id long, ds string, item_key string, p_value double, standard_relation string")
    return C.curate(df, ["ds"], "id", lambda: F.col("item_key").substr(1, 1), **options)


def test_curate_takes_lo_from_what_vs_left(spark, small_blocks):
    data = [(i, "big", f"k{i}", 4.0 + i * 0.25, "=") for i in range(12)]
    data += [(100, "big", "k100", 5.0, "?"), (200, "alone", "x", 5.5, "="), (201, "above", "y", 5.5, ">")]
    rows = {r["id"]: r for r in curated(spark, data).collect()}
    # a single row has no deviation and so no label, unless its relation decides alone
    assert 200 not in rows and 100 not in rows
    assert rows[201]["vs_activity"] == 0.0 and rows[201]["vs_threshold"] == 5.5
    values = sorted([d[3] for d in data[:13]])
    median = values[6]
    assert rows[0]["vs_threshold"] == round(median, 2)
    kept = sorted(d[3] for d in data[:12])
    assert rows[0]["lo_threshold"] == round((kept[5] + kept[6]) / 2, 2)
    assert all(r["has_sibling"] for i, r in rows.items() if i < 100) and not rows[201]["has_sibling"]


def test_summary_of_siblings_only(spark):
    data = [(i, "d", f"k{i}", 5.0 + i, "=") for i in range(4)]
    out = C.dataset_summary(curated(spark, data).withColumn("weight", F.lit(1.0)), ["ds"]).first()
    assert (out["size_all"], out["size_alone"], out["vs_percent_alone"]) == (4, 0, 0.0)
    assert out["level_all"] == "s50" and out["vs_percent_all"] == 75.0


def test_predicates_are_never_null(spark):
    df = spark.createDataFrame([(None, None), ("a gtp b", 3.0), ("GTP arrestin", NAN)], "s string, v double")
    out = df.select(P.matches(F.col("s"), "(?i)gtp", "(?i)arrestin"), P.positive(F.col("v")), P.non_blank(F.col("s")),
                    P.mentions_any(F.col("s"), ["Arrestin"]), P.any_below([F.col("v")], 5)).collect()
    assert [tuple(r) for r in out] == [(False, False, False, False, False), (True, True, True, False, True),
                                       (False, False, True, True, False)]


def test_anti_join_over_all_columns_keeps_repeats_and_matches_nulls(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (3, "b")], "x int, y string")
    right = spark.createDataFrame([(1, None), (3, "c")], "x int, y string")
    assert sorted(tuple(r) for r in J.anti_all_columns(left, right).collect()) == [(2, "a"), (2, "a"), (3, "b")]


def test_hot_groups_lose_nothing(spark, small_blocks):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i}") for i in range(300)], "id long, g string")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    out = J.join_group_stats(rows, sizes, ["g"], ["id"]).collect()
    assert len(out) == 300 and {r["n"] for r in out if r["g"] == "hot"} == {200}
    kept = J.gate_by_size(rows, ["g"], ["id"], 2, 1000)
    assert kept.count() == 200 and J.gate_by_size(rows, ["g"], ["id"], None, 1).count() == 100
    assert math.isclose(J.gate_by_size(rows, ["g"], ["id"]).count(), 300)
