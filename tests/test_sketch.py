import math

from pyspark.sql import functions as F

from foldsmith.operators import sketch as K

LG = 10
ERROR = 1 / math.sqrt(2 ** LG)


def rows(spark, n=60_000):
    # three keys; one holds five sixths of the items, each item comes twice, in different batches
    df = spark.range(2 * n).select((F.col("id") % n).alias("item"), (F.floor(F.col("id") / n)).alias("batch"))
    return df.withColumn("key", F.when(F.col("item") % 6 > 0, "hot").when(F.col("item") % 12 == 0, "a").otherwise("b"))


def test_estimates_lie_within_the_error(spark):
    df = rows(spark)
    exact = {r["key"]: r["n"] for r in df.groupBy("key").agg(F.countDistinct("item").alias("n")).collect()}
    whole = {r["key"]: r for r in K.estimates(K.distinct_sketches(df, ["key"], "item", LG)).collect()}
    merged = {r["key"]: r for r in K.estimates(K.merge_sketches(K.distinct_sketches(df, ["key", "batch"], "item", LG), ["key"], LG)).collect()}
    for key, n in exact.items():
        for got in (whole, merged):
            assert abs(got[key]["n_items"] - n) <= 4 * ERROR * n
            assert got[key]["n_rows"] == 2 * n


def test_few_items_are_counted_exactly_whatever_their_kind(spark):
    df = spark.createDataFrame([("x", i % 7, f"t{i % 5}", float(i % 3), None) for i in range(100)] + [("y", None, None, None, None)],
                               "key string, a int, b string, c double, d long")
    for column, n in (("a", 7), ("b", 5), ("c", 3), ("d", 0)):
        got = {r["key"]: (r["n_items"], r["n_rows"]) for r in K.estimates(K.distinct_sketches(df, ["key"], column)).collect()}
        assert got == {"x": (n, 100), "y": (0, 1)}
    assert K.distinct_sketches(df.limit(0), ["key"], "a").count() == 0


def test_second_level_counts_from_sketches(spark):
    df = spark.createDataFrame([("s", p, i) for p in range(4) for i in range(p * 5, p * 5 + 10)] * 2, "key string, part int, item int")
    stored = K.distinct_sketches(df, ["key", "part"], "item")
    assert [tuple(r) for r in K.second_level_estimates(stored, ["key"], "part").collect()] == [("s", 4, 40, 25)]


def test_overlap_within_its_error_and_with_a_missing_side(spark):
    a = spark.range(30_000).select(F.lit("p").alias("pair"), "id").unionByName(spark.createDataFrame([("q", 1)], "pair string, id long"))
    b = spark.range(20_000, 50_000).select(F.lit("p").alias("pair"), "id").unionByName(spark.createDataFrame([("r", 1), ("r", 2)], "pair string, id long"))
    got = {r["pair"]: r for r in K.overlap_estimates(K.distinct_sketches(a, ["pair"], "id", LG), K.distinct_sketches(b, ["pair"], "id", LG), ["pair"]).collect()}
    assert abs(got["p"]["intersection_count"] - 10_000) <= 4 * ERROR * math.sqrt(50_000 * 10_000)
    assert abs(got["p"]["coverage"] - 1 / 3) < 0.1
    assert tuple(got["q"])[1:] == (1, 0, 0, 0.0, 0.0, 1, 0)
    assert tuple(got["r"])[1:] == (0, 2, 0, 0.0, 0.0, 0, 2)
