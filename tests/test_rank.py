import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from foldsmith.operators import rank as K


def rows(n=300, groups=3, seed=1):
    rng = random.Random(seed)
    # one group holds most of the rows, values repeat
    return [(i, "hot" if rng.random() < 0.7 else f"g{rng.randrange(groups)}", round(rng.gauss(0, 3), 1)) for i in range(n)]


def test_rank_equals_plain_row_number_and_ignores_partitioning(spark, small_blocks):
    data = rows()
    want = {}
    for g in {r[1] for r in data}:
        ids = sorted((r[0] for r in data if r[1] == g), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
        want |= {i: at for at, i in enumerate(ids)}
    for parts in (1, 5):
        df = spark.createDataFrame(data, "id long, g string, v double").repartition(parts)
        for digits in (None, 0, 2):
            out = K.distributed_rank(df, ["g"], K.seeded_order(7, "id"), [F.col("id")], digits=digits)
            assert {r["id"]: r["rank"] for r in out.collect()} == want


def test_rank_by_value_with_ties(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, v double")
    out = {r["id"]: r["rank"] for r in K.rank_by_value(df, ["g"], "v", [F.col("id")], buckets=8).collect()}
    for g in {r[1] for r in data}:
        order = sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [out[r[0]] for r in order] == list(range(len(order)))


def test_quantiles_are_exact(spark):
    data = rows() + [(1000, "one", 4.0)]
    df = spark.createDataFrame(data + [(2000, "one", None)], "id long, g string, v double")
    out = K.group_quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.9}, buckets=8).collect()
    assert {r["g"] for r in out} == {r[1] for r in data}
    for r in out:
        values = [d[2] for d in data if d[1] == r["g"]]
        np.testing.assert_allclose([r["a"], r["m"], r["z"]], np.quantile(values, [0.1, 0.5, 0.9]), rtol=1e-12, atol=1e-12)
    alone = K.group_quantiles(df, [], "v", {"m": 0.5}, buckets=4).first()
    assert abs(alone["m"] - np.median([d[2] for d in data])) < 1e-12


def test_cumulative_sums_both_ways(spark):
    data = [("a", float(v), v % 3 + 1) for v in range(60)] + [("b", 5.0, 7)]
    df = spark.createDataFrame(data, "g string, v double, n long")
    for down in (False, True):
        for r in K.group_cumsum(df, ["g"], "v", ["n"], descending=down, buckets=8).collect():
            mine = [d for d in data if d[0] == r["g"]]
            before = sum(d[2] for d in mine if (d[1] > r["v"] if down else d[1] < r["v"]))
            assert (r["before_n"], r["total_n"]) == (before, sum(d[2] for d in mine))


def test_crowded_values_and_many_buckets_keep_the_order(spark, small_blocks):
    # half of the rows share the lowest value, a fifth the highest; two rows a bucket cut the sketch's ranges further
    values = [0.0] * 50 + [i / 31 for i in range(30)] + [1.0] * 20
    rows = [((i * 37) % 100, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, v double")
    out = K.rank_by_value(df, [], "v", [F.col("id")], buckets=8, repeats="id").collect()
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["id"]: r["rank"] for r in out} == want
    cut = K.with_value_bucket(df, "v", 8)
    assert cut.filter("_crowded").select("v").distinct().collect()[0]["v"] == 0.0
    assert cut.select("_bucket").distinct().count() > 8
