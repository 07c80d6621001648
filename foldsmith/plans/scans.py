"""Sources and sinks: each query writes its table to the shared folder and reads it back."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import scratch_path
from ..sources import commits as C
from ..sources import tables as S
from ..sources.schemas import schema_of
from .registry import query

ORDERS = schema_of("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                            "o_orderdate date, o_orderpriority string")
ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
    o_orderpriority FROM orders"""


def _orders(t):
    return t.orders.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("a1_csv_round_trip", ORDERS_SQL)
def csv_round_trip(t):
    path = scratch_path(t.spark, "orders-csv")
    S.write_csv(_orders(t), path)
    return S.read_csv(t.spark, path, ORDERS)


@query("a2_parquet_scan", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity >= 45""")
def parquet_scan(t):
    return (t.lineitem.filter("l_returnflag = 'R' AND l_quantity >= 45")
            .select("l_orderkey", "l_partkey", "l_quantity"))


@query("a3_vector_round_trip", """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim,
    round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings""")
def vector_round_trip(t):
    path = scratch_path(t.spark, "vectors")
    t.embeddings.write.parquet(path)
    back = t.spark.read.schema(t.embeddings.schema).parquet(path)
    return back.select("vec_id", "label", F.size("embedding").alias("dim"),
                       F.round(V.total(F.col("embedding")), 5).alias("total"))


@query("a4_tsv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def tsv_round_trip(t):
    path = scratch_path(t.spark, "customer-tsv")
    S.write_csv(t.customer, path, sep="\t")
    return S.read_tsv(t.spark, path, t.customer.schema)


@query("a5_bind_parameters", """SELECT l_orderkey, l_partkey, o_orderpriority, l_quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND l_quantity >= 30""")
def bind_parameters(t):
    return S.read_relational(
        t.spark, """SELECT l_orderkey, l_partkey, o_orderpriority, l_quantity
        FROM source_lineitem JOIN source_orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = :flag AND l_quantity >= :low""",
        {"source_lineitem": t.lineitem, "source_orders": t.orders}, flag="A", low=30)


@query("a6_json_round_trip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def json_round_trip(t):
    path = scratch_path(t.spark, "part-json")
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    part.write.json(path)
    return t.spark.read.schema(part.schema).json(path)


@query("a7_dataset_catalog", """SELECT p_brand || '-' || p_type AS name, count(*) AS num_points,
    count(DISTINCT p_name) AS n_members FROM part GROUP BY 1""")
def dataset_catalog(t):
    path = scratch_path(t.spark, "catalog")
    catalog = (t.part.groupBy(F.concat_ws("-", "p_brand", "p_type").alias("name"))
               .agg(F.count("*").alias("num_points"), F.countDistinct("p_name").alias("n_members")))
    catalog.write.json(path)
    return t.spark.read.schema("name string, num_points bigint, n_members bigint").json(path)


@query("a7_catalog_members", """SELECT p_brand || '-' || p_type AS name, p_name AS member, count(*) AS n
    FROM part GROUP BY ALL""")
def catalog_members(t):
    return (t.part.groupBy(F.concat_ws("-", "p_brand", "p_type").alias("name"), F.col("p_name").alias("member"))
            .agg(F.count("*").alias("n")))


@query("a8_sparse_matrix", """SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS value
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
    WHERE embedding[i] <> 0""")
def sparse_matrix(t):
    path = scratch_path(t.spark, "sparse")
    entries = t.embeddings.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("col", "value"))
    entries.filter(F.col("value") != 0).withColumn("value", F.col("value").cast("double")) \
        .write.parquet(path)
    return t.spark.read.schema("row_id bigint, col int, value double").parquet(path)


@query("a9_path_metadata", """SELECT o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS priority,
    CAST(NULL AS VARCHAR) AS assay, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def path_metadata(t):
    path = scratch_path(t.spark, "named")
    name = F.concat_ws("_", "o_orderstatus", F.substring("o_orderpriority", 1, 1), F.lit("None"))
    S.write_csv(t.orders.select("o_orderkey", "o_totalprice", name.alias("dataset")), path, by=["dataset"])
    schema = schema_of("o_orderkey bigint, o_totalprice double")
    back = t.spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    named = S.with_path_parts(back, ["status", "priority", "assay"], folder="dataset")
    return named.groupBy("status", "priority", "assay").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a10_partitioned_layout", """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
    WHERE o_orderstatus = 'P'""")
def partitioned_layout(t):
    path = scratch_path(t.spark, "layout")
    S.write_partitioned(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"],
                        files_per_key=4, spread=["o_orderkey"])
    schema = "o_orderkey bigint, o_totalprice double, o_orderstatus string"
    return t.spark.read.schema(schema).parquet(path).filter("o_orderstatus = 'P'")


@query("a11_union_columns", """SELECT c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment,
    CAST(NULL AS DOUBLE) AS balance FROM customer
    UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier""")
def union_columns(t):
    return S.read_union([
        t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
                          F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
                          F.col("s_acctbal").alias("balance"))])


@query("a12_append_results", """SELECT 'first' AS run, o_orderstatus, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'second', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def append_results(t):
    path = scratch_path(t.spark, "results")
    for run, column in (("first", "o_orderstatus"), ("second", "o_orderpriority")):
        S.append_results(t.orders.groupBy(F.col(column).alias("o_orderstatus")).agg(F.count("*").alias("n")), path, run)
    return t.spark.read.schema("o_orderstatus string, n bigint, run string").parquet(path)


@query("a13_rewrite_with_columns", """SELECT s_suppkey, s_name, s_nationkey, s_acctbal, s_acctbal > 0 AS solvent
    FROM supplier""")
def rewrite_with_columns(t):
    return S.rewrite_with(t.supplier, {"solvent": F.col("s_acctbal") > 0}, "supplier")


@query("a12_commit_once", """SELECT 'first' AS run, o_orderstatus, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'second', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def commit_once(t):
    path = scratch_path(t.spark, "runs")
    for run, column in (("first", "o_orderstatus"), ("second", "o_orderpriority"), ("first", "o_orderstatus")):
        C.commit_run(t.orders.groupBy(F.col(column).alias("o_orderstatus")).agg(F.count("*").alias("n")), path, run)
    return C.read_runs(t.spark, path, "o_orderstatus string, n bigint")


@query("a13_versioned_rewrite", """SELECT s_suppkey, s_acctbal, s_acctbal > 0 AS solvent, CAST(NULL AS BOOLEAN) AS rich, 1 AS version FROM supplier
    UNION ALL SELECT s_suppkey, s_acctbal, s_acctbal > 0, s_acctbal > 5000, 2 FROM supplier""")
def versioned_rewrite(t):
    path = scratch_path(t.spark, "versions")
    C.commit_version(t.supplier.select("s_suppkey", "s_acctbal"), path, None)
    C.rewrite_version(t.spark, path, lambda old: old.withColumn("solvent", F.col("s_acctbal") > 0))
    C.rewrite_version(t.spark, path, lambda old: old.withColumn("rich", F.col("s_acctbal") > 5000))
    return S.read_union([C.read_version(t.spark, path, v).withColumn("version", F.lit(v)) for v in (1, 2)])


@query("a14_pair_file", """SELECT 'p' || l_partkey AS active, count(*) AS n_decoys, min('s' || l_suppkey) AS first_decoy
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1""")
def pair_file(t):
    path = scratch_path(t.spark, "pairs")
    pairs = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("active"),
                              F.concat(F.lit("s"), "l_suppkey").alias("decoy")).distinct()
    pairs.write.option("sep", " ").csv(path)
    return (S.read_pairs(t.spark, path).groupBy("active")
            .agg(F.count("*").alias("n_decoys"), F.min("decoy").alias("first_decoy")))
