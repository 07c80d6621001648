"""Relational joins, set operations and the fetch over the star schema."""

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import joins as J
from ..operators.fetch import datasets_by_condition, fetch_activities, target_counts
from ..operators.splits import pair_datasets
from .registry import query


def star(t):
    cust = t.customer.withColumnsRenamed({"c_custkey": "o_custkey", "c_nationkey": "n_nationkey"})
    return J.star_join(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), [
        (t.orders, "o_orderkey"), (cust, "o_custkey"), (t.nation, "n_nationkey"),
        (t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"),
        (t.part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey"),
        (t.supplier.withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")])


STAR_SQL = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""


@query("c1_star_join", f"""SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity, o_orderpriority, c_mktsegment,
    n_name, r_name, p_brand, s_name FROM {STAR_SQL}""")
def star_join(t):
    return star(t).select("o_orderkey", "l_linenumber", "l_quantity", "o_orderpriority", "c_mktsegment", "n_name",
                          "r_name", "p_brand", "s_name")


@query("c2_target_resolution", """SELECT s_suppkey, s_name, n_name, r_name FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def target_resolution(t):
    nation = t.nation.withColumnsRenamed({"n_nationkey": "s_nationkey", "n_regionkey": "r_regionkey"})
    return (J.star_join(t.supplier, [(nation, "s_nationkey"), (t.region, "r_regionkey")])
            .filter("r_name = 'ASIA'").select("s_suppkey", "s_name", "n_name", "r_name"))


@query("c3_confident_assays", """SELECT l_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_size >= 8 GROUP BY 1""")
def confident_assays(t):
    good = t.part.filter("p_size >= 8").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(good, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("c4_rejoin_subset", """SELECT e.event_id, s.grade FROM events e LEFT JOIN (SELECT event_id,
    CASE WHEN value > 100 THEN 'high' ELSE 'mid' END AS grade FROM events WHERE value > 50) s USING (event_id)""")
def rejoin_subset(t):
    subset = t.events.filter("value > 50").select(
        "event_id", F.when(F.col("value") > 100, "high").otherwise("mid").alias("grade"))
    return t.events.select("event_id").join(subset, "event_id", "left")


@query("c5_anti_all_columns", """SELECT l.lang, l.source, l.quality FROM (SELECT lang, source, quality FROM documents
    LEFT JOIN labels USING (doc_id)) l WHERE NOT EXISTS (SELECT 1 FROM (SELECT lang, source, quality FROM documents
    LEFT JOIN labels USING (doc_id) WHERE n_chars < 150) r WHERE l.lang = r.lang AND l.source = r.source
    AND l.quality IS NOT DISTINCT FROM r.quality)""")
def anti_all_columns(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    cols = ["lang", "source", "quality"]
    return J.anti_all_columns(rows.select(*cols), rows.filter("n_chars < 150").select(*cols))


@query("c6_semi_join", """SELECT doc_id, lang FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def semi_join(t):
    return t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("c7_stage_stats_outer", """SELECT coalesce(a.user_id, b.user_id) AS user_id,
    coalesce(a.event_type, b.event_type) AS event_type, a.n_big, b.n_small
    FROM (SELECT user_id, event_type, count(*) AS n_big FROM events WHERE value > 120 GROUP BY 1, 2) a
    FULL OUTER JOIN (SELECT user_id, event_type, count(*) AS n_small FROM events WHERE value < 3 GROUP BY 1, 2) b
    ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def stage_stats_outer(t):
    keys = ["user_id", "event_type"]
    big = t.events.filter("value > 120").groupBy(*keys).agg(F.count("*").alias("n_big"))
    small = t.events.filter("value < 3").groupBy(*keys).agg(F.count("*").alias("n_small"))
    return big.join(small, keys, "outer")


def event_datasets(t):
    """Dataset keys of all four levels drawn from the events: user, parity, k-group, type, single k."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = t.events.select((F.col("user_id") % 10).cast("string").alias("target"),
                           F.when(k % 2 == 0, "even").otherwise("odd").alias("effect"),
                           (k % 3).cast("string").alias("assay"), F.col("event_type").alias("std_type"),
                           F.concat(F.lit("k"), k).alias("assay_id"))
    none = F.lit(None).cast("string")
    parts = {"hhd": ["target", "std_type"], "mhd-effect": ["target", "effect"],
             "mhd": ["target", "effect", "assay", "std_type"],
             "lhd": ["target", "effect", "assay", "std_type", "assay_id"]}
    levels = [base.select(F.lit(level).alias("level"), *[
        F.col(c) if c in keep else none.alias(c) for c in ("target", "effect", "assay", "std_type", "assay_id")]).distinct()
        for level, keep in parts.items()]
    out = levels[0]
    for frame in levels[1:]:
        out = out.unionByName(frame)
    return out


DATASETS_SQL = """WITH base AS (SELECT CAST(user_id % 10 AS VARCHAR) AS target, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END
      AS effect, CAST(k % 3 AS VARCHAR) AS assay, event_type AS std_type, 'k' || k AS assay_id
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
    d AS (SELECT DISTINCT 'hhd' AS level, target, CAST(NULL AS VARCHAR) AS effect, CAST(NULL AS VARCHAR) AS assay, std_type,
        CAST(NULL AS VARCHAR) AS assay_id FROM base
      UNION ALL SELECT DISTINCT 'mhd-effect', target, effect, NULL, NULL, NULL FROM base
      UNION ALL SELECT DISTINCT 'mhd', target, effect, assay, std_type, NULL FROM base
      UNION ALL SELECT DISTINCT 'lhd', target, effect, assay, std_type, assay_id FROM base)"""


@query("c8_parent_child_pairs", DATASETS_SQL + """
    SELECT p.level AS parent_level, c.level AS child_level, p.target AS parent_target, count(*) AS n_pairs,
      count(DISTINCT c.assay_id) AS n_ids FROM d p JOIN d c ON (p.level = 'hhd' AND c.level IN ('mhd', 'lhd')
        AND p.target = c.target AND p.std_type = c.std_type)
      OR (p.level = 'mhd-effect' AND c.level IN ('mhd', 'lhd') AND p.target = c.target AND p.effect = c.effect)
      OR (p.level = 'mhd' AND c.level = 'lhd' AND p.target = c.target AND p.effect = c.effect AND p.assay = c.assay
        AND p.std_type = c.std_type) GROUP BY 1, 2, 3""")
def parent_child_pairs(t):
    return (pair_datasets(event_datasets(t)).groupBy("parent_level", "child_level", "parent_target")
            .agg(F.count("*").alias("n_pairs"), F.countDistinct("child_assay_id").alias("n_ids")))


@query("c9_membership_join", """SELECT o.o_orderkey, CASE WHEN l.l_orderkey IS NOT NULL THEN 'test' ELSE 'train' END AS role
    FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49) l
    ON o.o_orderkey = l.l_orderkey""")
def membership_join(t):
    tests = (t.lineitem.filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
             .withColumn("hit", F.lit(True)))
    return t.orders.select("o_orderkey").join(tests, "o_orderkey", "left").select(
        "o_orderkey", F.when(F.col("hit"), "test").otherwise("train").alias("role"))


@query("c18_attach_dimension", """SELECT n_name, r_name, m.n, m.mean_balance FROM (SELECT c_nationkey, count(*) AS n,
    round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1) m JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def attach_dimension(t):
    per = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))
    return (per.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_name", "r_name", "n", "mean_balance"))


@query("e3_keep_first", """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def keep_first(t):
    rows = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return J.keep_first(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("g1_union_all", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000""")
def union_all(t):
    cols = ["o_orderkey", "o_orderstatus"]
    return (t.orders.filter("o_orderstatus = 'F'").select(*cols)
            .unionByName(t.orders.filter("o_totalprice > 300000").select(*cols)))


@query("g2_union_ids", """SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_ids(t):
    return (t.customer.select(F.col("c_nationkey").alias("nationkey"))
            .union(t.supplier.select("s_nationkey")).distinct())


@query("g3_intersect_and_difference", """SELECT 'both' AS side, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
      INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'first', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
      EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def intersect_and_difference(t):
    a = t.orders.filter("o_orderstatus = 'F'").select("o_custkey")
    b = t.orders.filter("o_orderstatus = 'P'").select("o_custkey")
    return (a.intersect(b).select(F.lit("both").alias("side"), "o_custkey")
            .unionByName(a.subtract(b).select(F.lit("first").alias("side"), "o_custkey")))


ACTIVITIES_SQL = """WITH targets AS (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')),
    acts AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, o_orderdate, o_orderpriority,
        p_name, p_size, s_name, n_name FROM lineitem JOIN targets ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') AND o_orderdate IS NOT NULL AND p_size >= 8
        AND NOT contains(lower(p_name), 'bolt') AND NOT contains(lower(p_name), 'cold'))"""


@query("i30_fetch_activities", ACTIVITIES_SQL + """SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name, l_returnflag,
    l_quantity, o_orderpriority, p_size FROM acts""")
def fetch_activities_query(t):
    return fetch(t).select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name", "l_returnflag", "l_quantity",
                           "o_orderpriority", "p_size")


def fetch(t):
    targets = J.star_join(t.supplier, [
        (t.nation.withColumnsRenamed({"n_nationkey": "s_nationkey", "n_regionkey": "r_regionkey"}), "s_nationkey"),
        (t.region, "r_regionkey")]).filter(P.allowed(F.col("r_name"), ["ASIA", "EUROPE"])) \
        .withColumnRenamed("s_suppkey", "l_suppkey")
    return fetch_activities(
        t.lineitem, assays=t.part.withColumnRenamed("p_partkey", "l_partkey"), assay_key="l_partkey",
        targets=targets, target_key="l_suppkey", docs=t.orders.withColumnRenamed("o_orderkey", "l_orderkey"),
        doc_key="l_orderkey", std_type="l_returnflag", types=["A", "R"], confidence="p_size", min_confidence=8,
        doc_date="o_orderdate", text="p_name", drop_keywords=["bolt", "cold"])


@query("i30_activity_counts", ACTIVITIES_SQL + """SELECT s_name, count(DISTINCT l_partkey) AS n_assays,
    CAST(sum(cnt) AS BIGINT) AS n_items FROM (SELECT s_name, l_partkey, count(DISTINCT l_orderkey) AS cnt FROM acts
    GROUP BY 1, 2) GROUP BY 1""")
def activity_counts(t):
    return target_counts(fetch(t), target="s_name", assay="l_partkey", item="l_orderkey")


@query("i31_conditions", """SELECT target, condition, n_rows, n_assays, first_id,
    row_number() OVER (PARTITION BY target ORDER BY first_id, condition) AS ordinal FROM (
      SELECT s_nationkey AS target, md5(p_type || p_brand) AS condition, count(*) AS n_rows,
        count(DISTINCT l_partkey) AS n_assays, min(l_orderkey) AS first_id FROM lineitem
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING count(*) >= 20)""")
def conditions(t):
    rows = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    return datasets_by_condition(rows, target="s_nationkey", fields=["p_type", "p_brand"], assay="l_partkey",
                                 order="l_orderkey", min_size=20).withColumnRenamed("s_nationkey", "target")
