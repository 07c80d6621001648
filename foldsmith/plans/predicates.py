"""Filters, coercions and the rule table."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import predicates as P
from ..operators.categorize import Rule, match_rules
from .registry import query

# the rule table for the documents: languages stand for measurement types
DOC_RULES = [
    Rule("bind", "plain", ("en", "de"), "(?i)the|der", "(?i)token|password"),
    Rule("agon", "marked", ("en", "fr", "es", "de"), "###|%%%", "(?i)secret"),
    Rule("antag", "romance", ("fr", "es"), "(?i)que|les", "(?i)token"),
]
RULE_SQL = """
    SELECT doc_id, lang, source, 'bind' AS effect, 'plain' AS assay, coalesce(regexp_matches(text, '(?i)the|der')
        AND NOT regexp_matches(text, '(?i)token|password'), false) AS matched
    FROM documents WHERE lang IN ('en', 'de')
    UNION ALL SELECT doc_id, lang, source, 'agon', 'marked', coalesce(regexp_matches(text, '###|%%%')
        AND NOT regexp_matches(text, '(?i)secret'), false) FROM documents WHERE lang IN ('en', 'fr', 'es', 'de')
    UNION ALL SELECT doc_id, lang, source, 'antag', 'romance', coalesce(regexp_matches(text, '(?i)que|les')
        AND NOT regexp_matches(text, '(?i)token'), false) FROM documents WHERE lang IN ('fr', 'es')"""


@query("b1_target_type_subsets", """SELECT user_id AS target, event_type AS std_type, count(*) AS n,
    round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def target_type_subsets(t):
    return (t.events.groupBy(F.col("user_id").alias("target"), F.col("event_type").alias("std_type"))
            .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("b2_pattern_filter", """SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)affinity|the|3h')
    AND NOT regexp_matches(text, '(?i)token|password|###')""")
def pattern_filter(t):
    return (t.documents.filter(P.matches(F.col("text"), "(?i)affinity|the|3h", "(?i)token|password|###"))
            .select("doc_id", "lang"))


@query("b3_rule_categorization", RULE_SQL)
def rule_categorization(t):
    return match_rules(t.documents.select("doc_id", "lang", "source", "text"), DOC_RULES, "text", "lang").drop("text")


@query("b4_id_lists", """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
      AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def id_lists(t):
    wanted = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    barred = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return (t.orders.filter(P.allowed(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]))
            .join(wanted, "o_custkey", "left_semi").join(barred, "o_custkey", "left_anti")
            .select("o_orderkey", "o_custkey"))


@query("b5_keyword_drop", """SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id)
    WHERE toxic IS DISTINCT FROM 1 AND NOT contains(lower(text), 'token') AND NOT contains(lower(text), 'license')""")
def keyword_drop(t):
    flagged = t.labels.filter("toxic = 1").select("doc_id")
    return (t.documents.filter(~P.mentions_any(F.col("text"), ["token", "license"]))
            .join(flagged, "doc_id", "left_anti").select("doc_id", "source"))


@query("b6_require_document_date", """SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer
    LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def require_document_date(t):
    joined = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return (joined.filter(F.col("o_orderdate").isNotNull()).groupBy("c_custkey")
            .agg(F.count("o_orderkey").alias("n_orders")))


@query("b7_range_filters", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 8 AND p_retailprice <= 900.5")
def range_filters(t):
    return t.part.filter("p_size >= 8 AND p_retailprice <= 900.5D").select("p_partkey", "p_size", "p_retailprice")


@query("b8_allowed_units", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def allowed_units(t):
    return (t.orders.filter(P.allowed(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]))
            .select("o_orderkey", "o_orderpriority"))


@query("b9_positive_values", "SELECT event_id, round(value - 30, 6) AS shifted FROM events WHERE value - 30 > 0")
def positive_values(t):
    return (t.events.select("event_id", F.round(F.col("value") - 30, 6).alias("shifted"))
            .filter(P.positive(F.col("shifted"))))


@query("b10_non_blank", """SELECT doc_id FROM (SELECT doc_id, regexp_replace(text, '[^#]', '', 'g') AS mark
    FROM documents) WHERE trim(mark) <> ''""")
def non_blank(t):
    return (t.documents.select("doc_id", F.regexp_replace("text", "[^#]", "").alias("mark"))
            .filter(P.non_blank(F.col("mark"))).select("doc_id"))


@query("b11_type_coercion", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
    coalesce(TRY_CAST(event_type AS INTEGER), 0) AS type_code, TRY_CAST(event_type AS DOUBLE) AS type_number FROM events""")
def type_coercion(t):
    return t.events.select(
        "event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k"),
        F.coalesce(F.col("event_type").try_cast("int"), F.lit(0)).alias("type_code"),
        F.col("event_type").try_cast("double").alias("type_number"))


@query("b12_fill_missing", """SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)""")
def fill_missing(t):
    return (t.documents.select("doc_id").join(t.labels, "doc_id", "left")
            .fillna({"quality": -1, "toxic": 0}))


@query("b13_rename_drop", """SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey,
    s_acctbal * 2 AS double_balance FROM supplier""")
def rename_drop(t):
    return (t.supplier.withColumn("double_balance", F.col("s_acctbal") * 2)
            .withColumnsRenamed({"s_suppkey": "supplier_id", "s_name": "supplier_name"}).drop("s_acctbal"))


@query("b14_code_labels", """SELECT c_custkey, n_name AS nation, CASE c_mktsegment WHEN 'MACHINERY' THEN 'machines'
    WHEN 'HOUSEHOLD' THEN 'home' END AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def code_labels(t):
    names = F.create_map(F.lit("MACHINERY"), F.lit("machines"), F.lit("HOUSEHOLD"), F.lit("home"))
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return (t.customer.join(nations, "c_nationkey", "left")
            .select("c_custkey", "nation", names[F.col("c_mktsegment")].alias("segment")))


@query("b15_dynamic_filter", """SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#17')
    AND p_type = 'ECONOMY'""")
def dynamic_filter(t):
    test = P.equals_all(p_brand=["Brand#1", "Brand#2", "Brand#17"], p_type="ECONOMY", p_size=None)
    return t.part.filter(test).select("p_partkey")


@query("b16_index_box", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_partkey BETWEEN 100 AND 1500 AND l_suppkey <= 40""")
def index_box(t):
    box = P.in_box(F.col("l_partkey"), F.col("l_suppkey"), i_low=100, i_high=1500, j_high=40)
    return t.lineitem.filter(box).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("b17_any_below", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE l_quantity < 2 OR l_discount * 100 < 2""")
def any_below(t):
    return (t.lineitem.filter(P.any_below([F.col("l_quantity"), F.col("l_discount") * 100], 2))
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))


@query("b18_scoped_suppression", """SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (
    SELECT 1 FROM customer c WHERE c_acctbal < 0 AND o.o_orderstatus = 'F' AND c.c_custkey = o.o_custkey)""")
def scoped_suppression(t):
    barred = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"),
                                                       F.lit("F").alias("o_orderstatus"))
    return t.orders.join(barred, ["o_orderstatus", "o_custkey"], "left_anti").select("o_orderkey", "o_orderstatus")


@query("b20_probability_cut", """SELECT event_id, CAST(1 / (1 + exp(-(value - 40) / 10)) > 0.5 AS INTEGER) AS positive
    FROM events""")
def probability_cut(t):
    p = 1.0 / (1.0 + F.exp(-(F.col("value") - 40) / 10))
    return t.events.select("event_id", L.cut_probability(p).alias("positive"))
