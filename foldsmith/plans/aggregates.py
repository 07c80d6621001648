"""Aggregations, pivots and report frames."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import report as R
from ..operators.categorize import apply_lookup, categorize, level_funnel, match_rules, selected
from ..operators.curate import consolidate, dataset_summary, threshold_stats
from ..operators.joins import gate_by_size, join_group_stats
from .entry_query import EVENTS_SQL, curated_events, measurements
from ..session import materialize
from .predicates import DOC_RULES, RULE_SQL
from .registry import query


@query("d1_distinct_items", """SELECT l_suppkey, l_returnflag, l_linenumber, count(DISTINCT l_partkey) AS n_items
    FROM lineitem GROUP BY 1, 2, 3""")
def distinct_items(t):
    return (t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linenumber")
            .agg(F.countDistinct("l_partkey").alias("n_items")))


@query("d2_distinct_after_join", """SELECT p_brand, s_nationkey, l_returnflag, count(DISTINCT l_orderkey) AS n_items
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""")
def distinct_after_join(t):
    rows = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    return rows.groupBy("p_brand", "s_nationkey", "l_returnflag").agg(F.countDistinct("l_orderkey").alias("n_items"))


@query("d3_second_level_rollup", """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_assays, CAST(sum(cnt) AS BIGINT) AS n_items
    FROM (SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS cnt FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def second_level_rollup(t):
    per = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_orderkey").alias("cnt"))
    # a part is one row of its supplier here, so rows are counted and no second table of distinct parts is held
    return per.groupBy("l_suppkey").agg(F.count("l_partkey").alias("n_assays"), F.sum("cnt").alias("n_items"))


@query("d4_value_counts", "SELECT text, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, text")
def value_counts(t):
    return R.value_counts(t.documents, ["text"])


@query("d5_group_size_gate", """SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (
    SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 25 AND 40)""")
def group_size_gate(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber")
    return gate_by_size(rows, ["l_partkey"], ["l_orderkey", "l_linenumber"], 25, 40)


def doc_lookup(t):
    """Id lists for the documents: short marked texts are listed, long ones excluded."""
    ids = F.concat(F.lit("d"), "doc_id")
    base = t.documents.select(F.col("source").alias("target"), F.col("lang").alias("std_type"), ids.alias("assay_id"),
                              "n_chars")
    plus = base.filter("n_chars < 300").select("target", "std_type", "assay_id", F.lit("plus").alias("action"))
    out = base.filter("n_chars > 6000").select("target", "std_type", "assay_id", F.lit("exclude").alias("action"))
    return plus.unionByName(out).select("target", F.lit("bind").alias("effect"), F.lit("plain").alias("assay"),
                                        "std_type", "action", "assay_id")


def doc_hits(t):
    docs = t.documents.select("doc_id", "lang", "source", "text", F.concat(F.lit("d"), "doc_id").alias("ref"))
    hits = match_rules(docs, DOC_RULES, "text", "lang").drop("text")
    return docs, apply_lookup(hits, doc_lookup(t), "source", "lang", "ref", "doc_id")


HITS_SQL = f"""WITH r AS ({RULE_SQL}), hits AS (SELECT r.*, r.assay = 'plain' AND n_chars < 300 AS plus,
    r.assay = 'plain' AND n_chars > 6000 AS excluded FROM r JOIN documents USING (doc_id))"""


@query("d6_level_funnel", HITS_SQL + """, per AS (SELECT source, effect, assay, lang, doc_id,
      count(*) FILTER (matched) AS matched, count(*) FILTER (plus) AS plus, count(*) FILTER (excluded) AS excluded,
      count(*) FILTER ((matched OR plus) AND NOT excluded) AS mhd FROM hits GROUP BY ALL),
    st AS (SELECT source, effect, assay, lang, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(plus) AS BIGINT) AS plus,
      CAST(sum(excluded) AS BIGINT) AS excluded, CAST(sum(mhd) AS BIGINT) AS mhd FROM per GROUP BY ALL)
    SELECT st.*, CAST(mhd AS BIGINT) AS lhd, CAST(mhd AS BIGINT) AS n_lhd, hhd FROM st
    JOIN (SELECT source, lang, count(*) AS hhd FROM documents GROUP BY 1, 2) USING (source, lang)""")
def funnel(t):
    docs, hits = doc_hits(t)
    return level_funnel(docs, hits, "source", "lang", "ref", low=1, high=1)


@query("g5_match_plus_exclude", HITS_SQL + """SELECT doc_id, effect, assay FROM hits WHERE matched AND NOT excluded
    UNION ALL SELECT doc_id, effect, assay FROM hits WHERE plus AND NOT excluded""")
def match_plus_exclude(t):
    return selected(doc_hits(t)[1], dedupe=False).select("doc_id", "effect", "assay")


@query("i1_categorize", HITS_SQL + """, sel AS (SELECT * FROM hits WHERE (matched OR plus) AND NOT excluded),
    lev AS (SELECT doc_id, 'hhd' AS level, source AS target, CAST(NULL AS VARCHAR) AS effect, CAST(NULL AS VARCHAR) AS assay,
        lang AS std_type, CAST(NULL AS VARCHAR) AS assay_id FROM documents
      UNION ALL SELECT doc_id, 'mhd', source, effect, assay, lang, NULL FROM sel
      UNION ALL SELECT DISTINCT doc_id, 'mhd-effect', source, effect, NULL, NULL, NULL FROM sel
      UNION ALL SELECT doc_id, 'lhd', source, effect, assay, lang, 'b' || (doc_id % 3) FROM sel
        QUALIFY count(*) OVER (PARTITION BY source, effect, assay, lang, doc_id % 3) BETWEEN 4 AND 5000)
    SELECT doc_id AS row_id, * EXCLUDE (doc_id) FROM lev""")
def categorize_documents(t):
    # three assay ids per source; the id lists name documents
    docs = t.documents.select("doc_id", "lang", "source", "text", F.concat(F.lit("d"), "doc_id").alias("ref"),
                              F.concat(F.lit("b"), F.col("doc_id") % 3).alias("assay_id"))
    return categorize(docs, DOC_RULES, doc_lookup(t), "doc_id", "source", "lang", "assay_id", "text", low=4, high=5000,
                      lookup_id="ref")


@query("d7_median_and_deviation", """SELECT event_type, count(*) AS n, round(median(value), 6) AS median,
    round(stddev_samp(value), 6) AS std FROM events GROUP BY 1""")
def median_and_deviation(t):
    return threshold_stats(t.events, ["event_type"], "value").select(
        "event_type", "n", F.round("median", 6).alias("median"), F.round("std", 6).alias("std"))


@query("d8_consolidate", """SELECT l_partkey, l_suppkey, round(avg(l_quantity), 6) AS l_quantity,
    arg_min(l_returnflag, (l_orderkey, l_linenumber, l_extendedprice)) AS l_returnflag, min(l_orderkey) AS l_orderkey FROM lineitem
    GROUP BY 1, 2 HAVING stddev_samp(l_quantity) IS NULL OR stddev_samp(l_quantity) <= 5""")
def consolidate_lines(t):
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_orderkey", "l_linenumber",
                             "l_extendedprice")
    out = consolidate(rows, ["l_partkey", "l_suppkey"], "l_quantity", ["l_orderkey", "l_linenumber", "l_extendedprice"],
                      max_std=5.0)
    return out.select("l_partkey", "l_suppkey", F.round("l_quantity", 6).alias("l_quantity"), "l_returnflag", "l_orderkey")


@query("d9_dataset_summary", EVENTS_SQL + """
    SELECT dataset, count(*) AS size_all, count(*) FILTER (NOT sib) AS size_alone, max(weight) AS max_weight,
      CASE WHEN count(*) < 50 THEN 's50' ELSE 'b50' END AS level_all, count(*) FILTER (va = 1 AND NOT sib) AS vs_active_alone,
      count(*) FILTER (la = 1 AND NOT sib) AS lo_active_alone, count(*) FILTER (va = 0) AS vs_inactive_all,
      count(*) FILTER (la = 0) AS lo_inactive_all, any_value(raw_size) AS raw_size, any_value(raw_size) - count(*) AS removed_size
    FROM cur JOIN (SELECT event_type AS dataset, count(*) AS raw_size FROM events GROUP BY 1) USING (dataset) GROUP BY 1""")
def summary(t):
    raw = t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("raw_size"))
    return dataset_summary(curated_events(t), ["dataset"], raw).select(
        "dataset", "size_all", "size_alone", "max_weight", "level_all", "vs_active_alone", "lo_active_alone",
        "vs_inactive_all", "lo_inactive_all", "raw_size", "removed_size")


@query("d10_group_max_on_rows", """SELECT event_id, event_type, max(value) OVER (PARTITION BY event_type) AS max_value FROM events""")
def group_max_on_rows(t):
    stats = materialize(t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value")), "maxima")
    return join_group_stats(t.events.select("event_id", "event_type"), stats, ["event_type"], ["event_id"]).drop("n")


@query("d11_nunique_and_ratio", """SELECT source, count(DISTINCT lang) AS n_lang, avg(CAST(quality AS DOUBLE)) AS active_ratio
    FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def nunique_and_ratio(t):
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(
        F.countDistinct("lang").alias("n_lang"), F.avg(F.col("quality").cast("double")).alias("active_ratio"))


@query("d12_missing_share", """SELECT * FROM (SELECT 'quality' AS "column", avg(CAST(quality IS NULL AS INTEGER)) AS missing FROM
      documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'toxic', avg(CAST(toxic IS NULL AS INTEGER)) FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'lang', avg(CAST(lang IS NULL AS INTEGER)) FROM documents)""")
def missing_share(t):
    return R.missing_share(t.documents.join(t.labels, "doc_id", "left").select("quality", "toxic", "lang"))


@query("d13_describe", """SELECT lang, count(n_chars) AS count, avg(n_chars) AS mean, round(stddev_samp(n_chars), 6) AS std,
    min(n_chars) AS min, max(n_chars) AS max, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50,
    quantile_cont(n_chars, 0.75) AS q75 FROM documents GROUP BY 1""")
def describe(t):
    return R.describe(t.documents, ["lang"], "n_chars").withColumn("std", F.round("std", 6))


@query("d14_multi_valued", """SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem
    GROUP BY 1, 2, 3 QUALIFY sum(count(*)) OVER (PARTITION BY l_partkey, l_suppkey) > 1""")
def multi_valued(t):
    return R.multi_valued(t.lineitem, ["l_partkey", "l_suppkey"], "l_returnflag")


@query("d15_crosstab_frequent", """SELECT k, event_type, count(*) AS n
    FROM (SELECT json_extract_string(props, '$.k') AS k, event_type FROM events) GROUP BY k, event_type
    QUALIFY sum(count(*)) OVER (PARTITION BY k) >= 100""")
def crosstab_frequent(t):
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return gate_by_size(rows, ["k"], ["event_id"], low=100).groupBy("k", "event_type").agg(F.count("*").alias("n"))


@query("d16_pivot_mean", """SELECT l_linenumber, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A,
    round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R
    FROM lineitem GROUP BY 1""")
def pivot_mean(t):
    return R.pivot_mean(t.lineitem, ["l_linenumber"], "l_returnflag", ["A", "N", "R"], "l_quantity")


@query("d17_parent_child_matrix", """SELECT c_mktsegment AS parent, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS F,
    round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS P
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def parent_child_matrix(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return R.pivot_mean(rows.withColumnRenamed("c_mktsegment", "parent"), ["parent"], "o_orderstatus", ["F", "O", "P"],
                        "o_totalprice")


@query("d18_nested_shares", """SELECT p_type, p_brand, CAST(grouping(p_type, p_brand) AS BIGINT) AS depth,
    CAST(sum(p_size) AS BIGINT) AS total, sum(p_size) / (SELECT CAST(sum(p_size) AS DOUBLE) FROM part) AS share
    FROM part GROUP BY ROLLUP (p_type, p_brand)""")
def nested_shares(t):
    return R.shares(t.part, "p_type", "p_brand", "p_size")


@query("d19_mean_by_category", """SELECT lang, quality, toxic FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN (
    SELECT lang, coalesce(avg(CAST(quality AS DOUBLE)), 0) AS quality, coalesce(avg(CAST(toxic AS DOUBLE)), 0) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 12000 GROUP BY 1) USING (lang)""")
def mean_by_category(t):
    rows = t.documents.join(t.labels, "doc_id", "left").filter("n_chars > 12000").select(
        "lang", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return R.mean_by_category(rows, "lang", t.documents.select("lang").distinct(), ["quality", "toxic"])


@query("d20_histogram", """SELECT event_type, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21
    ELSE floor(value / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2""")
def histogram(t):
    return R.histogram(t.events, ["event_type"], "value", 0.0, 200.0, 20)


@query("d21_grid_counts", """SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x_bin, CAST(floor(l_discount * 100 / 5) AS BIGINT) AS y_bin,
    count(*) AS n FROM lineitem GROUP BY 1, 2""")
def grid_counts(t):
    return R.grid_counts(t.lineitem, F.col("l_quantity"), F.col("l_discount") * 100, 5)


@query("d22_box_summary", """WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low_whisker,
      max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high_whisker,
      count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM events JOIN b USING (event_type) GROUP BY event_type, q1, median, q3""")
def box_summary(t):
    out = R.box_summary(t.events, ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("d23_nan_mean", """SELECT event_type, round(avg(CASE WHEN value > 5 THEN ln(value - 5) END), 6) AS score
    FROM events GROUP BY 1""")
def nan_mean(t):
    score = F.when(F.col("value") > 5, F.log(F.col("value") - 5)).otherwise(F.lit(float("nan")))
    out = R.nan_mean(t.events.withColumn("score", score), ["event_type"], ["score"])
    return out.withColumn("score", F.round("score", 6))


@query("d24_most_frequent_config", """SELECT user_id, props FROM (SELECT user_id, props, count(*) AS n, min(event_id) AS f
    FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def most_frequent_config(t):
    return R.most_frequent(t.events, ["user_id"], "props", "event_id")


@query("d29_count_and_positives", """SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives
    FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def count_and_positives(t):
    return t.documents.join(t.labels, "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.sum("quality").alias("positives"))


@query("d39_lost_values", """SELECT DISTINCT p_name FROM part WHERE p_brand = 'Brand#1' AND p_name NOT IN (
    SELECT p_name FROM part WHERE p_brand = 'Brand#2')""")
def lost_values(t):
    return R.lost_values(t.part.filter("p_brand = 'Brand#1'"), t.part.filter("p_brand = 'Brand#2'"), "p_name")


@query("d40_size_buckets", """SELECT user_id, count(*) AS n, CASE WHEN count(*) < 50 THEN 's50' ELSE 'b50' END AS level_all,
    CASE WHEN count(*) FILTER (value > 20) < 50 THEN 's50' ELSE 'b50' END AS level_some FROM events GROUP BY 1""")
def size_buckets(t):
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), L.size_level(F.count("*")).alias("level_all"),
        L.size_level(F.count_if(F.col("value") > 20)).alias("level_some"))


@query("d27_mean_vectors", """SELECT label, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean
    FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2""")
def mean_vectors(t):
    packed = R.mean_vectors(t.embeddings, ["label"], "embedding")
    cells = packed.select("label", F.posexplode("embedding").alias("dim", "mean"))
    return cells.select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("d30_median_vectors", """SELECT label, i - 1 AS dim, round(median(CAST(embedding[i] AS DOUBLE)), 6) AS median
    FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2""")
def median_vectors(t):
    out = R.median_vectors(t.embeddings, ["label"], "embedding")
    return out.select("label", F.col("dim").cast("long").alias("dim"), F.round("median", 6).alias("median"))


@query("i2_clean", """SELECT event_id, event_type AS dataset, value * 1000 AS standard_value, CASE k % 10 WHEN 0 THEN '>' WHEN 2 THEN '~'
    ELSE '=' END AS standard_relation FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
    WHERE value > 0 AND k % 10 <> 1""")
def clean(t):
    return measurements(t).select("event_id", "dataset", "standard_value", "standard_relation")


@query("i29_compare_runs", """SELECT event_type, count(*) AS n, round(avg(c - p), 6) AS mean_gap, avg(ps - cs) AS mean_size_diff,
    count(*) FILTER (c - p > 0.2) AS child_wins, count(*) FILTER (c - p < -0.2) AS parent_wins
    FROM (SELECT event_type, user_id % 10 AS g, avg(value) / 100 AS p, count(*) AS ps FROM events GROUP BY 1, 2)
    JOIN (SELECT event_type, user_id % 10 AS g, user_id, avg(value) / 100 AS c, count(*) AS cs FROM events GROUP BY 1, 2, 3)
    USING (event_type, g) GROUP BY 1""")
def compare_runs(t):
    g = (F.col("user_id") % 10).alias("g")
    parent = t.events.groupBy("event_type", g).agg((F.avg("value") / 100).alias("parent_score"),
                                                   F.count("*").alias("parent_size"))
    child = t.events.groupBy("event_type", g, "user_id").agg((F.avg("value") / 100).alias("child_score"),
                                                             F.count("*").alias("child_size"))
    out = R.compare_runs(parent.join(child, ["event_type", "g"]), ["event_type"], "score")
    return out.withColumn("mean_gap", F.round("mean_gap", 6))
