"""Scalar functions, texts and vectors."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..functions import vectors as V
from ..operators import features as FE
from ..operators import report as R
from ..session import materialize
from .registry import query

TOKENS_SQL = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')"


def grams_sql(n: int) -> str:
    """Long table (doc_id, g) of the texts' n-word runs, with repeats."""
    words = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return (f"SELECT doc_id, {words} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i "
            f"FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents))")


BITS_SQL = f"""SELECT DISTINCT doc_id, CAST(CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS bit
    FROM ({grams_sql(1)} UNION ALL {grams_sql(2)})"""


@query("h1_negative_log", "SELECT event_id, round(-log10(value * 1e-9), 6) AS p FROM events")
def negative_log(t):
    return t.events.select("event_id", F.round(L.p_value(F.col("value")), 6).alias("p"))


@query("h2_unit_harmonization", """SELECT event_id, CASE WHEN event_type = 'view' THEN value * 1000 ELSE value END AS value
    FROM events""")
def unit_harmonization(t):
    unit = F.when(F.col("event_type") == "view", L.MICROMOLAR).otherwise(L.NANOMOLAR)
    return t.events.select("event_id", L.to_nanomolar(F.col("value"), unit).alias("value"))


LABEL_SQL = """SELECT event_id, CASE WHEN rel IN ('>', '>=') THEN 'inactive' WHEN rel IN ('<', '<=', '=', '~') THEN
      CASE WHEN p >= 8 THEN 'active' WHEN p > 7.5 THEN 'weak active' WHEN p > 7 THEN 'weak inactive' ELSE 'inactive' END END AS label
    FROM (SELECT event_id, 9 - log10(value) AS p, CASE event_type WHEN 'view' THEN '>' WHEN 'click' THEN '~' WHEN 'error' THEN NULL
      WHEN 'signup' THEN '?' ELSE '=' END AS rel FROM events)"""


def _labelled(t):
    kind = F.col("event_type")
    relation = (F.when(kind == "view", ">").when(kind == "click", "~").when(kind == "error", F.lit(None))
                .when(kind == "signup", "?").otherwise("="))
    label = L.activity_label(L.p_value(F.col("value")), relation, F.lit(7.5), F.lit(L.FIXED_BUFFER))
    return t.events.select("event_id", label.alias("label"))


@query("h3_activity_label", LABEL_SQL)
def activity_label(t):
    return _labelled(t)


@query("h4_binary_label", f"""SELECT event_id, CASE WHEN label IN ('active', 'weak active') THEN 1.0::DOUBLE
    WHEN label IN ('inactive', 'weak inactive') THEN 0.0::DOUBLE END AS any_label, CASE label WHEN 'active' THEN 1.0::DOUBLE
    WHEN 'inactive' THEN 0.0::DOUBLE END AS hard_label FROM ({LABEL_SQL})""")
def binary_label(t):
    return _labelled(t).select("event_id", L.binary_label(F.col("label")).alias("any_label"),
                               L.binary_label(F.col("label"), hard_only=True).alias("hard_label"))


@query("h5_three_class", """SELECT event_id, CASE WHEN p > 7.7 THEN 'active' WHEN p >= 7.2 THEN 'intermediate' ELSE 'inactive' END
    AS class FROM (SELECT event_id, 9 - log10(value) AS p FROM events)""")
def three_class(t):
    return t.events.select("event_id", L.three_class(L.p_value(F.col("value")), 7.7, 7.2).alias("class"))


@query("h6_percent", """SELECT source, CASE WHEN count(quality) = 0 THEN 0.0::DOUBLE ELSE
    round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(quality), 2) END AS percent_a
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def percent(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(
        L.percent(F.count_if(F.col("quality") == 1), F.count("quality")).alias("percent_a"))


@query("h7_row_text", """SELECT doc_id, 'doc_id:' || doc_id || ' lang:' || lang || ' quality:' || coalesce(quality::VARCHAR, '')
    AS description FROM documents LEFT JOIN labels USING (doc_id)""")
def row_text(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select("doc_id", X.row_text(["doc_id", "lang", "quality"]).alias("description"))


@query("h8_metadata_hash", """SELECT doc_id, md5(lang || source || coalesce(quality::VARCHAR, 'None') ||
    coalesce(toxic::VARCHAR, 'None')) AS metadata_hash FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_hash(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select("doc_id", X.field_hash(["lang", "source", "quality", "toxic"]).alias("metadata_hash"))


@query("h9_identifier_parts", """SELECT DISTINCT p_type || '_' || p_brand || '_' || replace(p_name, ' ', '_') AS name, p_type AS part0,
    split_part(p_name, ' ', 1) AS part2, p_type || '.' || p_brand AS prefix FROM part""")
def identifier_parts(t):
    name = F.concat_ws("_", "p_type", "p_brand", F.translate("p_name", " ", "_")).alias("name")
    rows = t.part.select(name).distinct()
    return rows.select("name", X.name_part(F.col("name"), 0).alias("part0"), X.name_part(F.col("name"), 2).alias("part2"),
                       F.array_join(F.slice(F.split("name", "_"), 1, 2), ".").alias("prefix"))


@query("h10_term_frequencies", """SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text),
    '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE w <> '' AND w NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'to', 'in', 'a')
    GROUP BY 1 ORDER BY n DESC, term LIMIT 50""")
def term_frequencies(t):
    return FE.term_frequencies(t.texts("text"), "text", ["the", "of", "and", "de", "la", "der", "to", "in", "a"], top=50)


def fingerprints(t, *columns: str):
    """Stored fingerprints of the documents that have any word; the text is read once and left behind."""
    bits = t.texts(*columns, "text").select("doc_id", *columns, X.fingerprint(F.col("text")).alias("bits"))
    return materialize(bits, "fingerprints").filter(F.size("bits") > 0)


@query("h11_hashed_fingerprint", f"""SELECT doc_id, count(*) AS n_bits, md5(string_agg(bit::VARCHAR, ',' ORDER BY bit)) AS signature
    FROM ({BITS_SQL}) GROUP BY 1""")
def hashed_fingerprint(t):
    return fingerprints(t).select("doc_id", F.size("bits").cast("long").alias("n_bits"), X.signature(F.col("bits")).alias("signature"))


@query("h11_count_fingerprint", f"""SELECT doc_id, CAST(CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS bit,
    count(*) AS n FROM ({grams_sql(1)} UNION ALL {grams_sql(2)}) GROUP BY 1, 2""")
def count_fingerprint(t):
    return FE.count_fingerprint(t.texts("text"), "doc_id", "text", 1024, (1, 2))


@query("h12_combined_fingerprint", f"""WITH a AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS h FROM ({grams_sql(1)})),
    b AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS h FROM ({grams_sql(2)}))
    SELECT doc_id, 'folded' AS mode, CAST(h % 512 AS INTEGER) AS bit, round(ln(1 + count(*)), 6) AS value
      FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 3
    UNION ALL SELECT doc_id, 'concatenated', CAST(h % 256 AS INTEGER), round(ln(1 + count(*)), 6) FROM a GROUP BY 1, 3
    UNION ALL SELECT doc_id, 'concatenated', CAST(256 + h % 256 AS INTEGER), round(ln(1 + count(*)), 6) FROM b GROUP BY 1, 3""")
def combined_fingerprint(t):
    kinds = [(1,), (2,)]
    both = FE.combine_fingerprints(t.texts("text"), "doc_id", "text", kinds, 512, {"folded": False, "concatenated": True})
    return both.withColumn("value", F.round("value", 6))


@query("h13_max_pooled_bits", f"""SELECT source, count(*) AS n_bits, CAST(sum(bit) AS BIGINT) AS bit_sum FROM (SELECT DISTINCT source, bit
    FROM ({BITS_SQL}) JOIN documents USING (doc_id)) GROUP BY 1""")
def max_pooled_bits(t):
    pooled = FE.max_pool_bits(fingerprints(t, "source"), ["source"], "bits")
    return pooled.groupBy("source").agg(F.count("*").alias("n_bits"), F.sum("bit").alias("bit_sum"))


@query("h14_vector_functions", """SELECT vec_id, round(1 / (1 + exp(-d)), 5) AS sigmoid, round(n, 5) AS norm, round(d / (n * n), 5) AS unit_dot
    FROM (SELECT vec_id, list_dot_product(e, e) AS d, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id,
      list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))""")
def vector_functions(t):
    e = F.col("embedding")
    unit = t.embeddings.select("vec_id", "embedding", V.normalize(e).alias("u"))
    return unit.select("vec_id", F.round(V.sigmoid(V.dot(e, e)), 5).alias("sigmoid"), F.round(V.norm(e), 5).alias("norm"),
                       F.round(V.dot(F.col("u"), F.col("u")), 5).alias("unit_dot"))


@query("h14_group_softmax", """SELECT event_id, round(exp((value - m) / 50) / sum(exp((value - m) / 50)) OVER (PARTITION BY user_id), 6) AS p
    FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events)""")
def group_softmax(t):
    rows = t.events.select("event_id", "user_id", (F.col("value") / 50).alias("z"))
    return FE.group_softmax(rows, ["user_id"], "z", "event_id").select("event_id", F.round("p", 6).alias("p"))


@query("h15_text_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents")
def text_length(t):
    return t.documents.select("doc_id", F.length("text").alias("length"))


@query("h16_config_key", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '","type":"' || p_type || '"}' AS config
    FROM part""")
def config_key(t):
    config = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand")
    return t.part.select("p_partkey", X.config_key(config).alias("config"))


@query("f1_order_by_count", """SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type""")
def order_by_count(t):
    return R.value_counts(t.part, ["p_type"])


@query("f2_multi_key_sort", """SELECT c_mktsegment, c_acctbal, c_custkey FROM customer
    ORDER BY c_mktsegment, c_acctbal DESC, c_custkey""")
def multi_key_sort(t):
    return (t.customer.select("c_mktsegment", "c_acctbal", "c_custkey")
            .orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey"))


@query("f3_frequent_values", """SELECT * FROM (SELECT 'gated' AS mode, p_name, count(*) AS n FROM part GROUP BY 2 HAVING count(*) >= 35
    UNION ALL (SELECT 'top', p_name, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, p_name LIMIT 10))""")
def frequent_values(t):
    return (R.frequent(t.part, "p_name", at_least=35).select(F.lit("gated").alias("mode"), "p_name", "n")
            .unionByName(R.frequent(t.part, "p_name", top=10).select(F.lit("top").alias("mode"), "p_name", "n")))


@query("f4_row_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 70 LIMIT 17")
def row_slice(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(70).limit(17)
