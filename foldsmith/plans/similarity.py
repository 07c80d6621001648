"""Similarity joins, siblings, neighbours and dense scores."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curate as C
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators import report as R
from ..operators import similarity as S
from ..session import materialize
from .functions import BITS_SQL, TOKENS_SQL, fingerprints
from .registry import query

SETS_SQL = f"""g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tok FROM (SELECT doc_id, w,
      unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents))),
    sig AS (SELECT doc_id, md5(string_agg(tok, '|' ORDER BY tok)) AS sig, count(*) AS size FROM g GROUP BY 1),
    reps AS (SELECT min(doc_id) AS doc_id, any_value(size) AS size FROM sig GROUP BY sig)"""


def with_copies(found):
    """Edges between representatives, and the link of every copy to its own."""
    return found["edges"].unionByName(S.copy_links(found["members"])).withColumn("sim", F.round("sim", 6))


def document_sets(t):
    return t.texts("text")


def document_edges(t, min_sim: float = 0.35):
    return S.similarity_join(document_sets(t), "doc_id", X.shingle_hashes(F.col("text")), min_sim)


@query("c10_similarity_join", f"""WITH {SETS_SQL}, gr AS (SELECT doc_id, tok FROM g SEMI JOIN reps USING (doc_id)),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM gr x JOIN gr y ON x.tok = y.tok AND x.doc_id < y.doc_id GROUP BY 1, 2)
    SELECT a, b, round(n / (ra.size + rb.size - n), 6) AS sim FROM o JOIN reps ra ON ra.doc_id = a JOIN reps rb ON rb.doc_id = b
    WHERE n / (ra.size + rb.size - n) >= 0.35 UNION ALL
    SELECT a, b, CAST(1 AS DOUBLE) FROM (SELECT min(doc_id) OVER (PARTITION BY sig) AS a, doc_id AS b FROM sig) WHERE a <> b""")
def similarity_join(t):
    return with_copies(document_edges(t))


def urls(t):
    """Page addresses with their character trigrams, and their templates with digits folded to 0."""
    def trigrams(c):
        n = F.length(c) - 2
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.substring(c, i, F.lit(3)))))
    template = F.regexp_replace(F.lower("url"), "[0-9]+", "0")
    return t.pages.select("page_id", "url", trigrams(F.col("url")).alias("grams"), trigrams(template).alias("shape"))


def jaccard_sql(expr: str, bound: float) -> str:
    """Pairs of distinct trigram sets of ``expr`` over the pages, lowest page id standing for equal sets, which it is paired with."""
    return f"""(WITH t AS (SELECT page_id, list_sort(list_distinct(list_transform(range(1, greatest(length(u) - 2, 1) + 1),
        lambda i: substr(u, i, 3)))) AS s FROM (SELECT page_id, {expr} AS u FROM pages)), r AS (SELECT min(page_id) AS id, s FROM t GROUP BY s)
      SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS sim
      FROM r x JOIN r y ON x.id < y.id
      WHERE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= {bound}
      UNION ALL SELECT r.id, t.page_id, CAST(1 AS DOUBLE) FROM t JOIN r ON t.s = r.s WHERE t.page_id <> r.id)"""


TEMPLATE = "regexp_replace(lower(url), '[0-9]+', '0', 'g')"


@query("c11_template_similarity", f"SELECT a, b, round(sim, 6) AS sim FROM {jaccard_sql(TEMPLATE, 0.6)}")
def template_similarity(t):
    return with_copies(S.similarity_join(urls(t), "page_id", F.col("shape"), 0.6))


EDIT_SQL = """(WITH r AS (SELECT min({id}) AS id, {text} AS s FROM {table} GROUP BY {text})
    SELECT x.id AS a, y.id AS b, 1 - levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s)) AS sim FROM r x JOIN r y ON x.id < y.id
    AND abs(length(x.s) - length(y.s)) <= (1 - {bound}) * greatest(length(x.s), length(y.s)) + 1e-9
    WHERE levenshtein(x.s, y.s) <= floor((1 - {bound}) * greatest(length(x.s), length(y.s)) + 1e-9)
    UNION ALL SELECT r.id, t.{id}, CAST(1 AS DOUBLE) FROM {table} t JOIN r ON t.{text} = r.s WHERE t.{id} <> r.id)"""


@query("c12_edit_distance_join", "SELECT a, b, round(sim, 6) AS sim FROM " + EDIT_SQL.format(id="c_custkey", text="c_name", table="customer", bound=0.9))
def edit_distance_join(t):
    return with_copies(S.edit_similarity_join(t.customer, "c_custkey", "c_name", 0.9))


@query("c13_similar_by_any", f"""SELECT a, b FROM {jaccard_sql('url', 0.8)} UNION SELECT a, b FROM {jaccard_sql(TEMPLATE, 0.8)}
    UNION SELECT a, b FROM {EDIT_SQL.format(id='page_id', text='url', table='pages', bound=0.8)}""")
def similar_by_any(t):
    pages = urls(t)
    # the shuffle files of one measure go before the next begins
    return S.similar_by_any(materialize(with_copies(S.similarity_join(pages, "page_id", F.col("grams"), 0.8)), "gram-pairs"),
                            materialize(with_copies(S.similarity_join(pages, "page_id", F.col("shape"), 0.8)), "shape-pairs"),
                            with_copies(S.edit_similarity_join(pages, "page_id", "url", 0.8)))


@query("c14_equivalence_siblings", f"""SELECT doc_id, lang, count(*) OVER (PARTITION BY lang, sig) > 1 AS has_sibling FROM (
    SELECT doc_id, md5(string_agg(bit::VARCHAR, ',' ORDER BY bit)) AS sig FROM ({BITS_SQL}) GROUP BY 1) JOIN documents USING (doc_id)""")
def equivalence_siblings(t):
    signed = fingerprints(t, "lang").select("doc_id", "lang", X.signature(F.col("bits")).alias("sig"))
    return C.flag_siblings(signed, ["lang"], "sig", "doc_id").drop("sig")


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


VEC_SQL = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings)"


@query("c15_assign_nearest", f"""WITH {VEC_SQL} SELECT o.id, arg_min(m.label, (list_distance(o.e, m.e), m.id)) AS label,
    round(min(list_distance(o.e, m.e)), 6) AS distance FROM v o JOIN v m ON o.label >= 7 AND m.label < 7 GROUP BY 1""")
def assign_nearest(t):
    v = vectors(t)
    out = N.assign_nearest(v.filter("label >= 7").drop("label"), v.filter("label < 7"), "label")
    return out.withColumn("distance", F.round("distance", 6))


@query("c16_nearest_neighbors", f"""WITH {VEC_SQL} SELECT q.id AS query_id, b.id AS neighbor_id, round(list_distance(q.e, b.e), 6) AS distance,
    CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, b.e), b.id) AS INTEGER) AS rank FROM v q JOIN v b ON q.id <> b.id
    QUALIFY rank <= 5""")
def nearest_neighbors(t):
    v = vectors(t).select("id", "vec")
    return N.knn_join(v, v, 5, skip_self=True).withColumn("distance", F.round("distance", 6))


PROTO_SQL = VEC_SQL + """, p AS (SELECT label AS gid, list(m ORDER BY i) AS pe FROM (SELECT label, i, avg(e[i]) AS m FROM
    (SELECT label, e, unnest(range(1, 65)) AS i FROM v) GROUP BY 1, 2) GROUP BY 1)"""


def prototypes(t):
    means = R.mean_vectors(t.embeddings, ["label"], "embedding")
    return means.select(F.col("label").alias("gid"), F.col("embedding").alias("group_vec"))


@query("c17_dense_scores", f"""WITH {PROTO_SQL} SELECT id, gid, round(list_cosine_similarity(e, pe), 5) AS score FROM v JOIN p ON true""")
def dense_scores(t):
    return N.dense_scores(vectors(t), prototypes(t), "id", "gid").withColumn("score", F.round("score", 5))


@query("c17_best_groups", f"""WITH {PROTO_SQL}, s AS (SELECT id, gid, list_cosine_similarity(e, pe) AS score FROM v JOIN p ON true)
    SELECT id, gid, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, gid) AS INTEGER) AS rank FROM s
    QUALIFY rank <= 3""")
def best_groups(t):
    return N.best_groups(vectors(t), prototypes(t), 3, "id", "gid").withColumn("score", F.round("score", 5))


@query("c17_best_products", f"""WITH {VEC_SQL}, x AS (SELECT id, list_transform(e, lambda y: y * (1 + id % 4)) AS e FROM v)
    SELECT q.id, b.id AS gid, round(list_dot_product(q.e, b.e), 5) AS score,
      CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.e, b.e) DESC, b.id) AS INTEGER) AS rank FROM v q JOIN x b ON true
    QUALIFY rank <= 4""")
def best_products(t):
    # lengths from 1 to 4, so that the best product is seldom the nearest vector
    long = vectors(t).select(F.col("id").alias("gid"), F.transform("vec", lambda y: y.cast("double") * (1 + F.col("id") % 4)).alias("group_vec"))
    return N.best_groups(vectors(t), long, 4, "id", "gid", unit=False).withColumn("score", F.round("score", 5))


@query("c17_pair_scores", f"""WITH {PROTO_SQL} SELECT id, gid, round(list_cosine_similarity(e, pe), 5) AS score FROM v JOIN p ON gid = (label + 1) % 10""")
def pair_scores(t):
    links = vectors(t).select("id", ((F.col("label") + 1) % 10).alias("gid"))
    return N.score_pairs(links, vectors(t), prototypes(t), "id", "gid").withColumn("score", F.round("score", 5))


@query("d35_topk_accuracy", f"""WITH {PROTO_SQL}, s AS (SELECT id, label, gid, round(list_cosine_similarity(e, pe), 9) AS score FROM v JOIN p ON true),
    r AS (SELECT x.id, x.label, 1 + count(*) FILTER (s.gid <> x.label AND s.score >= x.score) AS rank FROM s x JOIN s USING (id)
      WHERE x.gid = x.label GROUP BY 1, 2)
    SELECT label, count(*) AS n, avg(rank) AS mean_rank, avg(CAST(rank <= 1 AS DOUBLE)) AS top1, avg(CAST(rank <= 3 AS DOUBLE)) AS top3,
      median(rank) AS median_rank FROM r GROUP BY 1""")
def topk_accuracy(t):
    ranks = N.truth_ranks(vectors(t), prototypes(t), "id", "label", "gid").join(vectors(t).select("id", "label"), "id")
    return M.rank_accuracy(ranks, ["label"], "rank", ks=(1, 3))


@query("i21_smote")
def smote(t):
    rows = t.embeddings.select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"))
    return N.smote(rows, "vec_id", "embedding", "y", k=5)


@query("i21_tomek_links", f"""WITH {VEC_SQL}, n AS (SELECT q.id AS a, arg_min(b.id, (list_distance(q.e, b.e), b.id)) AS b, q.label % 2 AS la
    FROM v q JOIN v b ON q.id <> b.id GROUP BY q.id, q.label)
    SELECT x.a, x.b, CAST(x.la AS INTEGER) AS a_label, CAST(y.la AS INTEGER) AS b_label FROM n x JOIN n y ON x.b = y.a AND y.b = x.a
    WHERE x.a < x.b AND x.la <> y.la""")
def tomek_links(t):
    rows = t.embeddings.select("vec_id", "embedding", (F.col("label") % 2).alias("y"))
    return N.tomek_links(rows, "vec_id", "embedding", "y")
