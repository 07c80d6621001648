"""Splits, their audits and id encodings."""

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import metrics as M
from ..operators import rank as K
from ..operators import splits as S
from ..session import materialize
from .registry import query

ROWS_SQL = """rows AS (SELECT event_id AS id, event_type AS ds, CASE WHEN value > 25 THEN 1 ELSE 0 END AS y,
    json_extract_string(props, '$.k') = '7' AS sib FROM events)"""


def labelled(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("ds"),
                           (F.col("value") > 25).cast("int").alias("y"),
                           (F.get_json_object("props", "$.k") == "7").alias("sib"))


def folds_sql(source: str = "rows", extra: str = "", seed: int = 42, k: int = 5) -> str:
    """Test fold of each row: dealt out by rank in md5 order within (dataset, class)."""
    keys = f"ds{extra}"
    return f"""(SELECT {keys}, id, y, sib, least({k}, min(cnt) OVER (PARTITION BY {keys})) AS k,
      (row_number() OVER (PARTITION BY {keys}, y ORDER BY md5('{seed}:' || id)) - 1) AS rk
      FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, y) AS cnt FROM {source}))"""


ASSIGN_SQL = f"""WITH {ROWS_SQL}, folds AS (SELECT ds, id, y, sib, k, rk % k AS tf FROM {folds_sql()} WHERE k >= 2),
    a AS (SELECT ds, id, y, sib, CAST(f AS INTEGER) AS fold, CASE WHEN f = tf THEN 'test' ELSE 'train' END AS role
      FROM (SELECT *, unnest(range(0, k)) AS f FROM folds))"""


@query("i8_stratified_kfold", ASSIGN_SQL + " SELECT ds, id, fold, role FROM a")
def stratified_kfold(t):
    return S.stratified_kfold(labelled(t), ["ds"], "id", "y")


@query("i14_sibling_variants", f"""WITH {ROWS_SQL}, alone AS (SELECT * FROM rows WHERE NOT sib),
    f AS (SELECT ds, id, k, rk % k AS tf, false AS drop_siblings FROM {folds_sql()} WHERE k >= 2
      UNION ALL SELECT ds, id, k, rk % k, true FROM {folds_sql('alone')} WHERE k >= 2)
    SELECT ds, drop_siblings, tf AS fold, count(*) AS n_test FROM f GROUP BY ALL""")
def sibling_variants(t):
    both = S.sibling_variants(labelled(t), lambda rows: S.stratified_kfold(rows, ["ds"], "id", "y"), "sib")
    return (both.filter("role = 'test'").groupBy("ds", "drop_siblings", F.col("fold").cast("long").alias("fold"))
            .agg(F.count("*").alias("n_test")))


@query("d37_fold_audit", ASSIGN_SQL + " SELECT ds, fold, role, count(*) AS n FROM a GROUP BY ALL")
def fold_audit(t):
    return S.fold_audit(S.stratified_kfold(labelled(t), ["ds"], "id", "y"), ["ds"])


SCHEMES_SQL = ASSIGN_SQL + """, s AS (SELECT ds, 'rs' AS scheme, fold FROM a UNION ALL SELECT ds, 'long', fold FROM a
    WHERE ds IN ('click', 'view') UNION ALL SELECT ds, 'short', fold FROM a WHERE fold < 3)"""


def schemes(t):
    a = S.stratified_kfold(labelled(t), ["ds"], "id", "y")
    return (a.withColumn("scheme", F.lit("rs"))
            .unionByName(a.filter("ds IN ('click', 'view')").withColumn("scheme", F.lit("long")))
            .unionByName(a.filter("fold < 3").withColumn("scheme", F.lit("short"))))


@query("d38_schemes_available", SCHEMES_SQL + """ SELECT ds, count(DISTINCT fold) FILTER (scheme = 'rs') AS folds_rs,
    count(DISTINCT fold) FILTER (scheme = 'long') AS folds_long, count(DISTINCT fold) FILTER (scheme = 'short') AS folds_short
    FROM s GROUP BY 1""")
def schemes_available(t):
    return S.schemes_available(schemes(t), ["ds"], ["rs", "long", "short"])


@query("b19_folds_per_scheme", SCHEMES_SQL + " SELECT scheme, count(DISTINCT fold) AS n_folds FROM s GROUP BY 1")
def folds_per_scheme(t):
    return schemes(t).groupBy("scheme").agg(F.countDistinct("fold").alias("n_folds"))


@query("d25_fold_balance", ASSIGN_SQL + """ SELECT ds, fold, least(count(*) FILTER (role = 'train' AND y = 1),
    count(*) FILTER (role = 'train' AND y = 0)) AS train_min, least(count(*) FILTER (role = 'test' AND y = 1),
    count(*) FILTER (role = 'test' AND y = 0)) AS test_min FROM a GROUP BY 1, 2""")
def fold_balance(t):
    rows = labelled(t)
    a = S.stratified_kfold(rows, ["ds"], "id", "y").join(rows.select("id", "y"), "id")
    return S.fold_balance(a, ["ds"], "y")


@query("d26_best_fold", """SELECT u AS ds, coalesce(arg_max(f, (tr + te, -f)) FILTER (tr >= 2 AND te >= 2), min(f)) AS best_fold FROM (
    SELECT user_id AS u, event_id % 3 AS f, least(count(*) FILTER (value > 60), count(*) FILTER (value <= 60)) AS te,
      least(count(*) FILTER (value > 30), count(*) FILTER (value <= 30)) AS tr FROM events GROUP BY 1, 2) WHERE tr > 0 AND te > 0 GROUP BY 1""")
def best_fold(t):
    f = (F.col("event_id") % 3).alias("fold")
    balance = t.events.groupBy(F.col("user_id").alias("ds"), f).agg(
        F.least(F.count_if(F.col("value") > 30), F.count_if(F.col("value") <= 30)).alias("train_min"),
        F.least(F.count_if(F.col("value") > 60), F.count_if(F.col("value") <= 60)).alias("test_min"))
    return S.best_fold(balance.filter("train_min > 0 AND test_min > 0"), ["ds"])


@query("i16_nested_splits", ASSIGN_SQL + f""", tr AS (SELECT ds, fold AS outer_fold, id, y, sib FROM a WHERE role = 'train'),
    nf AS (SELECT ds, outer_fold, id, k, rk % k AS tf FROM {folds_sql('tr', ', outer_fold', seed=42, k=5)} WHERE k >= 2)
    SELECT ds, outer_fold, CAST(f AS INTEGER) AS fold, count(*) FILTER (f = tf) AS n_test, count(*) FILTER (f <> tf) AS n_train,
      CAST(sum(id) FILTER (f = tf) AS BIGINT) AS id_sum FROM (SELECT *, unnest(range(0, k)) AS f FROM nf) GROUP BY 1, 2, 3""")
def nested_splits(t):
    rows = labelled(t)
    outer = materialize(S.stratified_kfold(rows, ["ds"], "id", "y"), "outer-folds")
    inner = S.nested_splits(outer, rows, ["ds"], "id", "y")["inner"]
    test = F.col("role") == "test"
    return inner.groupBy("ds", "outer_fold", "fold").agg(
        F.count_if(test).alias("n_test"), F.count_if(~test).alias("n_train"), F.sum(F.when(test, F.col("id"))).alias("id_sum"))


@query("i17_holdout_by_group", """WITH pool AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id)) - 1 AS r,
      count(*) OVER () AS n FROM events WHERE event_type <> 'signup')
    SELECT e.event_id, event_type, CASE WHEN event_type = 'signup' THEN 'test' WHEN r < greatest(1, n // 101) THEN 'valid'
      ELSE 'train' END AS role FROM events e LEFT JOIN pool USING (event_id)""")
def holdout_by_group(t):
    return S.holdout_by_group(t.events, "event_type", F.col("event_type") == "signup", "event_id")


@query("i17_holdout_whole_groups", """WITH pool AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id)) - 1 AS r,
      count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id >= 10))
    SELECT event_id, user_id, CASE WHEN user_id < 10 THEN 'test' WHEN r < greatest(1, n // 11) THEN 'valid'
      ELSE 'train' END AS role FROM events LEFT JOIN pool USING (user_id)""")
def holdout_whole_groups(t):
    return S.holdout_by_group(t.events, "user_id", F.col("user_id") < 10, "event_id", ratio=10, by_group=True)


@query("i18_ordered_split", """SELECT o_orderkey, CASE WHEN r < c1 THEN 'train' WHEN r < c1 + round_even((n - c1) / 2, 0) THEN 'valid'
    ELSE 'test' END AS role FROM (SELECT *, round_even(0.6 * n, 0) AS c1 FROM (SELECT o_orderkey,
      row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), md5('0:' || o_orderkey)) - 1 AS r, count(*) OVER () AS n FROM orders))""")
def ordered_split(t):
    ranked = K.distributed_rank(t.orders, [], by_day(F.col("o_orderdate"), "o_orderkey"), [F.col("o_orderkey")], digits=10)
    return S.ordered_split(ranked, "rank").select("o_orderkey", "role")


def by_day(day, row_id):
    """Day, then the seeded order within it: a busy day is still cut in 256 buckets by the two digits after the day."""
    return F.concat(F.date_format(day, "yyyyMMdd"), K.seeded_order(0, row_id))


@query("e5_ordered_cut", """SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), md5('0:' || o_orderkey)) - 1 AS rank FROM orders""")
def ordered_rank(t):
    ranked = K.distributed_rank(t.orders, [], by_day(F.col("o_orderdate"), "o_orderkey"), [F.col("o_orderkey")], digits=10)
    return ranked.select("o_orderkey", "rank")


@query("e1_group_ordinals", """SELECT user_id, props, dense_rank() OVER (PARTITION BY user_id ORDER BY first_id) AS ordinal FROM (
    SELECT user_id, props, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1, 2) WHERE n >= 2""")
def group_ordinals(t):
    groups = t.events.groupBy("user_id", "props").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
    return E.number_groups(groups.filter("n >= 2"), "user_id", "first_id", "ordinal").select("user_id", "props", "ordinal")


@query("e2_dense_ids", """SELECT text, row_number() OVER (ORDER BY min(doc_id)) - 1 AS cid FROM documents GROUP BY 1""")
def dense_ids(t):
    return E.encode_ids(t.documents, "text", "doc_id", "cid").drop("n")


@query("e4_interleave", """SELECT vec_id, label, position, row_number() OVER (ORDER BY position, vec_id) - 1 AS place FROM (
    SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('3:' || vec_id)) - 1) / count(*) OVER (PARTITION BY label)
    AS position FROM embeddings) QUALIFY place < 0.2 * count(*) OVER ()""")
def interleave(t):
    return S.interleaved_cut(t.embeddings.select("vec_id", "label"), ["label"], "vec_id", share=0.2, seed=3)


@query("e6_seeded_shuffle", """SELECT event_id, row_number() OVER (ORDER BY md5('11:' || event_id)) - 1 AS rank FROM events""")
def seeded_shuffle(t):
    return K.distributed_rank(t.events.select("event_id"), [], K.seeded_order(11, "event_id"), [F.col("event_id")])


@query("g4_unique_folds", """WITH a AS (SELECT o_orderpriority AS ds, o_orderkey AS id, f AS fold, CASE WHEN (f < 2 AND o_orderstatus = 'F')
      OR (f >= 2 AND o_orderkey % 3 = f - 2) THEN 'test' ELSE 'train' END AS role
      FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS f FROM orders)),
    sig AS (SELECT ds, fold, list(id ORDER BY id) AS ids FROM a WHERE role = 'test' GROUP BY 1, 2)
    SELECT ds, fold, role, count(*) AS n FROM a WHERE (ds, fold) IN (SELECT (ds, min(fold)) FROM sig GROUP BY ds, ids) GROUP BY ALL""")
def unique_folds(t):
    f = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("fold")
    rows = t.orders.select(F.col("o_orderpriority").alias("ds"), F.col("o_orderkey").alias("id"), "o_orderstatus", f)
    test = F.when(F.col("fold") < 2, F.col("o_orderstatus") == "F").otherwise(F.col("id") % 3 == F.col("fold") - 2)
    a = rows.select("ds", "id", "fold", F.when(test, "test").otherwise("train").alias("role"))
    return S.unique_folds(a, ["ds"], "id").groupBy("ds", "fold", "role").agg(F.count("*").alias("n"))


@query("i20_undersample", """WITH x AS (SELECT event_id, event_type = 'click' AS y FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || event_id)) AS rk FROM x)
    SELECT event_id, CAST(y AS INTEGER) AS y FROM r WHERE y OR rk <= (SELECT count(*) FROM x WHERE y)""")
def undersample(t):
    rows = t.events.select("event_id", (F.col("event_type") == "click").cast("int").alias("y"))
    return S.undersample(rows, "y", "event_id")


@query("i20_subsample", """SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY md5('5:' || event_id))
    <= floor(0.1 * count(*) OVER ())""")
def subsample(t):
    return S.subsample(t.events.select("event_id"), "event_id", seed=5, share=0.1)


@query("i19_triplets", """WITH items AS (SELECT text, row_number() OVER (ORDER BY min(doc_id)) - 1 AS compound_idx FROM documents
      JOIN labels USING (doc_id) GROUP BY 1), groups AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS assay_idx,
      arg_min(lang, doc_id) AS first_lang FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT compound_idx, assay_idx, quality AS activity, CAST(n_chars AS DOUBLE) AS activity_numeric, lang AS split, first_lang
    FROM documents JOIN labels USING (doc_id) JOIN items USING (text) JOIN groups USING (source)""")
def triplets(t):
    rows = t.documents.join(t.labels, "doc_id")
    out = E.to_triplets(rows, "text", "source", "quality", "n_chars", "lang", "doc_id", ["lang"])
    info = out["groups"].select("assay_idx", F.col("lang").alias("first_lang"))
    return out["activity"].join(info, "assay_idx")


@query("c19_triplet_gather", """SELECT d.doc_id, d.n_chars, s.n_docs, l.quality FROM labels l JOIN documents d USING (doc_id)
    JOIN (SELECT source, count(*) AS n_docs FROM documents GROUP BY 1) s USING (source)""")
def triplet_gather(t):
    items = t.documents.select("doc_id", "n_chars")
    groups = t.documents.groupBy("source").agg(F.count("*").alias("n_docs"))
    links = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")
    return E.gather_features(links, items, groups, "doc_id", "source").select("doc_id", "n_chars", "n_docs", "quality")


ALIGN_SQL = """WITH p AS (SELECT event_type AS pair, event_id AS id, json_extract_string(props, '$.k') IN ('7', '8') AS sib FROM events
      WHERE value < 90),
    c AS (SELECT event_type AS pair, event_id AS id, ds AS drop_siblings, CAST(f AS INTEGER) AS fold,
        CASE WHEN event_id % 3 = f THEN 'test' ELSE 'train' END AS role
      FROM (SELECT *, unnest([0, 1, 2]) AS f FROM (SELECT *, unnest([true, false]) AS ds FROM events WHERE user_id < 60 AND value > 5))),
    pa AS (SELECT k.pair, k.drop_siblings, k.fold, p.id, CASE WHEN k.drop_siblings AND p.sib THEN NULL WHEN c.id IS NOT NULL THEN 'test'
        ELSE 'train' END AS role FROM (SELECT DISTINCT pair, drop_siblings, fold FROM c) k JOIN p USING (pair)
      LEFT JOIN c ON c.pair = k.pair AND c.drop_siblings = k.drop_siblings AND c.fold = k.fold AND c.id = p.id AND c.role = 'test'),
    ca AS (SELECT c.pair, c.drop_siblings, c.fold, c.id, CASE WHEN c.role = 'test' AND pa.id IS NULL THEN NULL ELSE c.role END AS role
      FROM c LEFT JOIN pa ON pa.pair = c.pair AND pa.drop_siblings = c.drop_siblings AND pa.fold = c.fold AND pa.id = c.id AND pa.role = 'test')"""


def aligned_sides(t):
    e = t.events.select(F.col("event_type").alias("pair"), F.col("event_id").alias("id"), "value", "user_id",
                        F.get_json_object("props", "$.k").isin("7", "8").alias("has_sibling"))
    child = (e.filter("user_id < 60 AND value > 5")
             .select("pair", "id", F.explode(F.array(F.lit(True), F.lit(False))).alias("drop_siblings"))
             .select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("fold")))
    child = child.withColumn("role", F.when(F.col("id") % 3 == F.col("fold"), "test").otherwise("train"))
    return S.aligned_split(e.filter("value < 90"), child, ["pair"], "id"), child


@query("i15_aligned_split", ALIGN_SQL + """ SELECT side, pair, drop_siblings, fold, role, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM (
      SELECT 'parent' AS side, * FROM pa UNION ALL SELECT 'child', * FROM ca) GROUP BY ALL""")
def aligned_split(t):
    sides, _ = aligned_sides(t)
    both = (sides["parent"].withColumn("side", F.lit("parent"))
            .unionByName(sides["child"].withColumn("side", F.lit("child"))))
    return both.groupBy("side", "pair", "drop_siblings", "fold", "role").agg(
        F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("i32_overlap_report", ALIGN_SQL + """, u AS (SELECT pair, drop_siblings, fold, id, bool_or(side = 'p') AS p, bool_or(side = 'c') AS c FROM (
      SELECT 'p' AS side, pair, drop_siblings, fold, id FROM pa WHERE role = 'test'
      UNION ALL SELECT 'c', pair, drop_siblings, fold, id FROM c WHERE role = 'test') GROUP BY ALL)
    SELECT pair, drop_siblings, fold, count(*) FILTER (p) AS parent_count, count(*) FILTER (c) AS child_count,
      count(*) FILTER (p AND c) AS intersection_count, coalesce(count(*) FILTER (p AND c) / nullif(count(*) FILTER (c), 0), 0) AS coverage,
      coalesce(count(*) FILTER (p AND c) / nullif(count(*) FILTER (p), 0), 0) AS inclusion,
      count(*) FILTER (p AND NOT c) AS unique_to_parent, count(*) FILTER (c AND NOT p) AS unique_to_child FROM u GROUP BY 1, 2, 3""")
def overlap_report(t):
    sides, child = aligned_sides(t)
    return M.overlap_of_tests(sides["parent"].filter("role = 'test'"), child.filter("role = 'test'"), ["pair", "drop_siblings", "fold"], "id")


@query("i32_split_audit", f"""WITH {ROWS_SQL}, f AS (SELECT ds, y, sib, rk % k AS tf, k FROM {folds_sql()} WHERE k >= 2)
    SELECT ds, CAST(fold AS INTEGER) AS fold, CASE WHEN fold = tf THEN 'test' ELSE 'train' END AS role, sib, count(*) AS n,
      CAST(sum(y) AS BIGINT) AS positives FROM (SELECT *, unnest(range(0, k)) AS fold FROM f) GROUP BY 1, 2, 3, 4""")
def split_audit(t):
    rows = labelled(t)
    a = S.stratified_kfold(rows, ["ds"], "id", "y").join(rows.select("id", "y", "sib"), "id")
    return a.groupBy("ds", "fold", "role", "sib").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
