"""Text features, classifiers and benchmarks."""

from pyspark.sql import functions as F

from ..operators import many, ml
from ..operators import textfeat as T
from ..operators.curate import flag_siblings
from ..operators.splits import sibling_variants, stratified_kfold
from ..session import materialize
from .registry import query

STOP = ["the", "of", "and", "de", "la", "der", "to", "in", "is", "that"]


@query("i22_tfidf_weights", f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'),
      '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 2 AND term NOT IN ({', '.join(repr(s) for s in STOP)}) GROUP BY 1, 2),
    fit AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= floor(0.8 * count(*) OVER ())),
    n AS (SELECT count(*) AS n FROM fit),
    idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf SEMI JOIN fit USING (doc_id) CROSS JOIN n GROUP BY 1
      HAVING count(*) <= 0.95 * any_value(n) AND count(*) >= any_value(n) / 10000.0),
    x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def tfidf_weights(t):
    out = T.tfidf_weights(t.texts("text"), "doc_id", "text", STOP)
    return out.withColumn("weight", F.round("weight", 6))


@query("i22_lsa_features")
def lsa_features(t):
    return T.lsa_features(t.texts("text"), "doc_id", "text", STOP, n_components=8)


@query("i23_principal_components")
def principal_components(t):
    return T.pca(t.embeddings, "vec_id", "embedding")


def binary_vectors(t):
    """Embeddings as a two-class problem: half of the labels against the other half."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                               (F.col("label") < 5).cast("int").alias("label"))
    return materialize(rows, "binary-vectors")


@query("i24_train_predict")
def train_predict(t):
    rows = binary_vectors(t)
    fold = materialize(stratified_kfold(rows, [], "id", "label", 5).filter("fold = 0"), "one-fold")
    fits = {"RF": {"numTrees": 10, "maxDepth": 4}, "GB": {"maxIter": 5, "maxDepth": 3}, "SVM": {"maxIter": 20}, "KNN": {"k": 5}}
    jobs = [({"algo": a}, fold, a, p) for a, p in fits.items()]
    return ml.fit_all(rows, jobs, "id")


@query("i25_grid_search")
def grid_search(t):
    rows = binary_vectors(t)
    inner = materialize(stratified_kfold(rows, [], "id", "label", 3).withColumn("outer_fold", F.lit(0)), "grid-folds")
    found = ml.grid_search(rows, inner, "RF", {"numTrees": [5, 15], "maxDepth": [3]})
    return t.spark.createDataFrame([(o, c["numTrees"], c["maxDepth"], float(s)) for o, c, s in found],
                                   "outer_fold int, num_trees int, max_depth int, score double")


@query("i26_cross_validation")
def cross_validation(t):
    rows = binary_vectors(t)
    outer = stratified_kfold(rows, [], "id", "label", 3)
    return ml.run_pipelines(rows, outer, "KNN", {"k": [3, 7]}, list(ml.PIPELINES), inner_folds=2)


@query("i27_benchmark_internal")
def benchmark_internal(t):
    rows = binary_vectors(t)
    schemes = {"rs-vs": stratified_kfold(rows, [], "id", "label", 3)}
    return ml.benchmark_internal(rows, schemes, {"RF": {"numTrees": [5], "maxDepth": [3]}, "SVM": {"maxIter": [10]}}, ["HoldoutCV"], inner_folds=2)


@query("i27_benchmark_aligned")
def benchmark_aligned(t):
    rows = binary_vectors(t)
    return ml.benchmark_aligned(rows, rows.filter("id % 2 = 0"), {"SVM": {"maxIter": [10]}}, ["HoldoutCV"], folds=3, inner_folds=2)


def vector_datasets(t):
    """Four two-class datasets of vectors, with the rows that have an equal vector in their dataset flagged."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("d"), F.col("vec_id") % 4).alias("ds"),
                               F.col("embedding").cast("array<double>").alias("features"), (F.col("label") < 5).cast("int").alias("label"))
    signed = rows.withColumn("_sig", F.md5(F.to_json("features")))
    return materialize(flag_siblings(signed, ["ds"], "_sig", "id").drop("_sig"), "vector-datasets")


@query("i24_many_datasets")
def many_datasets(t):
    rows = vector_datasets(t)
    outer = sibling_variants(rows, lambda kept: stratified_kfold(kept, ["ds"], "id", "label", 3))
    keys = ["ds", "drop_siblings", "fold"]
    placed = materialize(many.place_units(rows, outer, keys, ["ds"], "id"), "units")
    parts = [many.fit_many(rows, outer, keys, ["ds"], algo, configs, placed=placed).withColumn("algo", F.lit(algo)) for algo, configs in
             (("LINEAR", [{"reg": 0.01, "iterations": 10}, {"reg": 0.1}]), ("FOREST", [{"trees": 5, "depth": 3}]))]
    return parts[0].unionByName(parts[1])


@query("i27_benchmark_datasets")
def benchmark_datasets(t):
    rows = vector_datasets(t)
    outer = sibling_variants(rows, lambda kept: stratified_kfold(kept, ["ds"], "id", "label"))
    grids = {"LINEAR": [{"reg": 0.01, "iterations": 25}, {"reg": 0.1}], "FOREST": [{"trees": 5, "depth": 3}, {"trees": 10, "depth": 4}]}
    return many.benchmark_many(rows, outer, ["ds", "drop_siblings"], ["ds"], grids, list(ml.PIPELINES))
