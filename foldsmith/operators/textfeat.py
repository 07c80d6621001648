"""TF-IDF and latent semantic features of texts, and principal components of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, CountVectorizer, ElementwiseProduct, IDF, Normalizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_dimension, join_group_stats
from .rank import rank_by_value

# fixed values: accented Latin letters and their plain forms
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
MAX_SHARE, MIN_SHARE = 0.95, 1 / 10000


def terms(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case words of at least two letters or digits, without accents and stop words."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    found = F.filter(F.split(plain, "[^\\p{L}\\p{N}_]+"), lambda w: F.length(w) >= 2)
    return F.filter(found, lambda w: ~w.isin(list(stop_words)))


def first_share(rows: DataFrame, row_id: str, share: float) -> DataFrame:
    """Ids of the first ``share`` of the rows in id order."""
    total = rows.agg(F.count("*")).scalar()
    ranked = rank_by_value(rows.select(row_id), [], row_id, out="_r").withColumn("_n", total)
    return ranked.filter(F.col("_r") < F.floor(F.col("_n") * share)).select(row_id)


def tfidf_weights(rows: DataFrame, row_id: str, text: str, stop_words: Sequence[str], fit_share: float = 0.8,
                  max_share: float = MAX_SHARE, min_share: float = MIN_SHARE) -> DataFrame:
    """(row_id, term, weight): smoothed, L2-normalized TF-IDF with frequencies taken from the first ``fit_share`` rows.

    Long form throughout: neither a vocabulary nor a matrix is held anywhere.
    """
    counts = materialize(rows.select(row_id, F.explode(terms(F.col(text), stop_words)).alias("term"))
                         .groupBy(row_id, "term").agg(F.count("*").alias("tf")), "term-counts")
    fitted = materialize(first_share(rows, row_id, fit_share), "fit-rows")
    docs = fitted.agg(F.count("*")).scalar()
    seen = counts.join(fitted, row_id, "left_semi").groupBy("term").agg(F.count("*").alias("n")).withColumn("_docs", docs)
    within = (F.col("n") <= F.col("_docs") * max_share) & (F.col("n") >= F.col("_docs") * min_share)
    idf = materialize(seen.filter(within).select(
        "term", "n", (F.log((1 + F.col("_docs")) / (1 + F.col("n"))) + 1).alias("idf")), "idf")
    weighed = join_group_stats(counts, idf, ["term"], [row_id]).select(row_id, "term", (F.col("tf") * F.col("idf")).alias("_w"))
    # a row's terms are as many as its own text has: weights are made once and meet their norm where they are summed
    rows_of = weighed.filter(F.col(row_id).isNotNull()).groupBy(row_id).agg(
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), F.collect_list(F.struct("term", "_w")).alias("_terms"))
    return rows_of.select(row_id, "_norm", F.inline("_terms")).select(row_id, "term", (F.col("_w") / F.col("_norm")).alias("weight"))


def lsa_features(rows: DataFrame, row_id: str, text: str, stop_words: Sequence[str], n_components: int = 355,
                 fit_share: float = 0.8) -> DataFrame:
    """(row_id, features): TF-IDF projected on the leading right singular vectors of the fitted share.

    The driver holds the singular vectors, a row a term.  Each term kept is in at least ``MIN_SHARE`` of the fitted rows,
    so there are at most 10,000 times the mean distinct terms of a row of them, however many rows there are.
    """
    worded = materialize(rows.select(row_id, terms(F.col(text), stop_words).alias("words")), "lsa-terms")
    fitted = materialize(worded.join(first_share(worded, row_id, fit_share), row_id, "left_semi"), "lsa-fitted")
    counted = CountVectorizer(inputCol="words", outputCol="tf", minDF=MIN_SHARE, maxDF=MAX_SHARE, vocabSize=(1 << 31) - 1).fit(fitted)
    idf = IDF(inputCol="tf", outputCol="unused").fit(counted.transform(fitted)).idf
    weigh = Pipeline(stages=[
        counted, ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol="tf", outputCol="weighed"),
        Normalizer(inputCol="weighed", outputCol="vector"), SQLTransformer(statement=f"SELECT `{row_id}` AS index, vector FROM __THIS__")])
    # the decomposition reads the matrix once an iteration, so it is stored and not made again from the words
    weighed = materialize(weigh.fit(worded).transform(fitted).withColumn("index", F.col("index").cast("long")), "lsa-matrix")
    k = min(n_components, len(counted.vocabulary) - 1)
    axes = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(weighed, "vector")).computeSVD(k, computeU=False).V.toArray()
    by_term = rows.sparkSession.createDataFrame(
        ((t, v.tolist()) for t, v in zip(counted.vocabulary, axes)), "term string, axis array<double>")
    weights = tfidf_weights(rows, row_id, text, stop_words, fit_share)
    summed = join_dimension(materialize(weights, "lsa-weights"), by_term, ["term"], [row_id]).groupBy(row_id).agg(
        F.array(*[F.sum(F.col("weight") * F.col("axis")[i]) for i in range(k)]).alias("features"))
    nothing = F.array_repeat(F.lit(0.0), k)
    return worded.select(row_id).join(summed, row_id, "left").select(row_id, F.coalesce("features", nothing).alias("features"))


def pca(rows: DataFrame, row_id: str, vector: str, k: int = 2) -> DataFrame:
    """(row_id, components): the leading ``k`` principal components."""
    named = rows.select(row_id, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(named)
    return model.transform(named).select(row_id, vector_to_array("p").alias("components"))
