"""A corpus pipeline over ``documents``: filter, deduplicate, mask, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm import mixing, ngram_join, packing, personal
from foldsmith.llm import toxicity as toxic
from foldsmith.llm.queries_packing import TOKENIZER
from foldsmith.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five words, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; ``n_chars`` follows the text."""
    masked = personal.mask(docs, personal.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("personal_data", personal_data),
          ("pareto_mix", mix), ("best_fit_packing", pack)]

#: Classifier, components and tokenizer are beyond SQL; the tests check the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
