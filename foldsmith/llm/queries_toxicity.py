"""The toxicity query.  Its model is fitted, so the tests hold it to accuracy on the rows held out."""

from pyspark.sql import functions as F

from ..plans.registry import query
from . import toxicity as T


@query("op10_toxicity")
def op10_toxicity(t):
    documents = t.documents.select("doc_id", "text")
    scored = T.score(documents, T.fit(documents, t.labels))
    return scored.select("doc_id", (T.crc_fold("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
