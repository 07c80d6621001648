"""The encoding query.  SQL has no tokenizer; the tests compare it with the library and with plain merging."""

from pyspark.sql import functions as F

from ..plans.registry import query
from . import bpe_automaton as B
from .queries_packing import TOKENIZER


@query("op13_bpe_automaton")
def op13_bpe_automaton(t):
    both = B.decode(B.encode(t.documents, TOKENIZER, packed=True), TOKENIZER)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
