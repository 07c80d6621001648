"""The personal-data query.  SQL cannot express it; the tests compare it with naive patterns and enumeration."""

from pyspark.sql import functions as F

from ..plans.registry import query
from . import personal as P


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def of_kind(kind):
    return lambda span: span.kind == kind


@query("op4_personal_data")
def op4_personal_data(t):
    found = P.detect(t.documents, P.fit(t.documents)).withColumn("base", F.filter("spans", lambda s: s.is_base))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in P.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
