"""Quality rules as a bitmask ledger.

Every text is measured once, every rule is evaluated once on the measurements, and one long of failure bits is kept
beside the numbers.  Policies are versioned sets of rules: applying one, comparing two or asking what a rule costs
needs only the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import map_batches, utf8

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_lines")



def _rules() -> list[tuple[str, Column]]:
    """Rules in bit order: a failed rule sets its bit. New ones are appended, so that stored ledgers stay readable."""
    n = F.col("n_words")
    return [("few_words", n < 20),
            ("repeated_windows", 100 * F.col("n_repeat_words") > 30 * n),
            ("symbols", 100 * F.col("n_symbols") > 10 * n),
            ("repeated_neighbours", 100 * F.col("n_adjacent") > 30 * n),
            ("repeated_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
            ("short_words", F.col("word_chars") < 2 * n),
            ("long_words", F.col("word_chars") > 20 * n)]


#: Which rules a policy version applies.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_neighbours"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_neighbours", "repeated_lines", "short_words",
           "long_words"),
}
CURRENT = "v2"


def policy_mask(policy: str) -> int:
    names = [name for name, _ in _rules()]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of each text, all but ``word_chars``; words are split at ASCII white space.

    Windows of eight words are compared by a 64-bit hash of the words and their order, within a text only.
    """
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=int(counts.sum())).view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    out = {"n_words": counts, "n_adjacent": np.zeros(len(texts), np.int64),
           "n_repeat_words": np.zeros(len(texts), np.int64)}
    if len(flat) > 1:
        same = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
        out["n_adjacent"] = np.bincount(doc[1:][same], minlength=len(texts))
    if len(flat) >= WINDOW:
        starts = len(flat) - WINDOW + 1
        rolled = doc[:starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0x5851F42D4C957F2D) + flat[k:k + starts]
        whole = np.flatnonzero(doc[:starts] == doc[WINDOW - 1:])
        order = whole[np.argsort(rolled[whole], kind="stable")]
        equal = rolled[order][1:] == rolled[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, order[twice], 1)
        np.add.at(edge, order[twice] + WINDOW, -1)
        inside = np.cumsum(edge[:-1]) > 0
        out["n_repeat_words"] = np.bincount(doc[inside], minlength=len(texts))
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], dtype=np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], dtype=np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    return out


def build_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failures): one row per row of ``docs``; a null text counts as empty, ids are never looked at."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch):
            column = batch.column("text")
            texts = utf8(column)
            got = measure(texts)
            points = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            spaces = np.array([len(t) - len(t.translate(None, SPACE)) for t in texts], dtype=np.int64)
            return {"id": batch.column("id"), **got, "word_chars": points - spaces}
        return step

    measured = map_batches(rows, make, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(_rules()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", bits).withColumnRenamed("id", id_col)


def passes(policy: str = CURRENT) -> Column:
    """Whether a row of the ledger passes ``policy``."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablation(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, only, kept_without): rows failing each rule, failing no other, and kept if it were dropped.

    Rows are first counted per distinct bitmask, of which there are at most two to the number of rules.
    """
    mask = policy_mask(policy)
    counts = (ledger.withColumn("bits", F.col("failures").bitwiseAND(F.lit(mask).cast("long")))
              .groupBy("bits").agg(F.count("*").alias("n")))
    names = [n for n, _ in _rules()]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                                for r in POLICIES[policy]]))
    each = counts.withColumn("r", rules).select("bits", "n", "r.rule", "r.bit")
    here = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(F.sum(F.when(here, F.col("n")).otherwise(0)).alias("failed"),
                                    F.sum(F.when(here & (others == 0), F.col("n")).otherwise(0)).alias("only"),
                                    F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("kept_without"))
