"""Text rules, curated id lists and the three dataset levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .joins import gate_by_size, join_dimension


@dataclass(frozen=True)
class Rule:
    """Rows of the given measurement types whose text is found by ``include`` and not by ``exclude``."""

    effect: str
    assay: str
    std_types: tuple[str, ...]
    include: str
    exclude: str


# fixed values: the assay categories, their measurement types and text patterns
RULES = [
    Rule("bind", "RBA", ("Ki", "IC50"), "(?i)affinity|displacement|3H|125I",
         "(?i)camp|gtp|calcium|ca2+|IP1|IP3|arrest|agonis"),
    Rule("agon", "G-GTP", ("EC50",), "(?i)gtp",
         "(?i)arrestin|camp|calcium|IP1|IP3|antagonis|inverse agonist|allosteric"),
    Rule("antag", "G-GTP", ("IC50", "Ki"), "(?i)gtp", "(?i)arrestin|camp|calcium|IP1|IP3|allosteric"),
    Rule("agon", "G-cAMP", ("IC50", "EC50"), "(?i)camp",
         "(?i)arrestin|gtp|calcium|IP1|IP3|antagonis|inverse agonist|allosteric"),
    Rule("agon", "G-Ca", ("EC50",), "(?i)calcium|ca2+|IP1|IP3",
         "(?i)arrestin|gtp|camp|antagonis|inverse agonist|allosteric"),
    Rule("antag", "G-Ca", ("IC50",), "(?i)calcium|ca2+|IP1|IP3", "(?i)arrestin|gtp|camp|allosteric"),
    Rule("agon", "B-arrest", ("EC50",), "(?i)arrest",
         "(?i)gtp|camp|calcium|IP1|IP3|antagonis|inverse agonist|allosteric"),
    Rule("antag", "B-arrest", ("IC50",), "(?i)arrest", "(?i)gtp|camp|calcium|IP1|IP3|allosteric"),
]
# fixed values: descriptions of the codes
EFFECT_NAMES = {"bind": "binding affinity", "agon": "agonism", "antag": "antagonism"}
LHD_LOW, LHD_HIGH = 50, 5000


def match_rules(rows: DataFrame, rules: Sequence[Rule], text: str, std_type: str) -> DataFrame:
    """One output row per (row, rule) that applies, with ``effect``, ``assay`` and ``matched``, in a single scan.

    A row of a rule's type that the pattern rejects is kept with ``matched`` false: id lists may still add it.
    """
    entries = [F.when(F.col(std_type).isin(list(r.std_types)),
                      F.struct(F.lit(r.effect).alias("effect"), F.lit(r.assay).alias("assay"),
                               P.matches(F.col(text), r.include, r.exclude).alias("matched"))) for r in rules]
    hits = rows.withColumn("_rule", F.explode(F.array_compact(F.array(*entries))))
    return hits.select(*rows.columns, "_rule.effect", "_rule.assay", "_rule.matched")


def apply_lookup(hits: DataFrame, lookup: DataFrame, target: str, std_type: str, assay_id: str, row_id: str) -> DataFrame:
    """Marks each hit with ``plus`` and ``excluded`` from a curated id list.

    Several list entries for one id fold into one, so the join adds no rows.
    """
    listed = lookup.groupBy("target", "effect", "assay", "std_type", "assay_id").agg(
        F.max(F.col("action") == "plus").alias("plus"), F.max(F.col("action") == "exclude").alias("excluded"))
    listed = listed.withColumnsRenamed({"target": target, "std_type": std_type, "assay_id": assay_id})
    joined = join_dimension(hits, listed, [target, "effect", "assay", std_type, assay_id], [row_id], "left")
    return joined.withColumns({"plus": F.coalesce("plus", F.lit(False)),
                               "excluded": F.coalesce("excluded", F.lit(False))})


def selected(hits: DataFrame, dedupe: bool = True) -> DataFrame:
    """(matched or listed) and not excluded.

    ``dedupe=False`` gives a row that is both matched and listed twice, as a plain union of the two sets would.
    """
    kept = hits.filter((F.col("matched") | F.col("plus")) & ~F.col("excluded"))
    if dedupe:
        return kept
    twice = F.when(F.col("matched") & F.col("plus"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return kept.withColumn("_copy", F.explode(twice)).drop("_copy")


def categorize(rows: DataFrame, rules: Sequence[Rule], lookup: DataFrame, row_id: str, target: str, std_type: str,
               assay_id: str, text: str, low: int = LHD_LOW, high: int = LHD_HIGH,
               lookup_id: str | None = None) -> DataFrame:
    """Long table (row_id, level, target, effect, assay, std_type, assay_id); NULL where a part is not applicable.

    ``hhd`` groups by target and type, ``mhd`` also by effect and assay, ``lhd`` by a single assay id within
    the size limits, ``mhd-effect`` pools a target's rows of one effect.  The lookup lists assay ids, or values
    of ``lookup_id`` where another column is named.
    """
    none = F.lit(None).cast("string")

    def level(name: str, frame: DataFrame, **parts) -> DataFrame:
        cells = {c: none for c in ("effect", "assay", "std_type", "assay_id")} | parts
        return frame.select(F.col(row_id).alias("row_id"), F.lit(name).alias("level"),
                            F.col(target).cast("string").alias("target"),
                            *[v.cast("string").alias(k) for k, v in cells.items()])

    listed = lookup_id or assay_id
    needed = list(dict.fromkeys([row_id, target, std_type, assay_id, listed, text]))
    hits = apply_lookup(match_rules(rows.select(*needed), rules, text, std_type).drop(text), lookup, target, std_type,
                        listed, row_id)
    chosen = selected(hits)
    effect, assay, kind = F.col("effect"), F.col("assay"), F.col(std_type)
    single = gate_by_size(chosen, [target, "effect", "assay", std_type, assay_id], [row_id], low, high)
    out = level("hhd", rows, std_type=kind)
    out = out.unionByName(level("mhd", chosen, effect=effect, assay=assay, std_type=kind))
    out = out.unionByName(level("mhd-effect", chosen, effect=effect).distinct())
    return out.unionByName(level("lhd", single, effect=effect, assay=assay, std_type=kind, assay_id=F.col(assay_id)))


def level_funnel(rows: DataFrame, hits: DataFrame, target: str, std_type: str, assay_id: str, low: int = LHD_LOW,
                 high: int = LHD_HIGH) -> DataFrame:
    """How many rows reach each stage, per (target, effect, assay, type): one aggregate per level of detail."""
    group = [target, "effect", "assay", std_type]
    in_mhd = (F.col("matched") | F.col("plus")) & ~F.col("excluded")
    per_id = hits.groupBy(*group, assay_id).agg(
        F.count_if("matched").alias("matched"), F.count_if("plus").alias("plus"),
        F.count_if("excluded").alias("excluded"), F.count_if(in_mhd).alias("mhd"))
    ok = F.col("mhd").between(low, high)
    stages = per_id.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in ("matched", "plus", "excluded", "mhd")],
        F.sum(F.when(ok, F.col("mhd")).otherwise(0)).alias("lhd"), F.count_if(ok).alias("n_lhd"))
    hhd = rows.groupBy(target, std_type).agg(F.count("*").alias("hhd"))
    return stages.join(hhd, [target, std_type])
