"""Explicit schemas of the stages; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
         "boolean": T.BooleanType(), "date": T.DateType()}


def schema_of(spec: str) -> T.StructType:
    """``name type, name type`` as a schema; unlike DDL parsing this needs no running session."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


RAW_ACTIVITY = schema_of(
    "activity_id bigint, assay_id bigint, tid bigint, molregno bigint, assay_chembl_id string, "
    "target_chembl_id string, compound_chembl_id string, standard_type string, standard_relation string, "
    "standard_value double, pchembl_value double, standard_units string, assay_type string, assay_type_desc string, "
    "assay_category string, assay_organism string, assay_strain string, assay_tissue string, assay_cell_type string, "
    "assay_subcellular_fraction string, bao_format string, bao_label string, assay_test_type string, "
    "assay_tax_id bigint, variant_id bigint, cell_id bigint, tissue_id bigint, assay_desc string, curated_by string, "
    "relationship_type string, relationship_type_desc string, aidx string, confidence_score int, "
    "confidence_score_desc string, pref_name string, canonical_smiles string, assay_metadata_hash string")

DATASET_KEY = ["level", "target", "effect", "assay", "std_type", "assay_id"]

ASSIGNMENT = schema_of(
    "level string, target string, effect string, assay string, std_type string, assay_id string, row_id bigint, "
    "scheme string, drop_siblings boolean, fold int, side string, pair string, role string")

TRIPLET = schema_of("compound_idx bigint, assay_idx bigint, activity int, activity_numeric double, split string")

LOOKUP = schema_of("target string, effect string, assay string, std_type string, action string, assay_id string")

BENCHMARK_RESULT = schema_of(
    "algo string, features string, scheme string, drop_siblings boolean, pipeline string, dataset string, "
    "auroc double, auprc double, balanced double, kappa double, bedroc double, f1 double, mcc double, accuracy double")
