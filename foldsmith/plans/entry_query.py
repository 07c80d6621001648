"""The flagship: event values curated into per-type datasets, end to end."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import curate as C
from ..operators import report as R
from ..session import materialize
from .registry import query

# events as measurements: the value is read in uM, the relation is taken from the parity of k,
# the item is the (user, props) pair and the dataset the event type
RAW_SQL = """raw AS (
      SELECT event_id, event_type AS dataset, user_id || ':' || props AS item_key, value * 1000 AS standard_value,
        CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 WHEN 0 THEN '>' WHEN 1 THEN '' WHEN 2 THEN '~'
          ELSE '=' END AS standard_relation, CAST(length(props) AS DOUBLE) AS weight FROM events WHERE value > 0),
    std AS (SELECT *, 9 - log10(standard_value) AS p FROM raw WHERE trim(standard_relation) <> '' AND weight <= 900)"""
MERGED_SQL = """merged AS (SELECT dataset, item_key, avg(p) AS p_value, min(event_id) AS event_id,
        arg_min(standard_relation, event_id) AS standard_relation, arg_min(weight, event_id) AS weight
      FROM std GROUP BY 1, 2 HAVING stddev_samp(p) IS NULL OR stddev_samp(p) <= 1)"""


def label_sql(source: str, out: str, aim: str, low: float, high: float, fallback: float) -> str:
    """Threshold, five-way label and activity of one aim; rows without a label are left out."""
    t, c, a = f"{aim}t", f"{aim}c", f"{aim}a"
    return f"""{out}_s AS (SELECT dataset, median(p_value) AS m, stddev_samp(p_value) / 10 AS b FROM {source} GROUP BY 1),
    {out}_l AS (SELECT r.*, CASE WHEN m BETWEEN {low} AND {high} THEN m ELSE {fallback} END AS {t}, b FROM {source} r JOIN {out}_s USING (dataset)),
    {out}_c AS (SELECT * EXCLUDE (b), CASE WHEN standard_relation = '>' THEN 'inactive' WHEN b IS NULL THEN NULL WHEN p_value >= {t} + b THEN 'active'
        WHEN p_value > {t} THEN 'weak active' WHEN p_value <= {t} - b THEN 'inactive' ELSE 'weak inactive' END AS {c} FROM {out}_l),
    {out} AS (SELECT *, CASE WHEN {c} IN ('active', 'weak active') THEN 1 ELSE 0 END AS {a} FROM {out}_c WHERE {c} IS NOT NULL)"""


def labels_sql(source: str, tag: str) -> str:
    return f"""{label_sql(source, f'{tag}_vs', 'v', 4, 6, 5.0)}, {label_sql(f'{tag}_vs', f'{tag}_lo', 'l', 5, 7, 6.3)},
    {tag} AS (SELECT *, count(*) OVER (PARTITION BY dataset, split_part(item_key, ':', 1)) > 1 AS sib FROM {tag}_lo)"""


EVENTS_SQL = f"WITH {RAW_SQL}, {MERGED_SQL}, {labels_sql('merged', 'cur')}"


def measurements(t):
    """Event rows in the shape of raw measurements, cleaned and standardized."""
    k = F.get_json_object("props", "$.k").cast("int")
    relation = (F.when(k % 10 == 0, ">").when(k % 10 == 1, "").when(k % 10 == 2, "~").otherwise("="))
    raw = t.events.select("event_id", F.col("event_type").alias("dataset"), "user_id", "props",
                          F.col("value").alias("standard_value"), F.lit(L.MICROMOLAR).alias("standard_units"),
                          relation.alias("standard_relation"))
    return C.standardize(C.clean(raw), lambda: F.concat_ws(":", "user_id", "props"),
                         F.length("props").cast("double")).drop("user_id", "props")


def curated_events(t):
    # siblings: the items of one user within a dataset
    return C.curate(measurements(t), ["dataset"], "event_id", lambda: F.split("item_key", ":")[0])


@query("entry_curate_events", EVENTS_SQL + """
    SELECT dataset, count(*) AS size_all, count(*) FILTER (sib) AS n_siblings, round(max(vt), 2) AS vs_threshold,
      round(max(lt), 2) AS lo_threshold, count(*) FILTER (va = 1) AS vs_active_all,
      count(*) FILTER (la = 1) AS lo_active_all, round(100.0 * count(*) FILTER (va = 1) / count(*), 2) AS vs_percent_all,
      round(100.0 * count(*) FILTER (la = 1) / count(*), 2) AS lo_percent_all,
      CASE WHEN count(*) FILTER (NOT sib) < 50 THEN 's50' ELSE 'b50' END AS level_alone FROM cur GROUP BY 1""")
def curate_events(t):
    return C.dataset_summary(curated_events(t), ["dataset"]).select(
        "dataset", "size_all", "n_siblings", "vs_threshold", "lo_threshold", "vs_active_all", "lo_active_all",
        "vs_percent_all", "lo_percent_all", "level_alone")


@query("i3_standardize", f"WITH {RAW_SQL} SELECT event_id, dataset, item_key, weight, standard_value, round(p, 6) AS p_value FROM std")
def standardize(t):
    return measurements(t).select("event_id", "dataset", "item_key", "weight", "standard_value", F.round("p_value", 6).alias("p_value"))


@query("i4_consolidate", f"WITH {RAW_SQL}, {MERGED_SQL} SELECT dataset, item_key, event_id, round(p_value, 6) AS p_value FROM merged")
def consolidate(t):
    out = C.consolidate(measurements(t), ["dataset", "item_key"], "p_value", ["event_id"])
    return out.select("dataset", "item_key", "event_id", F.round("p_value", 6).alias("p_value"))


@query("i5_auto_threshold", f"""WITH {RAW_SQL}, plain AS (SELECT event_id, dataset, standard_relation, p AS p_value FROM std),
    {label_sql('plain', 'x', 'v', 4, 6, 5.0)} SELECT event_id, dataset, vc AS vs_activity_comment, CAST(va AS DOUBLE) AS vs_activity,
    round(vt, 2) AS vs_threshold FROM x""")
def auto_threshold(t):
    rows = materialize(measurements(t).select("event_id", "dataset", "standard_relation", "p_value"), "measurements")
    out = C.apply_threshold(rows, ["dataset"], "vs", "event_id")
    return out.select("event_id", "dataset", "vs_activity_comment", "vs_activity", "vs_threshold")


@query("i5_fixed_threshold", f"""WITH {RAW_SQL} SELECT event_id, CAST(p > 4.5 + 0.5 AND standard_relation <> '>' AS DOUBLE) AS vs_activity,
    5.0::DOUBLE AS vs_threshold FROM std WHERE standard_relation = '>' OR p >= 5.5 OR p <= 4.5""")
def fixed_threshold(t):
    out = C.apply_threshold(measurements(t), ["dataset"], "vs", "event_id", automatic=False, hard_only=True)
    return out.select("event_id", "vs_activity", "vs_threshold")


@query("i6_curate", EVENTS_SQL + """ SELECT event_id, dataset, item_key, vc AS vs_activity_comment, lc AS lo_activity_comment,
    CAST(va AS DOUBLE) AS vs_activity, CAST(la AS DOUBLE) AS lo_activity, sib AS has_sibling FROM cur""")
def curate(t):
    return curated_events(t).select("event_id", "dataset", "item_key", "vs_activity_comment", "lo_activity_comment",
                                    "vs_activity", "lo_activity", "has_sibling")


@query("i7_regroup", f"""WITH {RAW_SQL}, plain AS (SELECT event_id, dataset, item_key, p AS p_value, standard_relation, weight FROM std),
    {labels_sql('plain', 'one')}, pool AS (SELECT event_id, CASE WHEN dataset IN ('click', 'view') THEN 'look' ELSE 'act' END AS dataset, item_key,
      p_value AS p, standard_relation, weight FROM one),
    twin AS (SELECT dataset, item_key, avg(p) AS p_value, min(event_id) AS event_id, arg_min(standard_relation, event_id) AS standard_relation
      FROM pool GROUP BY 1, 2 HAVING stddev_samp(p) IS NULL OR stddev_samp(p) <= 1), {labels_sql("twin", "two")}
    SELECT event_id, dataset, item_key, vc AS vs_activity_comment, lc AS lo_activity_comment, sib AS has_sibling FROM two""")
def regroup(t):
    signature = lambda: F.split("item_key", ":")[0]
    single = C.curate(measurements(t), ["dataset"], "event_id", signature, merge_replicates=False)
    pooled = single.withColumn("dataset", F.when(F.col("dataset").isin("click", "view"), "look").otherwise("act"))
    return C.regroup(pooled, ["dataset"], "event_id", signature).select(
        "event_id", "dataset", "item_key", "vs_activity_comment", "lo_activity_comment", "has_sibling")


@query("i32_stats_funnel", EVENTS_SQL + """ SELECT dataset, n_raw, n_clean, n_merged, n_labelled FROM
    (SELECT event_type AS dataset, count(*) AS n_raw FROM events GROUP BY 1) FULL JOIN
    (SELECT dataset, count(*) AS n_clean FROM std GROUP BY 1) USING (dataset) FULL JOIN
    (SELECT dataset, count(*) AS n_merged FROM merged GROUP BY 1) USING (dataset) FULL JOIN
    (SELECT dataset, count(*) AS n_labelled FROM cur GROUP BY 1) USING (dataset)""")
def stats_funnel(t):
    rows = measurements(t)
    stages = {"raw": t.events.withColumnRenamed("event_type", "dataset"), "clean": rows,
              "merged": C.consolidate(rows, ["dataset", "item_key"], "p_value", ["event_id"]), "labelled": curated_events(t)}
    return R.stage_sizes(stages, ["dataset"])
