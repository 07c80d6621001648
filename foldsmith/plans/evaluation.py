"""Metrics per group."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import report as R
from .registry import query

# a score in hundredths with many ties, and a label that goes with it only loosely
SCORED_SQL = """scored AS (SELECT event_id AS id, event_type AS g, least(floor(value), 100) / 100 AS s,
    CASE WHEN (event_id * 7919) % 101 < least(value, 80) THEN 1 ELSE 0 END AS y FROM events)"""


def scored(t):
    y = ((F.col("event_id") * 7919) % 101 < F.least("value", F.lit(80.0))).cast("int")
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("g"),
                           (F.least(F.floor("value"), F.lit(100)) / 100).alias("s"), y.alias("y"))


RANKING_SQL = f"""WITH {SCORED_SQL},
    c AS (SELECT g, s, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM scored GROUP BY 1, 2),
    w AS (SELECT *, coalesce(sum(p) OVER d, 0) AS bp, coalesce(sum(n) OVER d, 0) AS bn, sum(p) OVER (PARTITION BY g) AS tp,
        sum(n) OVER (PARTITION BY g) AS tn FROM c
        WINDOW d AS (PARTITION BY g ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m AS (SELECT g, CAST(max(tp) AS BIGINT) AS n_pos, CAST(max(tn) AS BIGINT) AS n_neg,
        sum(p * (tn - bn - n + n / 2)) / max(tp * tn) AS auroc, sum(p / tp * (bp + p) / (bp + p + bn + n)) AS ap,
        sum(n / tn * (tn - bn) / (tn - bn + tp - bp)) AS neg_ap, max(tp) / max(tp + tn) AS ra,
        sum(p / tp * ((bp + p) / (bp + p + bn + n) + CASE WHEN bp + bn = 0 THEN 1 ELSE bp / (bp + bn) END) / 2) AS pr_auc,
        arg_max(s, ((bp + p) * tn - (bn + n) * tp, s)) AS youden_threshold FROM w GROUP BY 1),
    r AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY s DESC, md5('0:' || id)) AS rk,
        count(*) OVER (PARTITION BY g) AS big FROM scored),
    b AS (SELECT g, sum(exp(-20.0 * rk / big)) FILTER (y = 1) AS e, max(big) AS big FROM r GROUP BY 1)
    SELECT g, n_pos, n_neg, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(neg_ap, 6) AS neg_ap,
      round(ap - ra, 6) AS delta_ap, round(neg_ap - (1 - ra), 6) AS delta_neg_ap, round(pr_auc, 6) AS pr_auc, youden_threshold,
      round(e / n_pos / ((1.0 / big) * (1 - exp(-20.0)) / (exp(20.0 / big) - 1)) * ra * sinh(10.0) /
        (cosh(10.0) - cosh(10.0 - 20.0 * ra)) + 1 / (1 - exp(20.0 * (1 - ra))), 6) AS bedroc FROM m JOIN b USING (g)"""


@query("d28_ranking_metrics", RANKING_SQL)
def ranking_metrics(t):
    out = M.ranking_metrics(scored(t), ["g"], "s", "y", "id")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("g", "n_pos", "n_neg", "youden_threshold")})


CONFUSION_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT g, count(*) FILTER (y = 1 AND s > 0.3) AS tp, count(*) FILTER (y = 0 AND s > 0.3) AS fp,
    count(*) FILTER (y = 0 AND s <= 0.3) AS tn, count(*) FILTER (y = 1 AND s <= 0.3) AS fn FROM scored GROUP BY 1),
    d AS (SELECT g, tp, fp, tn, fn, tp::DOUBLE AS a, fp::DOUBLE AS b, tn::DOUBLE AS c, fn::DOUBLE AS d,
      (tp + fp + tn + fn)::DOUBLE AS n FROM c)
    SELECT g, tp, fp, tn, fn, round((a + c) / n, 6) AS accuracy, round(a / (a + b), 6) AS precision, round(a / (a + d), 6) AS recall,
      round(2 * a / (2 * a + b + d), 6) AS f1, round((a * c - b * d) / sqrt((a + b) * (a + d) * (c + b) * (c + d)), 6) AS mcc,
      round((a / (a + d) + c / (c + b)) / 2, 6) AS balanced,
      round(((a + c) / n - ((a + b) * (a + d) + (c + d) * (c + b)) / (n * n)) / (1 - ((a + b) * (a + d) + (c + d) * (c + b)) / (n * n)), 6)
        AS kappa FROM d"""


@query("d32_confusion_metrics", CONFUSION_SQL)
def confusion_metrics(t):
    rows = scored(t).withColumn("p", (F.col("s") > 0.3).cast("int"))
    out = M.confusion_metrics(rows, ["g"], "y", "p")
    return out.withColumns({c: F.round(c, 6) for c in M.CONFUSION_METRICS})


@query("d33_regression_metrics", """SELECT l_returnflag, count(*) AS n, round(sqrt(avg((x - p) ** 2)), 4) AS rmse,
    round(1 - sum((x - p) ** 2) / (var_pop(x) * count(*)), 6) AS r2, round(sqrt(avg((x - p) ** 2) FILTER (big)), 4) AS rmse_flagged,
    round(1 - sum((x - p) ** 2) FILTER (big) / (var_pop(x) FILTER (big) * count(*) FILTER (big)), 6) AS r2_flagged
    FROM (SELECT l_returnflag, l_extendedprice AS x, l_quantity * 2000 AS p, l_quantity > 40 AS big FROM lineitem) GROUP BY 1""")
def regression_metrics(t):
    rows = t.lineitem.select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 2000).alias("p"),
                             (F.col("l_quantity") > 40).alias("big"))
    out = M.regression_metrics(rows, ["l_returnflag"], "l_extendedprice", "p", "big")
    return out.withColumns({"rmse": F.round("rmse", 4), "rmse_flagged": F.round("rmse_flagged", 4),
                            "r2": F.round("r2", 6), "r2_flagged": F.round("r2_flagged", 6)})


@query("d34_log_loss", f"""WITH {SCORED_SQL} SELECT g, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y), 6) AS log_loss
    FROM (SELECT g, y, 6 * s - 2 AS z FROM scored) GROUP BY 1""")
def log_loss(t):
    rows = scored(t).withColumn("z", 6 * F.col("s") - 2)
    return M.mean_log_loss(rows, ["g"], "z", "y").withColumn("log_loss", F.round("log_loss", 6))


@query("d31_class_balance", f"""WITH {SCORED_SQL}, r AS (SELECT y, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS role FROM scored)
    SELECT count(*) FILTER (y = 1) AS active_all, count(*) FILTER (y = 0) AS inactive_all, round(avg(y), 6) AS ratio_all,
      count(*) FILTER (y = 1 AND role = 'train') AS active_train, count(*) FILTER (y = 0 AND role = 'train') AS inactive_train,
      round(avg(y) FILTER (role = 'train'), 6) AS ratio_train, count(*) FILTER (y = 1 AND role = 'test') AS active_test,
      count(*) FILTER (y = 0 AND role = 'test') AS inactive_test, round(avg(y) FILTER (role = 'test'), 6) AS ratio_test FROM r""")
def class_balance(t):
    rows = scored(t).withColumn("role", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    out = R.class_balance(rows, "y", "role")
    return out.withColumns({f"ratio_{r}": F.round(f"ratio_{r}", 6) for r in ("all", "train", "test")})


@query("d36_test_overlap", """SELECT priority, parent_count, child_count, intersection_count, coverage, inclusion,
    parent_count - intersection_count AS unique_to_parent, child_count - intersection_count AS unique_to_child FROM (
      SELECT o_orderpriority AS priority, count(*) FILTER (p) AS parent_count, count(*) FILTER (c) AS child_count,
        count(*) FILTER (p AND c) AS intersection_count, coalesce(count(*) FILTER (p AND c) / nullif(count(*) FILTER (c), 0), 0) AS coverage,
        coalesce(count(*) FILTER (p AND c) / nullif(count(*) FILTER (p), 0), 0) AS inclusion
      FROM (SELECT o_orderpriority, o_totalprice > 200000 AS p, o_orderstatus = 'F' AS c FROM orders) WHERE p OR c GROUP BY 1)""")
def test_overlap(t):
    rows = t.orders.withColumnRenamed("o_orderpriority", "priority")
    out = M.overlap_of_tests(rows.filter("o_totalprice > 200000"), rows.filter("o_orderstatus = 'F'"), ["priority"], "o_orderkey")
    return out


@query("i28_evaluate", f"""SELECT r.g, r.auroc, r.ap, r.bedroc, c.accuracy, c.mcc, c.kappa, l.log_loss FROM ({RANKING_SQL}) r
    JOIN ({CONFUSION_SQL}) c USING (g) JOIN (WITH {SCORED_SQL} SELECT g, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y), 6)
      AS log_loss FROM (SELECT g, y, 6 * s - 2 AS z FROM scored) GROUP BY 1) l USING (g)""")
def evaluate(t):
    rows = scored(t).withColumns({"p": (F.col("s") > 0.3).cast("int"), "z": 6 * F.col("s") - 2})
    out = M.evaluate(rows, ["g"], score="s", label="y", row_id="id", predicted="p", logit="z")
    picked = out.select("g", "auroc", "ap", "bedroc", "accuracy", "mcc", "kappa", "log_loss")
    return picked.withColumns({c: F.round(c, 6) for c in picked.columns if c != "g"})
