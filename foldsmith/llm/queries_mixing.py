"""The mixing query and its SQL."""

from pyspark.sql import functions as F

from ..plans.registry import query
from . import mixing as M


@query("op6_pareto_mix", r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:13] AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size,
                 [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
          FROM d GROUP BY source),
    o AS (SELECT *, sum(2.0::DOUBLE * source_size) OVER before AS full_size, sum(w) OVER after AS open_w,
                 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS goal
          FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        after AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    v AS (SELECT max((goal - coalesce(full_size, 0)) / open_w)
                 FILTER ((goal - coalesce(full_size, 0)) / open_w * w < 2.0::DOUBLE * source_size) AS level FROM o),
    t AS (SELECT source, source_size, least(level * w, 2.0::DOUBLE * source_size) AS target FROM s, v),
    x AS (SELECT doc_id, size, t.*, length(bin(size))::DOUBLE AS weight, (('0x' || h)::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    g AS (SELECT source, weight, sum(size)::DOUBLE AS words, any_value(target) AS target FROM x WHERE size > 0 GROUP BY source, weight),
    q AS (SELECT source, weight, (target - coalesce(sum(words) OVER heavier, 0) * 2.0::DOUBLE) / sum(words * weight) OVER others AS rate
          FROM g WINDOW heavier AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        others AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    e AS (SELECT source, coalesce(max(rate) FILTER (rate * weight <= 2), 2.0::DOUBLE / min(weight)) AS rate FROM q GROUP BY source),
    k AS (SELECT x.*, least(coalesce(rate, 0) * weight, 2.0::DOUBLE) AS copies FROM x LEFT JOIN e ON x.source IS NOT DISTINCT FROM e.source),
    l AS (SELECT *, floor(copies + 1e-9::DOUBLE)::BIGINT AS whole, copies - floor(copies + 1e-9::DOUBLE) AS part FROM k),
    r AS (SELECT *, CASE WHEN size > 0 AND part > 1e-9::DOUBLE THEN part ELSE 0 END AS p,
                 sum(whole * size) OVER (PARTITION BY source) AS certain FROM l),
    c AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source
                             ORDER BY CASE WHEN p > 0 THEN ln(u / (1 - u)) - ln(p / (1 - p)) END NULLS LAST, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
    SELECT doc_id, size, source_size, target,
           size * (whole + (p > 0 AND before + size / 2 <= target - certain)::BIGINT) AS taken FROM c""")
def op6_pareto_mix(t):
    mixed = M.mix(t.documents)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
