"""Queries over URL rules and quality rules, with their SQL."""

from pyspark.sql import functions as F

from ..plans.registry import query
from . import quality_ledger as Q
from . import url_filter as U

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"),
             ("org/es/", "block")]

_VALUES = ", ".join(f"('{r}', '{U.split_rule(r)[0]}', '{U.split_rule(r)[1]}', '{v}')" for r, v in URL_RULES)


@query("op2_url_filter", f"""
    WITH rules(rule, r_host, r_path, verdict) AS (VALUES {_VALUES}),
    rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
             FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{U.UPPER}', '{U.LOWER}') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    best AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
             FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
             GROUP BY page_id, host, path)
    SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN best b ON p.page_id = b.page_id""")
def op2_url_filter(t):
    rules = t.spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return U.judge_urls(t.pages, rules)


@query("op3_quality_ledger", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                      coalesce(text, '') AS text FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
    g AS (SELECT doc_id, pos, word, lag(word) OVER one AS before,
                 word || ' ' || lead(word, 1) OVER one || ' ' || lead(word, 2) OVER one || ' ' || lead(word, 3) OVER one
                 || ' ' || lead(word, 4) OVER one || ' ' || lead(word, 5) OVER one || ' ' || lead(word, 6) OVER one
                 || ' ' || lead(word, 7) OVER one AS win
          FROM u WINDOW one AS (PARTITION BY doc_id ORDER BY pos)),
    c AS (SELECT doc_id, pos, word, before, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice
          FROM g),
    m AS (SELECT doc_id, word, before, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos
                                                            ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM c),
    r AS (SELECT doc_id, count_if(inside) AS n_repeat_words, count_if(word = before) AS n_adjacent FROM m GROUP BY 1),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
    f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                 length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 coalesce(n_adjacent, 0) AS n_adjacent, coalesce(n_lines, 0) AS n_lines
          FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
    b AS (SELECT *, (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
                    + 4 * (100 * n_symbols > 10 * n_words)::INT + 8 * (100 * n_adjacent > 30 * n_words)::INT
                    + 16 * (100 * n_dup_lines > 50 * n_lines)::INT + 32 * (word_chars < 2 * n_words)::INT
                    + 64 * (word_chars > 20 * n_words)::INT AS failures FROM f)
    SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
           failures % 4 <> 0 AS base_failed, failures = 0 AS kept, failures::BIGINT AS failures FROM b""")
def op3_quality_ledger(t):
    ledger = Q.build_ledger(t.documents)
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~Q.passes("base")).alias("base_failed"), Q.passes().alias("kept"), "failures")
