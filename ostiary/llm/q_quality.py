"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ostiary.llm import quality_cascade as quality
from ostiary.llm.registry import query, table

_SPACE = r"\x{09}-\x{0D}\x{20}"
_LINES = f"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]'))"
JUDGED = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^{_SPACE}]+') AS w, {_LINES} AS lines FROM d),
    placed AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    again AS (SELECT row, i FROM placed SEMI JOIN (SELECT row, gram FROM placed GROUP BY ALL HAVING count(*) > 1) g ON g.row = placed.row AND g.gram = placed.gram),
    repeated AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY row),
    top AS (SELECT row, max(n) AS n FROM (SELECT row, x, count(*) AS n FROM (SELECT row, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY row),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(top.n, 0) AS top, len(lines) AS n_lines,
        len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS letterless,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[{_SPACE}]*[-*•]'))) AS bullets,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{_SPACE}]*$'))) AS ellipses
        FROM w LEFT JOIN repeated r ON r.row = w.row LEFT JOIN top ON top.row = w.row)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR 10 * n_symbols > n_words
        OR 10 * n_dup_lines > 4 * n_lines OR 10 * letterless > 3 * n_words OR 10 * top > 3 * n_words OR 10 * bullets > 9 * n_lines
        OR 10 * ellipses > 3 * n_lines) AS kept
    FROM m"""


@query("op13_quality_rules", JUDGED)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.apply(docs, quality.plan(docs), measures=quality.MEASURES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality.MEASURES, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
