"""Query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ostiary.llm import prefix_trie
from ostiary.llm.registry import query, table

# crc32 by its table of 256 entries; every node is named by the joined digests of its turns.
PREFIXES = """
    WITH codes AS (SELECT list(list_reduce(list_prepend(i, range(8)),
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS code FROM range(256) t(i)),
    own AS (SELECT conv_id AS c, coalesce(text, '') AS text,
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
        FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT c, digest, strlen(text) AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos FROM own),
    ids AS (SELECT c, c - c % 5 AS first, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda a, x: xor(a >> 8, code[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h
        FROM (SELECT DISTINCT c FROM turns), codes),
    taken AS (SELECT i.c, t.pos AS d, digest, size FROM ids i JOIN turns t ON t.c = i.first AND t.pos <= i.h),
    shift AS (SELECT i.c, h, count(t.d) - h AS moved FROM ids i LEFT JOIN taken t ON t.c = i.c GROUP BY i.c, h),
    rebuilt AS (SELECT * FROM taken UNION ALL SELECT t.c, t.pos + moved, digest, size FROM turns t JOIN shift s ON s.c = t.c WHERE t.pos > h),
    paths AS (SELECT i.c, coalesce(list(digest ORDER BY d) FILTER (digest IS NOT NULL), []) AS p, coalesce(list(size ORDER BY d) FILTER (digest IS NOT NULL), []) AS sizes
        FROM ids i LEFT JOIN rebuilt r ON r.c = i.c GROUP BY i.c),
    members AS (SELECT c, d, array_to_string(p[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(p[1:d - 1], '') END AS above, sizes[d] AS size, len(p) = d AS ends
        FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)),
    nodes AS (SELECT node, d, any_value(above) AS above, min(c) AS c, count(*) AS n, any_value(size) AS size,
        sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM members GROUP BY node, d),
    children AS (SELECT above, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
    below AS (SELECT left(v.node, 64 * a) AS node, count(*) FILTER (k.n IS NULL) AS leaves, sum((v.n - 1) * coalesce(v.size, 0)) AS saved
        FROM (SELECT *, unnest(range(d + 1)) AS a FROM nodes) v LEFT JOIN children k ON k.above = v.node GROUP BY 1)
    SELECT v.c AS conv_id, v.d::BIGINT AS depth, u.c AS parent_conv_id, v.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
      b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
    FROM nodes v LEFT JOIN nodes u ON u.node = v.above LEFT JOIN children k ON k.above = v.node JOIN below b ON b.node = v.node"""


@query("op12_prefix_trie", PREFIXES)
def conversation_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
