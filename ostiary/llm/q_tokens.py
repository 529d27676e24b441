"""Queries of the operators on tokens and benchmark items: decontamination, packing, record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ostiary.llm import common, decontaminate, packing, records, tokens
from ostiary.llm.registry import query, table


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"""
CONTAMINATED = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    placed AS (SELECT item, w, least({decontaminate.WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM placed),
    grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS key FROM (
      SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
    hits AS (SELECT doc_id, i, g.k AS k, item FROM grams g JOIN windows v ON v.k = g.k AND v.key = g.key),
    words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
    items AS (SELECT doc_id, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS digest FROM hits GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
      coalesce(digest, sha256('')) AS items_sha256, h.n IS NOT NULL AS contaminated
    FROM d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id"""


@query("op3_decontamination", CONTAMINATED)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op5_packing")
def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    pieces = common.checkpoint(packing.cut(table(spark, folder, "documents"), tokens.default_tokenizer()))
    return packing.pack(pieces)


@query("op7_token_records")
def token_records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return records.summary(records.write(docs, common.shared_folder(spark, "records"), tokens.default_tokenizer()))
