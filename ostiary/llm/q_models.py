"""Queries of the model-based operators: language, toxicity, likelihood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ostiary.llm import common, langid, suffix_tree, toxicity
from ostiary.llm.registry import query, table


@query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = common.crc_remainder("doc_id", 3) == 1
    model = langid.fit(docs.filter(~held_out).select("doc_id", "text", F.col("lang").alias("label")))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def toxicity_examples(docs: DataFrame, labels: DataFrame, max_docs: int = toxicity.MAX_DOCS) -> DataFrame:
    """``doc_id, text, label`` of labelled training rows: about ``1.5 * max_docs`` of each class at most, chosen by a hash
    of the id, so that the ids can be broadcast and no text is shuffled. A document labelled twice is toxic if once."""
    label = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    label = common.checkpoint(label.filter(common.crc_remainder("doc_id", 3) != 1))
    sizes = label.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary")).first()
    share = F.when(F.col("label") == 1, 1.5 * max_docs / max(1, sizes["toxic"])).otherwise(1.5 * max_docs / max(1, sizes["ordinary"]))
    label = label.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select("doc_id", "text").join(F.broadcast(label), "doc_id")


@query("op9_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity_examples(docs, table(spark, folder, "labels")))
    held_out = (common.crc_remainder("doc_id", 3) == 1).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text", held_out), model).drop("text")


@query("op1_lm_scoring")
def likelihoods(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = common.crc_remainder("doc_id", 10) == 0
    return suffix_tree.score(docs.select("doc_id", "text", held_out.alias("held_out")), docs.filter(~held_out).select("text"))
