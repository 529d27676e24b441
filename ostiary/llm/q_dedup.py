"""Queries of the operators on similar texts: SimHash groups, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ostiary.llm import common, simhash, weighted_sampling
from ostiary.llm.registry import query, table


@query("op2_simhash")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.checkpoint(simhash.with_fingerprint(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "fp"))
    return docs.join(simhash.components(docs), "fp").select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op6_fingerprints")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_sampling.compare_with_edited(table(spark, folder, "documents"))
