"""Query of the alignment of two tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ostiary.llm import alignment
from ostiary.llm.registry import query, table


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.summary(table(spark, folder, "documents"))
