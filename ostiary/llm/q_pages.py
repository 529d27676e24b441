"""Queries of the operators on pages and notices: HTML extraction, licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ostiary.llm import html_text, license_scan
from ostiary.llm.registry import query, table


@query("op4_html_text")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html")).drop("html")


@query("op8_license_scan")
def license_notices(spark: SparkSession, folder: str) -> DataFrame:
    """One row per notice found, with its document and the wording it differs in."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = license_scan.scan(docs).select("doc_id", F.posexplode("licenses").alias("notice", "found"))
    return found.select(
        "doc_id", F.col("notice").cast("long").alias("notice"), "found.license", "found.start", "found.end", "found.reduction", "found.wording",
        F.concat_ws(" ", "found.missing").alias("missing"), F.concat_ws(" ", "found.added").alias("added"))
