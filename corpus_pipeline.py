"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the last return the columns
of ``documents``. Clean documents pass all filters; an empty table stays empty. Models are learned in their stage,
from the rows that reached it, by the same rules as in the single queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ostiary.llm import common, decontaminate, langid, near_copies, packing, tokens, toxicity
from ostiary.llm.q_models import toxicity_examples


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that language ID rejects, letterless ones included, go."""
    train = docs.filter(common.crc_remainder("doc_id", 3) != 1)
    model = langid.fit(train.select("doc_id", "text", F.col("lang").alias("label")))
    return langid.identify(docs, model).filter("NOT rejected").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.fit(toxicity_examples(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a Jaccard similarity of 5-word shingles of 0.8 or more."""
    return near_copies.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("NOT contaminated").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(common.checkpoint(packing.cut(docs, tokens.default_tokenizer())))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Models, bit fingerprints and packing are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
