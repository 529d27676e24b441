"""Small hand-made inputs shared by the tests of the text operators."""

import random

from pyspark.sql import SparkSession

ODD = [None, "", " \t\n ", "One", "one  TWO\nthree", "a" * 5_000, "x, y. " * 3_000, "éa É 日本 👍🏽 ½ don't", "<|endoftext|> mid<|endoftext|>word"]
SYLLABLES = {"en": ["th", "er", "on", "an", "re", "he"], "fr": ["é", "eau", "tion", "oi", "ç", "ai"]}


def sentence(rng: random.Random, lang: str = "en", words: int = 60) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def documents(spark: SparkSession, texts: list, **more):
    """``doc_id, text`` and columns whose names clash with those that operators use inside."""
    rows = [(i, t, i, f"s{i}", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long, part string, fp int")


def empty(spark: SparkSession):
    return documents(spark, []).limit(0)
