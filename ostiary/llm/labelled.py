"""Bounded samples of labelled documents and the Kneser-Ney models fitted on them.

Only the fitting uses a sample. Its bounds are parameters: at most about ``max_docs`` documents and ``max_chars``
characters for each label, chosen by a hash of the text, each different text once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ostiary.llm import common, kneser_ney

WORD = re.compile(r"[^\W\d_]+")
FOLDS = 5  # one of so many parts of the sample calibrates, the others train
_SHARE = 1 << 20


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased and composed: a letter typed with a separate accent is the same letter."""
    return WORD.findall(unicodedata.normalize("NFC", text).lower())


def sample(labelled: DataFrame, max_docs: int, max_chars: int) -> tuple[DataFrame, list]:
    """``text, label, part`` of the bounded sample, and the sorted labels.

    ``labelled`` has ``doc_id, text, label``; rows with a null label or text are no examples. Texts repeated under one
    label count once. Labels are few (languages or classes): their list goes to the driver, at most 10,000.
    """
    rows = labelled.filter("label IS NOT NULL AND text IS NOT NULL")
    mark = F.xxhash64("text")
    # one row per different text, without the text
    known = common.checkpoint(rows.select("label", mark.alias("mark"), "doc_id", F.length("text").alias("size"))
                              .groupBy("label", "mark").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size")))
    totals = known.groupBy("label").agg(F.count("*").alias("docs"), F.sum("size").alias("chars")).limit(10_001).collect()
    if len(totals) > 10_000:
        raise ValueError("over 10,000 different labels")
    shares = {r["label"]: min(1.0, max_docs / r["docs"], max_chars / max(1, r["chars"])) for r in totals}
    limit = F.lit(0)
    for label, share in shares.items():
        limit = F.when(F.col("label") == F.lit(label), int(share * _SHARE)).otherwise(limit)
    bits = F.shiftrightunsigned("mark", 40) % _SHARE
    chosen = known.filter(bits < limit).select("doc_id", F.col("label").alias("_label"), "mark")
    # bounded by max_docs a label, hence the broadcast
    taken = rows.join(F.broadcast(chosen), (rows["doc_id"] == chosen["doc_id"]) & (rows["label"] == chosen["_label"])
                      & (mark == chosen["mark"])).select("text", "label", (F.pmod("mark", F.lit(FOLDS))).cast("int").alias("part"))
    return taken, sorted(shares)


def index_of(labels: list) -> Column:
    """Number of the row's label; comparisons instead of a lookup, as labels are few."""
    number = F.lit(None).cast("int")
    for i, label in enumerate(labels):
        number = F.when(F.col("label") == F.lit(label), i).otherwise(number)
    return number


def fit(taken: DataFrame, labels: list, order: int, shared: int = 0) -> kneser_ney.Model:
    """Model of all parts but the last: words are counted, then grams of the counted words, both by Spark.

    What comes to the driver is the table of different grams of the bounded sample.
    """
    train = taken.filter(F.col("part") < FOLDS - 1).select("text", index_of(labels).alias("column"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, column in zip(common.texts_of(batch, "text"), batch.column("column").to_pylist()):
                counts.update((column, w) for w in words_of(text))
            if counts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([c for c, _ in counts], pa.int32()), pa.array([w for _, w in counts], pa.string()),
                    pa.array(list(counts.values()), pa.int64())], names=["column", "word", "n"])

    words = train.mapInArrow(count_words, "column int, word string, n long").groupBy("column", "word").agg(F.sum("n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = kneser_ney.grams(batch.column("word").to_pylist(), batch.column("column").to_numpy(),
                                      batch.column("n").to_numpy(), order)
            for k, opens, gram, context, suffix, column, n in pieces if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(gram), k, np.int32)), pa.array(opens), pa.array(gram.view(np.int64)),
                    pa.array(context.view(np.int64)), pa.array(suffix.view(np.int64)), pa.array(column), pa.array(n)],
                    names=["k", "opens", "gram", "context", "suffix", "column", "n"])

    grams = (words.mapInArrow(cut, "k int, opens boolean, gram long, context long, suffix long, column int, n long")
             .groupBy("k", "gram", "column").agg(F.first("opens"), F.first("context"), F.first("suffix"), F.sum("n").alias("n")))
    k, gram, column, opens, context, suffix, n = (x.to_numpy() for x in grams.toArrow().combine_chunks().columns)
    return kneser_ney.build((k, opens, gram.view(np.uint64), context.view(np.uint64), suffix.view(np.uint64), column, n),
                            len(labels), order, shared)
