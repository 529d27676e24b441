"""Document fingerprints by consistent weighted sampling.

The terms of a text are its lower-cased (A-Z) words, weighted by how often they occur. For each of SAMPLES samples every
term draws r and c from Gamma(2, 1) and b from [0, 1), all fixed by a hash of the term and the sample's number; with
t = floor(ln(weight) / r + b) the term with the least ln(c) - r (t - b) - r wins and (term, t) is the sample. Two texts
agree in a sample with the probability of their generalised Jaccard similarity: the sum of the smaller weights over the
sum of the larger.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common

SAMPLES = 64
MEMO_TERMS = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniforms(keys: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for every key and sample."""
    salt = _mix(np.arange(SAMPLES, dtype=np.uint64) * np.uint64(3) + np.uint64(draw + 1))
    bits = _mix(keys[:, None] + _STEP * salt[None, :])
    scale = np.float32(2.0 ** -32)
    high, low = (bits >> np.uint64(32)).astype(np.float32), (bits & np.uint64(0xFFFFFFFF)).astype(np.float32)
    return np.minimum((high + np.float32(0.5)) * scale, np.float32(1 - 6e-8)), np.minimum((low + np.float32(0.5)) * scale, np.float32(1 - 6e-8))


def draws(terms: list) -> np.ndarray:
    """Per term, a word or (word, weight): the value that the least wins with, and a 16-bit name of (term, t)."""
    words = [t if isinstance(t, bytes) else t[0] for t in terms]
    logs = np.log(np.array([1.0 if isinstance(t, bytes) else t[1] for t in terms], np.float32))[:, None]
    keys = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = np.empty((len(terms), 2, SAMPLES), np.float32)
    with np.errstate(over="ignore"):
        for at in range(0, len(terms), 4_096):
            part = slice(at, at + 4_096)
            u, v = _uniforms(keys[part], 0)
            r = -np.log(u * v)
            u, v = _uniforms(keys[part], 1)
            c = -np.log(u * v)
            b, _ = _uniforms(keys[part], 2)
            t = np.floor(logs[part] / r + b)
            out[part, 0] = np.log(c) - r * (t - b) - r
            out[part, 1] = _mix(keys[part][:, None] + _STEP * (t.astype(np.int64).astype(np.uint64) + np.uint64(1))) >> np.uint64(48)
    return out


def memo() -> common.WordMemo:
    return common.once_per_worker(("samples",), lambda: common.WordMemo(draws, MEMO_TERMS))


def signature(text: str, known: common.WordMemo) -> np.ndarray | None:
    """16-bit samples of a text; None when it has no word."""
    counts = Counter(text.encode("utf-8", "replace").lower().split())
    if not counts:
        return None
    numbers = known.numbers([w if n == 1 else (w, n) for w, n in counts.items()])
    rows = known.values()
    winner = numbers[rows[numbers, 0].argmin(0)]
    found = rows[winner, 1, np.arange(SAMPLES)].astype(np.uint16)
    known.trim()
    return found


def digits(samples: np.ndarray | None) -> str:
    """Fingerprint as hexadecimal text, empty for a text without a word."""
    return "" if samples is None else samples.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples. Two texts without a word are alike, and unlike any other."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with its fingerprint: whole texts, one pass, no shuffle. Null counts as empty."""
    def compute(batch: pa.RecordBatch) -> list:
        known = memo()
        return [pa.array([digits(signature(t, known)) for t in common.texts_of(batch, text)], pa.string())]

    return common.with_columns(docs, f"`{name}` string", compute)


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose second half is overwritten by the next document's beginning.

    The next document has the next smaller id, after the last comes the first; null ids come last, rows with equal ids
    are ordered by a hash of the text. A null text counts as empty; a lone document is followed by itself.

    Ids are cut into buckets at quantiles; texts are shuffled once, by bucket, and each bucket also gets the first
    row of the one after it. Buckets are streamed in order, so no more than a batch is in memory.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = 4 * partitions
    cuts = rows.select("doc_id").stat.approxQuantile("doc_id", [i / steps for i in range(1, steps)], 0.25 / steps)
    cuts = sorted(set(cuts))
    splits = [float("-inf"), *cuts, float("inf")]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("_id", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_id", outputCol="_of", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("_of", F.lit(0.0))
    # the larger the id the earlier its bucket; null ids last
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(splits)).otherwise(len(splits) - F.col("_of").cast("int")))
    rows = rows.select("bucket", "doc_id", "tie", "text")
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie")).alias("top")).orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], EDITED)
    following = [(heads[i - 1]["bucket"], h["bucket"], h["top"]["id"], h["top"]["tie"]) for i, h in enumerate(heads)]
    wanted = spark.createDataFrame(following, "to int, bucket int, id long, tie long")  # one row a bucket
    same = (F.coalesce(rows["doc_id"], F.lit(-(1 << 63))) == wanted["id"]) & (rows["tie"] == wanted["tie"]) & (rows["bucket"] == wanted["bucket"])
    first = rows.join(F.broadcast(wanted), same).select(F.col("to").alias("bucket"), "doc_id", rows["tie"], "text").dropDuplicates(["bucket"])
    both = rows.withColumn("last", F.lit(0)).unionByName(first.withColumn("last", F.lit(1)))
    both = both.repartition(partitions, "bucket").sortWithinPartitions("bucket", "last", F.desc_nulls_last("doc_id"), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo()
        before = None  # bucket, id, text and samples of the row that waits for its next
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = [batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "last")]
            for bucket, doc, body, last in zip(*columns):
                samples = signature(body, known)
                if before is not None and before[0] == bucket:
                    _, previous, whole, own = before
                    half = len(whole) // 2
                    edited = whole[:len(whole) - half] + body[:half]
                    changed = signature(edited, known)
                    values = (previous, len(whole), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), digits(own),
                              digits(changed), likeness(own, changed), likeness(own, samples))
                    for column, value in zip(out, values):
                        column.append(value)
                before = None if last else (bucket, doc, body, samples)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return both.mapInArrow(run, EDITED)
