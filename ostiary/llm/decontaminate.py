"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, run once over each text.

Texts and items are lower-cased (A-Z) and reduced to words. Every run of ``window`` consecutive words of an item, or a
shorter item as a whole, is a pattern; occurrences are mapped back to offsets of the original text.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common

WINDOW = 10
# Items are a test set, not a corpus: more text than this is an error, so what is broadcast stays bounded.
MAX_ITEM_BYTES = 256_000_000
FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"

# A-Z to a-z, other ASCII but a-z and 0-9 to a blank; bytes of longer characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _joined(words: list[bytes]) -> str:
    """Words between blanks, one character per byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def patterns(items: list[tuple[str, bytes]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern to its number of words and the items it stems from."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = text.translate(_PLAIN).split()
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            found.setdefault(_joined(words[at:at + size]), (size, set()))[1].add(item)
    return {p: (size, sorted(owners)) for p, (size, owners) in found.items()}


def automaton(items: list[tuple[str, bytes]], window: int):
    built = ahocorasick.Automaton()
    for pattern, value in patterns(items, window).items():
        built.add_word(pattern, value)
    if len(built):
        built.make_automaton()
    return built


def scan(text: bytes, built) -> tuple[int, int, list[str], list[dict]]:
    """Number of words, of hit words, item ids, and hit stretches as offsets of characters in the original."""
    plain = text.translate(_PLAIN)
    words = plain.split()
    if not words or not len(built):
        return len(words), 0, [], []
    hits = list(built.iter(_joined(words)))
    if not hits:
        return len(words), 0, [], []
    ends_at = np.cumsum([len(w) + 1 for w in words])  # of the blank after each word
    last = np.searchsorted(ends_at, [end for end, _ in hits])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last + 1, -1)
    np.add.at(change, last + 1 - np.array([size for _, (size, _) in hits]), 1)
    hit = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    solid = np.frombuffer(plain, np.uint8) != 32
    borders = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    raw = np.frombuffer(text, np.uint8)
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # before each byte
    spans = [{"start": int(characters[borders[2 * a]]), "end": int(characters[borders[2 * b - 1]])} for a, b in zip(edges[::2], edges[1::2])]
    return len(words), int(hit.sum()), sorted({i for _, (_, owners) in hits for i in owners}), spans


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_hit, items`` (sorted as text)``, spans, contaminated`` for every row; no shuffle.

    Null texts have no words. Items without a word or with a null id cannot occur; repeated items count once.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"the items hold {size} bytes of text; the limit is {MAX_ITEM_BYTES}")
    shipped = spark.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in wanted.collect()])
    key = uuid.uuid4().hex

    def compute(batch: pa.RecordBatch) -> list:
        built = common.once_per_worker(("automaton", key), lambda: automaton(shipped.value, window))
        rows = [scan(t, built) for t in common.bytes_of(batch, text)]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
                pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([r[1] > 0 for r in rows], pa.bool_())]

    return common.with_columns(docs, FIELDS, compute)
