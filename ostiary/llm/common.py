"""Helpers shared by the text operators: per-row columns computed in Arrow batches, memoised word values, crc splits."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ostiary import scale

SLICE_ROWS = 1_000
# Words gathered from consecutive documents before values are looked up together.
CHUNK_WORDS = 400_000
# Distinct words, and bytes of them, that one Python worker remembers before it starts anew.
MEMO_WORDS = 200_000
MEMO_BYTES = 24_000_000


def checkpoint(df: DataFrame) -> DataFrame:
    return scale.checkpoint(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    scale.checkpoint(spark.range(0))  # makes sure that the folder is set
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def crc_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``: fixes training and held-out rows. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null becomes the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes the empty text."""
    values = batch.column(column)
    if not (pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)):
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return [x or b"" for x in values.to_pylist()]


def free_names(df: DataFrame, count: int) -> list[str]:
    """Column names that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [n for n in (f"_free{i}" for i in range(count + len(taken))) if n not in taken][:count]


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what is built beside a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_columns(docs: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], Iterable]) -> DataFrame:
    """``docs`` with the columns ``fields`` (DDL) that ``compute`` returns for each Arrow batch, in order.

    Every other column travels along untouched, so no join by id is needed and repeated ids do no harm.
    A column of ``docs`` with the name of a new one is replaced.
    """
    added = StructType.fromDDL(fields)
    names = {f.name.lower() for f in added}
    kept = [f for f in docs.schema if f.name.lower() not in names]
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                new = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in compute(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in order] + new, names=order + [f.name for f in added])

    return docs.mapInArrow(run, StructType(kept + list(added)))


def joined_digest(parts: DataFrame, key: str, separator: bytes, key_type: str = "long") -> DataFrame:
    """``key, sha256``: SHA-256 of the ``body`` values of each key joined in the order of ``place``.

    Sorted bodies stream through the hash one by one, so nothing is held as a whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            for name, body in zip(batch.column(key).to_pylist(), batch.column("body").to_pylist()):
                if digest is not None and name == current:
                    digest.update(separator + body)
                    continue
                if digest is not None:
                    yield pa.RecordBatch.from_pylist([{key: current, "sha256": digest.hexdigest()}], schema)
                current, digest = name, hashlib.sha256(body)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{key: current, "sha256": digest.hexdigest()}], schema)

    schema = pa.schema([(key, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type]), ("sha256", pa.string())])
    ordered = parts.select(key, "place", "body").repartition(key).sortWithinPartitions(key, "place").select(key, "body")
    return ordered.mapInArrow(run, f"`{key}` {key_type}, sha256 string")


class _Ids(dict):
    """Word to row number; an unknown word gets the next number and waits in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list = []
        self.bytes = 0

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        self.bytes += len(word)
        return number


class WordMemo:
    """One row of numbers per distinct word, computed once per worker for as long as it is remembered.

    ``compute(words)`` returns an array with one row per word. The memo starts anew when it holds ``most`` words
    or MEMO_BYTES bytes of them; values do not depend on what it holds.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], most: int = MEMO_WORDS) -> None:
        self.compute = compute
        self.most = most
        self.ids = _Ids()
        self.rows: np.ndarray | None = None

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def values(self) -> np.ndarray:
        """Rows for all numbers given out so far."""
        fresh = self.ids.fresh
        if fresh or self.rows is None:
            new = self.compute(fresh)
            have = len(self.ids) - len(fresh)
            if self.rows is None or len(self.rows) < len(self.ids):
                grown = np.empty((max(1024, 2 * len(self.ids)),) + new.shape[1:], new.dtype)
                if have:
                    grown[:have] = self.rows[:have]
                self.rows = grown
            self.rows[have:len(self.ids)] = new
            self.ids.fresh = []
        return self.rows

    def trim(self) -> None:
        if len(self.ids) > self.most or self.ids.bytes > MEMO_BYTES:
            self.ids, self.rows = _Ids(), None

    def reduce(self, docs: Iterable[list], maxima: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document the sum of its words' rows, their maxima (zeros unless asked for) and its number of words."""
        sizes_of: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        pending: list[np.ndarray] = []
        waiting = 0
        for words in docs:
            sizes_of.append(len(words))
            pending.append(self.numbers(words))
            waiting += len(words)
            if waiting >= CHUNK_WORDS:
                parts.append(self._reduced(pending, maxima))
                pending, waiting = [], 0
        parts.append(self._reduced(pending, maxima))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array(sizes_of, np.int64)

    def _reduced(self, pending: list[np.ndarray], maxima: bool) -> tuple[np.ndarray, np.ndarray]:
        rows = self.values()
        sums = np.zeros((len(pending),) + rows.shape[1:])
        largest = np.zeros_like(sums)
        sizes = np.array([len(x) for x in pending], np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            taken = rows[np.concatenate(pending)].astype(np.float64)
            starts = (np.cumsum(sizes) - sizes)[full]
            sums[full] = np.add.reduceat(taken, starts, axis=0)
            if maxima:
                largest[full] = np.maximum.reduceat(taken, starts, axis=0)
        self.trim()
        return sums, largest


_KEPT: dict = {}


def once_per_worker(key: tuple, make: Callable):
    """``make()`` once per Python worker and key.

    Workers outlive a job, so what belongs to another owner, the key's last part, is dropped first.
    """
    if key not in _KEPT:
        for other in [k for k in _KEPT if k[-1] != key[-1]]:
            del _KEPT[other]
        _KEPT[key] = make()
    return _KEPT[key]
