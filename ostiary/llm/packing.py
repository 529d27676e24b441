"""Vector bin packing of token pieces into sequences under simultaneous limits.

Every example has a demand in three dimensions: tokens, segments (one each) and loss-bearing tokens. A sequence takes
whichever waiting piece fits and has the largest dot product of its demand with the room left, all as shares of the
limits, until nothing fits. Buckets of pieces, split by a hash, are packed independently and in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common, tokens

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
BUCKET_PIECES = 8_192


def assign(lengths: np.ndarray, losses: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece. Pieces with the same demand are interchangeable and taken in order.

    A piece that alone exceeds a limit is an error. An empty piece takes a segment and no token.
    """
    room = np.array(limits, float)
    demand = np.stack([lengths, np.ones(len(lengths), np.int64), losses], 1)
    if len(demand) and (demand > room).any():
        raise ValueError("a piece exceeds a limit by itself")
    kinds, inverse = np.unique(demand, axis=0, return_inverse=True)
    by = np.argsort(inverse.ravel(), kind="stable")
    left = np.bincount(inverse.ravel(), minlength=len(kinds))
    next_of = np.cumsum(left) - left
    shares = kinds / room
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = -1
    while len(kinds):
        number += 1
        used = np.zeros(3)
        while True:
            fits = (kinds <= room - used).all(1) & (left > 0)
            if not fits.any():
                break
            gain = np.where(fits, shares @ ((room - used) / room), -1.0)
            kind = len(gain) - 1 - int(np.argmax(gain[::-1]))  # ties: the longest
            item = by[next_of[kind]]
            sequence[item], offset[item] = number, int(used[0])
            used += kinds[kind]
            next_of[kind] += 1
            left[kind] -= 1
        keep = left > 0
        if not keep.all():
            kinds, shares, left, next_of = kinds[keep], shares[keep], left[keep], next_of[keep]
    return sequence, offset


def pack(pieces: DataFrame, length: str = "length", loss: str | None = None, max_tokens: int = MAX_TOKENS,
         max_segments: int = MAX_SEGMENTS, max_loss_tokens: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``loss`` names the column of loss-bearing tokens (default: all of a piece's tokens). Null lengths count as 0. The
    table should be materialised: it is counted first, and a row's bucket comes from its place. Buckets hold about
    BUCKET_PIECES rows; each leaves at most a few sequences that are not full.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss_tokens is None else max_loss_tokens)
    buckets = max(1, -(-pieces.count() // BUCKET_PIECES))
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(*names).withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema) + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column(length).fill_null(0).to_numpy().astype(np.int64)
        losses = table.column(loss).fill_null(0).to_numpy().astype(np.int64) if loss else lengths
        sequence, offset = assign(lengths, losses, limits)
        base = table.column("_bucket")[0].as_py() << 40
        return table.drop_columns(["_bucket"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return rows.groupBy("_bucket").applyInArrow(run, schema)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` of every document's ids (with the end id), with ``ids`` if asked for.

    Null and empty texts give one piece with the end id. Repeated rows are documents of their own.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    schema = PIECES + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in common.slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            parts = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(common.bytes_of(batch, "text"))):
                found = np.append(found, np.uint32(tokens.END_ID)).astype("<u4")
                for at in range(0, len(found), max_tokens):
                    part = found[at:at + max_tokens]
                    for column, value in zip(columns, (doc, at, len(part), zlib.crc32(part.data), len(found))):
                        column.append(value)
                    if ids:
                        parts.append(part.astype(np.int32))
            if columns[0]:
                arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(parts, pa.list_(pa.int32()))] if ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids)

    return rows.mapInArrow(run, schema)


def sequences(packed: DataFrame, max_tokens: int = MAX_TOKENS, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, segments, loss_mask`` from packed pieces that carry ``ids``: concatenated in offset order.

    Ids are padded to ``max_tokens`` unless the length is a power of two; padding has segment 0 and no loss.
    """
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["offset", "doc_id", "start"])
        parts = [np.asarray(x, np.int32) for x in pdf["ids"]]
        total = sum(map(len, parts))
        padding = 0 if total and total & (total - 1) == 0 else max_tokens - total
        segments = [np.full(len(p), i, np.int32) for i, p in enumerate(parts, 1)]
        fill = np.zeros(padding, np.int32)
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.concatenate([*parts, fill + pad_id])],
                             "segments": [np.concatenate([*segments, fill])], "loss_mask": [np.repeat([1, 0], [total, padding])]})

    # a sequence has at most max_tokens ids, so a group is small
    return packed.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<int>, segments array<int>, loss_mask array<int>")
