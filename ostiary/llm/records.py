"""Token ids in length-delimited binary record files, with a separate offset index for shuffled reads.

A record is the data's length (8 bytes), the length's masked CRC-32C, the data, and the data's masked CRC-32C (4 bytes
each, little-endian): the common framing of record files. The data is the document's id (8 bytes) and its token ids,
2 bytes each while the vocabulary allows it, else 4.

Each task writes one file under a name of its own and returns the file's index rows; only the index that was written
names files, so a task that ran twice or died leaves nothing but an unused file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ostiary.llm import common, crc32c, tokens

NULL_ID = -(1 << 63)  # stands for a null id in a file
READ_BYTES = 8_000_000
INDEX = "shard int, row long, path string, offset long, size long, n_tokens long"


def open_store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that Spark names: a URI or a plain path."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    if "://" in folder:
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder


@dataclass
class Store:
    """Written records: the folder, the width of an id in bytes, and the index (a Parquet table below the folder)."""

    spark: SparkSession
    folder: str
    width: int

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")


def frame(parts: list[bytes]) -> list[bytes]:
    """Records around the data parts."""
    heads = [len(p).to_bytes(8, "little") for p in parts]
    marks = crc32c.masked(crc32c.checksums(heads)).astype("<u4")
    tails = crc32c.masked(crc32c.checksums(parts)).astype("<u4")
    return [h + m.tobytes() + p + t.tobytes() for h, m, p, t in zip(heads, marks, parts, tails)]


def unframe(blob: bytes) -> list[bytes]:
    """Data parts of consecutive records; a wrong length or checksum is an error."""
    heads, parts, marks = [], [], []
    at = 0
    while at < len(blob):
        head = blob[at:at + 8]
        size = int.from_bytes(head, "little")
        if at + 16 + size > len(blob):
            raise ValueError("a record is cut short")
        heads.append(head)
        parts.append(blob[at + 12:at + 12 + size])
        marks.append((blob[at + 8:at + 12], blob[at + 12 + size:at + 16 + size]))
        at += 16 + size
    for found, want in ((heads, 0), (parts, 1)):
        stored = np.frombuffer(b"".join(m[want] for m in marks), "<u4")
        if (crc32c.masked(crc32c.checksums(found)) != stored).any():
            raise ValueError("a record's checksum is wrong")
    return parts


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int = 1 << 16, doc_id: str = "doc_id", text: str = "text") -> Store:
    """Encode whole texts, append the end id, and write them in ascending id order, one file per range of ids.

    Null texts count as empty (a record with the end id only); null ids come first; rows with equal ids are ordered by
    a hash of the text. Only ids and texts are shuffled.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, path = open_store(folder)
        name = f"{path}/part-{shard:06d}-{uuid.uuid4().hex}.rec"
        encoder = tokens.encoder(tokenizer)
        offset = row = 0
        out = None
        for batch in common.slices(batches):
            ids = [NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            parts, counts = [], []
            for i, found in zip(ids, encoder.encode(common.bytes_of(batch, "text"))):
                parts.append(i.to_bytes(8, "little", signed=True) + np.append(found, tokens.END_ID).astype(f"<u{width}").tobytes())
                counts.append(len(found) + 1)
            records = frame(parts)
            if not records:
                continue
            if out is None:
                out = store.open_output_stream(name)
            out.write(b"".join(records))
            sizes = np.array([len(r) for r in records])
            n = len(records)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n)), pa.array([name] * n),
                pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(counts, pa.int64())],
                names=["shard", "row", "path", "offset", "size", "n_tokens"])
            offset, row = offset + int(sizes.sum()), row + n
        if out is not None:
            out.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return Store(docs.sparkSession, folder, width)


def read(store: Store, entries: DataFrame) -> DataFrame:
    """Index rows ``entries`` with ``doc_id, ids`` read from the files and checked; any subset in any order will do.

    Each task opens the files it needs and reads neighbouring records together.
    """
    folder, width = store.folder, store.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_store(folder)
        for batch in batches:
            path, offset, size = (batch.column(c).to_pylist() for c in ("path", "offset", "size"))
            start = 0
            while start < len(path):
                end = start + 1
                while (end < len(path) and path[end] == path[start] and offset[end] == offset[end - 1] + size[end - 1]
                       and offset[end] + size[end] - offset[start] <= READ_BYTES):
                    end += 1
                with files.open_input_file(path[start]) as file:
                    parts = unframe(file.read_at(offset[end - 1] + size[end - 1] - offset[start], offset[start]))
                ids = [int.from_bytes(p[:8], "little", signed=True) for p in parts]
                found = [np.frombuffer(p, f"<u{width}", offset=8).astype(np.int32) for p in parts]
                lengths = np.array([len(x) for x in found])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate(found)))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    part.columns + [pa.array([None if i == NULL_ID else i for i in ids], pa.int64()), lists],
                    names=part.schema.names + ["doc_id", "ids"])
                start = end

    return entries.mapInArrow(run, f"{INDEX}, doc_id long, ids array<int>")


def summary(store: Store) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, from the files.

    A file's records before a row are summed along the index; sums of whole files (one row per file) carry over.
    """
    index = store.index
    files = index.groupBy("shard", "path").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    files = files.select("path", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    shards = max(1, int(store.spark.conf.get("spark.sql.shuffle.partitions")))
    entries = index.repartition(shards, "path").sortWithinPartitions("path", "offset")
    width = store.width

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running totals within a file; its rows come in order, all in one task."""
        path, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, values = batch.column("ids").offsets.to_numpy(), batch.column("ids").values.to_numpy().astype("<u4")
            sizes = np.diff(offsets)
            starts, crcs = [], []
            for i, name in enumerate(batch.column("path").to_pylist()):
                if name != path:
                    path, total = name, 0
                starts.append(total)
                total += int(sizes[i])
                crcs.append(zlib.crc32(values[offsets[i]:offsets[i + 1]].data))
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("doc_id"), pa.array(starts), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                names=["path", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = read(store, entries).mapInArrow(measure, "path string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(files), "path").select(  # one row per file
        "doc_id", (F.col("within") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
