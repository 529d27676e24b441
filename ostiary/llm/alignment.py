"""Alignment of the tokens of two tokenizers over whole texts, composed from fragments of byte ranges.

Both tokenizers cut ``blank + text`` into tokens that cover all its bytes. A *group* ends wherever tokens of both end; the
last tokens of both in a group are *linked*. The tokens that end inside a range of bytes make a fragment:

    open prefix | closed groups | open suffix

The prefix reaches to the first end that both share, the suffix begins after the last. Two neighbouring fragments compose
to one: the left suffix and the right prefix are one group. Composition is associative and the empty fragment is its
identity, so the ranges of a very long text are encoded by different tasks and composed in a tree of FAN to one.
Closed groups never move up the tree: they are written where they were found, with their place in the text.

A text of up to CHUNK_BYTES is one range and needs no composition. Encoding goes by units, white space and what follows it
up to the next: neither tokenizer joins tokens across the end of a unit, which the constructor checks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common
from ostiary.llm.suffix_tree import largest
from ostiary.llm.tokens import _byte_letters

CHUNK_BYTES = 65_536
# A range's edge inside a longer stretch without white space is given up, so that hardly any byte is encoded twice.
LONGEST_UNIT = 4_096
FAN = 16
# Linked pairs whose counts go to every executor; the counts of all others are looked up by a join.
COMMON_PAIRS = 200_000
MOST_UNITS = 300_000
MOST_UNIT_BYTES = 12_000_000
FLUSH_KEYS = 2_000_000
B_BITS = 32

_UNIT_START = re.compile(r"(?<=[!-~])(?=[ \n])")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class PairEncoder:
    """Encodes with both tokenizers; knows every token's bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as file:
            stated = json.load(file)
        cuts = stated["pre_tokenizer"] or {}
        if stated["normalizer"] is not None or cuts.get("type") != "ByteLevel" or not cuts["use_regex"] or cuts["add_prefix_space"]:
            raise ValueError("the first tokenizer must be a byte-level BPE that begins a piece at white space")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {chr(c): bytes([b]) for b, c in _byte_letters().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [b"".join(letters.get(c, c.encode()) for c in name) for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁][▁]|\n", p) for p in pieces):
            raise ValueError("the second tokenizer must not join tokens across white space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # written forms of ids with what follows them: next of its kind, end of the group's first part, end of the group
        self.written = [b"%d%s" % (i, after) for size, after in ((len(names), b","), (len(names), b"|"), (len(pieces), b","), (len(pieces), b";"))
                        for i in range(size)]
        self.forms = np.cumsum([0, len(names), len(names), len(pieces)])

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # a line feed before a unit keeps its own first blank: it makes two tokens, which are dropped
        b = [ids[2:] for ids in self.b.encode(["\n" + u for u in units], num_threads=1)]
        return a, b

    def fits(self, unit: str, a: list[int], b: list[int]) -> bool:
        """True when the bytes of both tokenizers' tokens are the unit's."""
        body = unit.encode()
        return b"".join([self.a_bytes[i] for i in a]) == body == b"".join([self.b_bytes[i] for i in b])

    def write(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Written ids in the order of groups, and where each group ends among them; ``*_last`` mark the last ids of groups."""
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = a + self.forms[np.where(a_last, 1, 0)]
        order[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = b + self.forms[np.where(b_last, 3, 2)]
        return list(map(self.written.__getitem__, order.tolist())), np.cumsum(sizes_a + sizes_b)


@dataclass
class Fragment:
    """Tokens ending in one range. ``cut``: an end that both share lies in it; without one all tokens are in the prefix.

    ``at`` is the first range with such an end: the prefix's group closes there.
    """

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    cut: bool = False
    at: int = 0
    valid: bool = True
    n_a: int = 0
    n_b: int = 0


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
    """Both as one fragment, and the group ``(at, a, b)`` that this closed, if it closed one."""
    valid, n_a, n_b = left.valid and right.valid, left.n_a + right.n_a, left.n_b + right.n_b
    if not left.cut:
        joined = (left.prefix[0] + right.prefix[0], left.prefix[1] + right.prefix[1])
        return Fragment(joined, right.suffix, right.cut, right.at, valid, n_a, n_b), None
    middle = (left.suffix[0] + right.prefix[0], left.suffix[1] + right.prefix[1])
    if not right.cut:
        return Fragment(left.prefix, middle, True, left.at, valid, n_a, n_b), None
    return Fragment(left.prefix, right.suffix, True, left.at, valid, n_a, n_b), (right.at, *middle)


def _group(a: list[int], b: list[int]) -> bytes:
    return b"%s|%s" % (b",".join(b"%d" % i for i in a), b",".join(b"%d" % i for i in b))


def _pair_key(a, b):
    return (a << B_BITS) | b


class Units:
    """What each different unit contributes, remembered: counts, its groups as written, the keys of its links."""

    def __init__(self, encoder: PairEncoder) -> None:
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.ids = common._Ids()
        self.groups: list[bytes] = []
        self.numbers = np.zeros((0, 4), np.int64)  # valid, tokens of a, tokens of b, groups
        self.keys = np.zeros(0, np.int64)

    def add(self, fresh: list[str]) -> None:
        enc = self.encoder
        a, b = enc.encode(fresh)
        good = np.array([enc.fits(*x) for x in zip(fresh, a, b)], bool)
        numbers = np.zeros((len(fresh), 4), np.int64)
        numbers[:, 0] = good
        a_sizes = np.array([len(x) if g else 0 for x, g in zip(a, good)], np.int64)
        b_sizes = np.array([len(x) if g else 0 for x, g in zip(b, good)], np.int64)
        groups = [b""] * len(fresh)
        keys = np.zeros(0, np.int64)
        if good.any():
            flat_a = np.array([i for x, g in zip(a, good) if g for i in x], np.int64)
            flat_b = np.array([i for x, g in zip(b, good) if g for i in x], np.int64)
            # valid units one after the other: ends that both share, a unit's end always among them
            ends_a, ends_b = np.cumsum(enc.a_sizes[flat_a]), np.cumsum(enc.b_sizes[flat_b])
            a_last, b_last = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
            keys = _pair_key(flat_a[a_last], flat_b[b_last])
            parts, ends = enc.write(flat_a, flat_b, a_last, b_last)
            of_unit = np.concatenate([[0], np.cumsum(a_last)])[np.concatenate([[0], np.cumsum(a_sizes)])]
            numbers[:, 1], numbers[:, 2], numbers[:, 3] = a_sizes, b_sizes, np.diff(of_unit)
            at = np.concatenate([[0], ends])[of_unit].tolist()
            groups = [b"".join(parts[i:j])[:-1] for i, j in zip(at, at[1:])]
        self.groups += groups
        self.numbers = np.concatenate([self.numbers, numbers])
        self.keys = np.concatenate([self.keys, keys])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: valid, counts (n x 3), the digest of its groups; the keys of all links and how many each text has."""
        found, sizes = [], []
        for text in texts:
            units = _UNIT_START.split(" " + text) if text else []
            sizes.append(len(units))
            found.append(np.fromiter(map(self.ids.__getitem__, units), np.int64, len(units)))
        if self.ids.fresh:
            self.add(self.ids.fresh)
            self.ids.fresh = []
        sizes = np.array(sizes, np.int64)
        units = np.concatenate([*found, np.zeros(0, np.int64)])
        of_text = np.repeat(np.arange(len(texts)), sizes)
        sums = np.stack([np.bincount(of_text, self.numbers[units, j], len(texts)) for j in range(4)], 1).astype(np.int64)
        valid = (sums[:, 0] == sizes) & (sizes > 0)
        digests = [hashlib.sha256(b";".join(map(self.groups.__getitem__, own.tolist()))).hexdigest() if good else ""
                   for own, good in zip(found, valid.tolist())]
        keep = valid[of_text]
        first = np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3]
        keys = self.keys[_ragged(first[units[keep]], self.numbers[units[keep], 3])]
        counts = np.where(valid[:, None], sums[:, 1:], 0)
        if len(self.ids) > MOST_UNITS or self.ids.bytes > MOST_UNIT_BYTES:
            self.clear()
        return valid, digests, counts, keys, counts[:, 2]


def _units(a_path: str, b_path: str) -> Units:
    return common.once_per_worker(("alignment", a_path, b_path), lambda: Units(PairEncoder(a_path, b_path)))


def _counted(keys: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Different keys of each row and how often each occurs, as list columns."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((keys, row))
    keys, row = keys[by], row[by]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(sizes)))]), pa.int32())
    times = np.diff(np.append(at, len(keys)))
    return pa.ListArray.from_arrays(offsets, pa.array(keys[at])), pa.ListArray.from_arrays(offsets, pa.array(times))


COUNTS = "n_a long, n_b long, n_groups long"
SHORT = f"row long, doc_id long, {COUNTS}, groups_sha256 string, keys array<long>, times array<long>"
RANGE = "row long, doc_id long, chunk long, low long, high long, begin long, body binary"
OPEN = ("row long, doc_id long, chunk long, cut boolean, at long, valid boolean, n_a long, n_b long, prefix_a array<int>, "
        "prefix_b array<int>, suffix_a array<int>, suffix_b array<int>")
CLOSED = "row long, place long, n_groups long, groups binary, keys array<long>, times array<long>"
# one stage returns open ends and closed groups together; a column that a row does not use is null
BOTH = OPEN + ", place long, n_groups long, groups binary, keys array<long>, times array<long>"


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: its lineage ends and rows keep their numbers."""
    path = common.shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _short(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(*paths)
        for batch in common.slices(batches):
            if batch.num_rows:
                texts = [t.decode("utf-8", "replace") for t in common.bytes_of(batch, "text")]
                _, digests, counts, keys, sizes = units.texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), *map(pa.array, counts.T), pa.array(digests), *_counted(keys, sizes)],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "keys", "times"])

    return docs.mapInArrow(run, SHORT)


def ranges(body: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """``low, high, begin, end`` of the ranges of a text: tokens that end in (low, high] are found by encoding [begin, end).

    Edges lie every ``size`` bytes, in the middle of a word as well; one in a stretch of over LONGEST_UNIT bytes without
    the start of a unit is left out.
    """
    data = np.frombuffer(body, np.uint8)
    before, here = data[:-1], data[1:]
    starts = 1 + np.flatnonzero(((here == 32) | (here == 10)) & (before > 32) & (before < 127))
    edges = [(0, 0, 0)]
    for edge in range(size, len(body), size):
        i = int(np.searchsorted(starts, edge, "right"))
        left, right = int(starts[i - 1]) if i else 0, int(starts[i]) if i < len(starts) else len(body)
        if right - left <= LONGEST_UNIT:
            edges.append((edge, left, right))
    edges.append((len(body), len(body), len(body)))
    return [(low, high, begin, end) for (low, begin, _), (high, _, end) in zip(edges, edges[1:])]


def _ranges(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):  # one long text at a time
            row, doc, text = (batch.column(n)[0].as_py() for n in ("row", "doc_id", "text"))
            body = b" " + text.encode()
            for chunk, (low, high, begin, end) in enumerate(ranges(body, size)):
                yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "chunk": chunk, "low": low, "high": high, "begin": begin,
                                                   "body": body[begin:end]}], schema=schema)

    schema = pa.schema([(n, pa.binary() if n == "body" else pa.int64()) for n in ("row", "doc_id", "chunk", "low", "high", "begin", "body")])
    return docs.mapInArrow(run, RANGE)


def fragment(encoder: PairEncoder, body: bytes, begin: int, low: int, high: int, chunk: int) -> tuple[Fragment, bytes, np.ndarray]:
    """The fragment of a range, its closed groups as written, and the keys of their links."""
    units = _UNIT_START.split(body.decode("utf-8", "replace"))
    a, b = encoder.encode(units)
    valid = all(encoder.fits(*x) for x in zip(units, a, b))
    flat_a, flat_b = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
    if not valid:
        return Fragment(valid=False, at=chunk), b"", np.zeros(0, np.int64)
    ends_a, ends_b = begin + np.cumsum(encoder.a_sizes[flat_a]), begin + np.cumsum(encoder.b_sizes[flat_b])
    flat_a, ends_a = flat_a[(low < ends_a) & (ends_a <= high)], ends_a[(low < ends_a) & (ends_a <= high)]
    flat_b, ends_b = flat_b[(low < ends_b) & (ends_b <= high)], ends_b[(low < ends_b) & (ends_b <= high)]
    a_last, b_last = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    size = (len(flat_a), len(flat_b))
    at_a, at_b = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    if not len(at_a):
        return Fragment((flat_a.tolist(), flat_b.tolist()), cut=False, at=chunk, n_a=size[0], n_b=size[1]), b"", np.zeros(0, np.int64)
    inner_a, inner_b = slice(at_a[0], at_a[-1]), slice(at_b[0], at_b[-1])
    parts, _ = encoder.write(flat_a[inner_a], flat_b[inner_b], a_last[inner_a], b_last[inner_b]) if len(at_a) > 1 else ([], None)
    ends = Fragment((flat_a[:at_a[0]].tolist(), flat_b[:at_b[0]].tolist()), (flat_a[at_a[-1]:].tolist(), flat_b[at_b[-1]:].tolist()),
                    True, chunk, True, *size)
    return ends, b"".join(parts)[:-1], _pair_key(flat_a[at_a[1:] - 1], flat_b[at_b[1:] - 1])


def _open_row(row: int, doc: int | None, chunk: int, f: Fragment) -> dict:
    return {"row": row, "doc_id": doc, "chunk": chunk, "cut": f.cut, "at": f.at, "valid": f.valid, "n_a": f.n_a, "n_b": f.n_b,
            "prefix_a": f.prefix[0], "prefix_b": f.prefix[1], "suffix_a": f.suffix[0], "suffix_b": f.suffix[1]}


def _closed_row(row: int, place: int, n: int, groups: bytes, keys: np.ndarray) -> dict:
    different, times = np.unique(keys, return_counts=True)
    return {"row": row, "place": place, "n_groups": n, "groups": groups, "keys": different, "times": times}


def _group_row(row: int, at: int, a: list[int], b: list[int]) -> dict:
    """A group that was closed by composing; its place is just before the closed groups of range ``at``."""
    return _closed_row(row, 2 * at - 1, 1, _group(a, b), np.array([_pair_key(a[-1], b[-1])], np.int64))


def _schema() -> pa.Schema:
    """Arrow form of BOTH, made from its text: workers have no session to parse it."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split(" ") for column in BOTH.split(", "))])


def _fragments(parts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema = _units(*paths).encoder, _schema()
        for batch in common.slices(batches, 1):
            r = batch.to_pylist()[0]
            f, groups, keys = fragment(encoder, r["body"], r["begin"], r["low"], r["high"], r["chunk"])
            rows = [_open_row(r["row"], r["doc_id"], r["chunk"], f)]
            if len(keys):
                rows.append(_closed_row(r["row"], 2 * r["chunk"], len(keys), groups, keys))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # ranges of one text are dealt to all tasks
    return parts.repartition("row", "chunk").mapInArrow(run, BOTH)


def _composed(opened: DataFrame, last: bool) -> DataFrame:
    """FAN neighbouring fragments of a text become one; on the last level its two open ends are closed as well."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        row, out, whole = rows[0]["row"], [], None
        for r in rows:
            part = Fragment((r["prefix_a"], r["prefix_b"]), (r["suffix_a"], r["suffix_b"]), r["cut"], r["at"], r["valid"], r["n_a"], r["n_b"])
            whole, closed = (part, None) if whole is None else compose(whole, part)
            if closed is not None and whole.valid:
                out.append(_group_row(row, *closed))
        if last and whole.valid:
            out.append(_group_row(row, whole.at, *whole.prefix))
        out.append(_open_row(row, rows[0]["doc_id"], rows[0]["chunk"] // FAN, whole))
        return pa.Table.from_pylist(out, schema=_schema())

    return opened.groupBy("row", F.expr(f"chunk div {FAN}").alias("_of")).applyInArrow(run, BOTH)


def _digests(closed: DataFrame) -> DataFrame:
    """``row, n_groups, groups_sha256`` of long texts from their closed groups."""
    digests = common.joined_digest(closed.select("row", "place", F.col("groups").alias("body")), "row", b";")
    return closed.groupBy("row").agg(F.sum("n_groups").alias("n_groups")).join(digests, "row").withColumnRenamed("sha256", "groups_sha256")


@dataclass
class Aligned:
    """``texts``: one row per document with its counts and digest. ``links``: ``row, keys, times``, several rows for a long text."""

    texts: DataFrame
    links: DataFrame
    groups: DataFrame | None  # row, place, groups of long texts


def align(docs: DataFrame, paths: tuple[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Aligned:
    """Alignment of every text of ``docs``; repeated ids are texts of their own, and other columns are not read.

    Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: counts 0, digest ''.
    """
    paths = paths or default_tokenizers()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("_n"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    short = rows.filter(~is_long).select((F.col("_n") * 2).alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    short = _written(_short(short, paths), "aligned")
    long = rows.filter(is_long).select((F.col("_n") * 2 + 1).alias("row"), "doc_id", "text")
    parts = _written(_ranges(long, chunk_bytes), "ranges")
    chunks = parts.agg(F.max("chunk").alias("n")).first()["n"]
    if chunks is None:
        return Aligned(short.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"), short.select("row", "keys", "times"), None)
    found = _written(_fragments(parts, paths), "fragments")
    levels, closed = chunks, [found.filter("place IS NOT NULL")]
    while True:
        levels //= FAN
        found = _written(_composed(found.filter("place IS NULL"), levels == 0), "composed")
        closed.append(found.filter("place IS NOT NULL"))
        if levels == 0:
            break
    whole = found.filter("place IS NULL AND valid").select("row", "doc_id", "n_a", "n_b")
    groups = closed[0]
    for part in closed[1:]:
        groups = groups.unionByName(part)
    groups = groups.join(whole.select("row"), "row", "left_semi")
    long_texts = _written(found.filter("place IS NULL").select("row", "doc_id", F.expr("IF(valid, n_a, 0)").alias("n_a"), F.expr("IF(valid, n_b, 0)").alias("n_b"))
                          .join(_digests(groups), "row", "left").select("row", "doc_id", "n_a", "n_b", F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
                                                                       F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), "aligned-long")
    return Aligned(short.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").unionByName(long_texts),
                   short.select("row", "keys", "times").unionByName(groups.select("row", "keys", "times")), groups.select("row", "place", "groups"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and times of all rows of a batch, and how many each row has."""
    keys, times = batch.column("keys"), batch.column("times")
    return (keys.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False),
            np.diff(keys.offsets.to_numpy()).astype(np.int64))


def count_pairs(links: DataFrame) -> DataFrame:
    """``key, n, best``: links of each pair of ids over all texts; ``best`` 1 if no pair of the same second id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            n = np.bincount(at, np.concatenate([t for _, t in kept])).astype(np.int64)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for batch in batches:
            keys, times, _ = _flat(batch)
            if len(keys):
                kept.append((keys, times))
                waiting += len(keys)
            if waiting >= FLUSH_KEYS:
                yield flush()
                waiting = 0
        if kept:
            yield flush()

    counted = common.checkpoint(links.select("keys", "times").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    second = F.expr(f"key & ((1L << {B_BITS}) - 1)")
    most = counted.groupBy(second.alias("b")).agg(F.max("n").alias("most"))
    return common.checkpoint(counted.withColumn("b", second).join(most, "b").select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))


def score_links(aligned: Aligned, pairs: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of every text with links: from the counts of ``pairs``, the frequent ones broadcast."""
    total = pairs.count()
    table = largest(pairs, "n", common_pairs).toArrow()
    known, n, best = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "best"))
    by = np.argsort(known)
    shipped = pairs.sparkSession.sparkContext.broadcast((known[by], n[by], best[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shipped.value
        for batch in common.slices(batches):
            keys, times, sizes = _flat(batch)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            # sums of whole numbers in floats would lose digits: add as integers
            sums = np.zeros((2, batch.num_rows), np.int64)
            if hit.any():
                np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
                np.add.at(sums[1], row[hit], times[hit] * n[at[hit]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(offsets, pa.array(keys[~hit])),
                 pa.ListArray.from_arrays(offsets, pa.array(times[~hit]))], names=["row", "n_best", "count_sum", "keys", "times"])

    found = aligned.links.mapInArrow(run, "row long, n_best long, count_sum long, keys array<long>, times array<long>")
    if len(known) == total:
        return found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = _written(found, "linked")
    rare = found.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    looked = rare.join(pairs, "key").select("row", (F.col("times") * F.col("best")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return found.select("row", "n_best", "count_sum").unionByName(looked).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def summary(docs: DataFrame, paths: tuple[str, str] | None = None, doc_id: str = "doc_id", text: str = "text",
            chunk_bytes: int = CHUNK_BYTES, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Per document: counts of tokens, groups and links, links of the pair most frequent for their second id, and the sum
    of their pairs' counts over all texts."""
    aligned = align(docs, paths, doc_id, text, chunk_bytes)
    scored = score_links(aligned, count_pairs(aligned.links), common_pairs)
    zero = F.lit(0).cast("long")
    return aligned.texts.join(scored, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
