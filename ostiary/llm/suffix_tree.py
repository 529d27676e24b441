"""Language-model scores from a probabilistic suffix tree over the bytes of a text's words.

A text is its lower-cased (A-Z) words joined by single blanks and closed by an end symbol; a byte is predicted from the
longest retained context of up to DEPTH bytes before it. All training texts are counted. A context is retained when its
next-symbol distribution differs from its parent's (the context without its first byte) by more than a code-length test
allows; its distribution is smoothed with its parent's. Scoring walks the tree's suffix states as an automaton.

Every context that passes is kept. A tree of more than PART_CONTEXTS contexts is cut into parts by the last two bytes of a
context, which a position shows before the tree is asked: each part is an automaton of its own, broadcast in a pass of its
own, and scores the positions after its pairs of bytes. What further parts add to a text is joined by the text's hashes.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ostiary.llm import common

DEPTH = 5
END = 10  # a line feed is in no word: it closes a text and stands for what is before its first byte
# Contexts in one part of the tree: bounds what is broadcast and built at a time.
PART_CONTEXTS = 120_000
# Words whose counts go to every executor; the counts of all others are looked up by a join.
COMMON_WORDS = 200_000
FLUSH_WORDS = 200_000
STREAM_BYTES = 1_000_000
FLUSH_WINDOWS = 3_000_000
LANE = 1_024


def _joined(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after DEPTH end symbols and closed by one, and the position after each close."""
    pad = bytes([END]) * DEPTH
    whole = b"".join(part for text in texts for part in (pad, text, b"\n"))
    return np.frombuffer(whole, np.uint8), np.cumsum([len(t) + DEPTH + 1 for t in texts])


def _batches(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= STREAM_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def largest(rows: DataFrame, value: str, most: int) -> DataFrame:
    """Rows with the largest ``value`` (positive), ``most`` at most: those above a border found from a histogram on a
    logarithmic scale, so nothing is sorted and only the histogram goes to the driver."""
    step = F.floor(F.log(F.col(value)) * 32)
    sizes = rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    border, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        total += row["n"]
        if total > most:
            break
        border = row["step"]
    return rows.limit(0) if border is None else rows.filter(step >= border)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all words of whole texts; counts are combined per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for body in common.bytes_of(batch, text):
                counts.update(body.lower().split())
                if len(counts) >= FLUSH_WORDS:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``window, n``: every predicted byte with the DEPTH bytes before it, packed into a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            windows, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(windows.view(np.int64)), pa.array(n.astype(np.int64))], names=["window", "n"])

        for batch in batches:
            for part in _batches(map(_joined, common.bytes_of(batch, text))):
                stream, ends = _stream(part)
                wide = stream.astype(np.uint64)
                size = len(wide) - DEPTH
                window = np.zeros(size, np.uint64)
                for j in range(DEPTH + 1):
                    window |= wide[j:j + size] << np.uint64(8 * (DEPTH - j))
                real = np.ones(size, bool)  # windows that end in the padding before a later text predict nothing
                for j in range(DEPTH):
                    real[ends[:-1] + j - DEPTH] = False
                kept.append(window[real])
                if sum(map(len, kept)) >= FLUSH_WINDOWS:
                    yield flush()
        if kept:
            yield flush()

    return docs.select(text).mapInArrow(run, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Counts of the retained contexts: depth, context (its bytes as a number), next byte, n. Depth 0 is the root."""

    key: str
    depth: np.ndarray
    context: np.ndarray
    symbol: np.ndarray
    n: np.ndarray


@dataclass
class Forest:
    """The tree in parts. ``part_of`` is the part that scores a position, by the two bytes before it."""

    parts: list[DataFrame]
    part_of: np.ndarray

    def trees(self) -> Iterator[Tree]:
        for part in self.parts:  # PART_CONTEXTS contexts, one part at a time
            yield Tree(uuid.uuid4().hex, *(c.to_numpy() for c in part.toArrow().columns))


def retained(windows: DataFrame) -> DataFrame:
    """``depth, context, symbol, n`` of the contexts that pass the divergence test, of their ancestors and of the root.

    Summed over its occurrences, a context's divergence from its parent must exceed half the logarithm of its count for
    each symbol seen after it (the cost of stating its distribution).
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    counted = windows.select("window", "n", levels).select(
        "depth", F.expr("shiftright(window, 8) & (shiftleft(1L, 8 * depth) - 1)").alias("context"),
        (F.col("window").bitwiseAND(255)).cast("int").alias("symbol"), "n",
    ).groupBy("depth", "context", "symbol").agg(F.sum("n").alias("n"))
    counted = common.checkpoint(counted)
    totals = counted.groupBy("depth", "context").agg(F.sum("n").alias("total"))
    full = common.checkpoint(counted.join(totals, ["depth", "context"]))
    parent = full.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("above"), "symbol",
                         F.col("n").alias("n_above"), F.col("total").alias("total_above"))
    above = F.expr("context & (shiftleft(1L, 8 * (depth - 1)) - 1)").alias("above")
    gain = F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.log(F.col("n_above") / F.col("total_above"))))
    tested = (full.filter("depth > 0").select("*", above).join(parent, ["depth", "above", "symbol"])
              .groupBy("depth", "context").agg(gain.alias("gain"), F.max("total").alias("total"), F.count("*").alias("symbols")))
    passed = tested.filter(F.col("gain") > F.col("symbols") * F.log("total") / 2)
    shorter = F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("to")
    wanted = passed.select("context", shorter).select(F.col("to").alias("depth"), F.expr("context & (shiftleft(1L, 8 * to) - 1)").alias("context")).distinct()
    wanted = common.checkpoint(wanted)
    if wanted.count() <= PART_CONTEXTS:  # a few MB: all counts stay where they are
        wanted = F.broadcast(wanted)
    return common.checkpoint(counted.join(wanted, ["depth", "context"], "left_semi").unionByName(counted.filter("depth = 0")))


def grow(windows: DataFrame, part_contexts: int = PART_CONTEXTS) -> Forest:
    """The tree of all retained contexts. Contexts of up to one byte are in every part."""
    table = retained(windows)
    pair = F.expr("cast(context & 65535 AS int)").alias("pair")
    sizes = table.filter("depth > 1").select("depth", "context", pair).distinct().groupBy("pair").count().collect()  # 65,536 rows at most
    part_of, part, held = np.zeros(1 << 16, np.int32), 0, 0
    for row in sorted(sizes, key=lambda r: r["pair"]):
        if held and held + row["count"] > part_contexts:
            part, held = part + 1, 0
        part_of[row["pair"]] = part
        held += row["count"]
    if part == 0:
        return Forest([table], part_of)
    places = table.sparkSession.createDataFrame([(r["pair"], int(part_of[r["pair"]])) for r in sizes], "pair int, part int")
    placed = common.checkpoint(table.withColumn("pair", pair).join(F.broadcast(places), "pair", "left"))
    return Forest([placed.filter((F.col("depth") < 2) | (F.col("part") == i)).select(table.columns) for i in range(part + 1)], part_of)


class Automaton:
    """Dense next-state and log10 tables of a tree: states are its contexts and all their beginnings."""

    def __init__(self, tree: Tree) -> None:
        classes = np.zeros(256, np.int64)  # bytes that training has not seen share class 0
        seen = np.union1d(np.unique(tree.symbol), [END])
        classes[seen] = np.arange(1, len(seen) + 1)
        self.classes = classes.astype(np.uint8 if len(seen) < 255 else np.uint16)
        self.width = width = len(seen) + 1
        unseen = max(1, 256 - len(seen))
        retained = set(zip(tree.depth.tolist(), tree.context.tolist())) | {(0, 0)}
        states = {(0, 0)}
        for depth, context in retained:
            for size in range(1, depth + 1):
                states.add((size, context >> (8 * (depth - size))))
        ordered = sorted(states)
        number = {s: i for i, s in enumerate(ordered)}
        depths = np.array([d for d, _ in ordered])
        contexts = np.array([c for _, c in ordered], np.int64)
        link = np.zeros(len(ordered), np.int64)  # the longest shorter suffix that is a state
        child: list[list] = [[] for _ in range(DEPTH + 1)]
        for i, (d, c) in enumerate(ordered):
            size = d - 1
            while size > 0 and (size, c & ((1 << (8 * size)) - 1)) not in number:
                size -= 1
            link[i] = number[(max(size, 0), c & ((1 << (8 * max(size, 0))) - 1))] if d else 0
            if d:
                child[d - 1].append((number[(d - 1, c >> 8)], classes[c & 255], i))
        at = np.array([number[s] for s in zip(tree.depth.tolist(), tree.context.tolist())], np.int64)
        symbol = classes[tree.symbol]
        total, kinds = np.bincount(at, tree.n, len(ordered)), np.bincount(at, minlength=len(ordered))
        # root: symbols with one half added each, unseen bytes included
        root = np.full(width, 0.5)
        root[symbol[at == 0]] += tree.n[at == 0]
        root[0] = 0.5 * unseen
        # next state and probability side by side: a step of the walk looks up one place
        self.table = np.zeros(len(ordered) * width, "<i8")
        follow = self.table.view("<i4").reshape(len(ordered), width, 2)[:, :, 0]
        probability = self.table.view("<f4").reshape(len(ordered), width, 2)[:, :, 1]
        probability[0] = root / root.sum()
        probability[0, 0] /= unseen
        for depth in range(DEPTH + 1):
            rows = np.flatnonzero(depths == depth)
            if not len(rows):
                continue
            if depth:
                # Witten and Bell: as much weight for the shorter context as there are different symbols after this one
                weight = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0).astype(np.float32)
                for part in np.array_split(rows, -(-len(rows) // 4_096)):
                    follow[part] = follow[link[part]]
                    probability[part] = probability[link[part]] * weight[part, None]
                own = np.flatnonzero(depths[at] == depth)
                probability[at[own], symbol[own]] += (tree.n[own] / (total + kinds)[at[own]]).astype(np.float32)
            for parent, byte, i in child[depth]:
                follow[parent, byte] = i
        follow *= width
        np.log10(probability, out=probability)

    @property
    def logs(self) -> np.ndarray:
        return self.table.view("<f4").reshape(-1, 2)[:, 1]

    def score(self, texts: list[bytes], mine: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each joined text with its end; with ``mine`` of the bytes after those pairs of bytes only."""
        stream, ends = _stream(texts)
        classes = self.classes[stream]
        lanes = -(-len(classes) // LANE)
        padded = np.full(DEPTH + lanes * LANE, self.classes[END], classes.dtype)
        padded[DEPTH:DEPTH + len(classes)] = classes
        # every lane starts DEPTH bytes early: that many bytes fix the state
        view = np.lib.stride_tricks.as_strided(padded, (lanes, LANE + DEPTH), (padded.itemsize * LANE, padded.itemsize))
        columns = np.ascontiguousarray(view.T).astype(np.intp)
        entry = np.zeros(lanes, "<i8")
        state, log = entry.view("<i4").reshape(-1, 2).T
        edge = np.empty(lanes, np.intp)
        out = np.empty((LANE, lanes), "<i4")
        for step, column in enumerate(columns):
            np.add(state, column, out=edge)
            np.take(self.table, edge, out=entry, mode="clip")  # always inside: clipping only spares a copy
            if step >= DEPTH:
                out[step - DEPTH] = log
        out = out.view("<f4")
        found = out.T.ravel()[:len(classes)]
        for j in range(DEPTH):  # the padding is certain
            found[np.concatenate([[0], ends[:-1]]) + j] = 0
        if mine is not None:  # a text starts after END symbols, so the pair before its first byte is known too
            found[2:][~mine[stream[:-2].astype(np.int64) << 8 | stream[1:-1]]] = 0
        return np.add.reduceat(found, np.concatenate([[0], ends[:-1]]), dtype=np.float64)


def _of_text(text: str) -> list[Column]:
    """Two hashes that stand for a text; null and empty texts are the same."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(body), F.xxhash64(F.lit(7), body)]


def _further(docs: DataFrame, text: str, trees: Iterator[Tree], mine: list[np.ndarray]) -> DataFrame:
    """``h, g, more``: what the parts of the tree after the first add to each different text, a pass for each part."""
    spark = docs.sparkSession
    h, g = _of_text(text)
    rows = docs.select(h.alias("h"), g.alias("g"), F.col(text).alias("text"))

    def part_of(shipped: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, of_part = shipped.value
            automaton = common.once_per_worker(("tree", tree.key), lambda: Automaton(tree))
            for batch in common.slices(batches):
                found = [automaton.score(part, of_part) for part in _batches(map(_joined, common.bytes_of(batch, "text")))]
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), pa.array(np.concatenate(found))], names=["h", "g", "more"])

        return run

    found = None
    for tree, of_part in zip(trees, mine):
        one = rows.mapInArrow(part_of(spark.sparkContext.broadcast((tree, of_part))), "h long, g long, more double")
        one = common.checkpoint(one.groupBy("h", "g").agg(F.max("more").alias("more")))  # equal texts, equal scores
        found = one if found is None else found.unionByName(one)
    return common.checkpoint(found.groupBy("h", "g").agg(F.sum("more").alias("more")))


FIELDS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", common_words: int = COMMON_WORDS,
          part_contexts: int = PART_CONTEXTS) -> DataFrame:
    """``docs`` without its text, with FIELDS: whole texts scored by a tree grown from all of ``train``'s texts.

    ``base_score`` is the unigram model with 0.1 added to every count, ``n_known`` the tokens seen in training; the end
    counts as a token. Null texts count as empty; every row is scored by itself, repeated ids included. Without
    training texts all bytes are equally likely and no token is known.
    """
    spark = docs.sparkSession
    words = common.checkpoint(count_words(train, text))
    texts_seen = train.count()
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    total, kinds = (sums["n"] or 0) + texts_seen, sums["kinds"] + (texts_seen > 0)
    divisor = total + 0.1 * (kinds + 1)
    found = largest(words, "n", common_words).toArrow()
    frequent = dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))
    complete = len(frequent) == sums["kinds"]
    forest = grow(count_windows(train, text), part_contexts)
    trees = forest.trees()
    several = len(forest.parts) > 1
    mine = [forest.part_of == i if several else None for i in range(len(forest.parts))]
    shipped: Broadcast = spark.sparkContext.broadcast((next(trees), mine[0], frequent))
    unknown, end = math.log10(0.1 / divisor), math.log10((texts_seen + 0.1) / divisor)

    def compute(batch: pa.RecordBatch) -> list:
        tree, mine, frequent = shipped.value
        automaton = common.once_per_worker(("tree", tree.key), lambda: Automaton(tree))
        points = common.once_per_worker(("points", tree.key), lambda: {w: math.log10((n + 0.1) / divisor) for w, n in frequent.items()})
        scores, sizes, known, base, rest = [], [], [], [], []
        for part in _batches(map(_joined, common.bytes_of(batch, text))):
            scores.append(automaton.score(part, mine))
            for body in part:
                own = body.split()
                found = list(map(points.get, own))
                missing = [w for w, p in zip(own, found) if p is None] if None in found else []
                sizes.append(len(own) + 1)
                known.append(len(own) - len(missing) + (texts_seen > 0))
                base.append(math.fsum(p for p in found if p is not None) + end)
                rest.append(missing)
        return [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), np.concatenate(scores), pa.array(rest, pa.list_(pa.binary()))]

    *marks, first_part = common.free_names(docs, 3)
    marked = docs.withColumns(dict(zip(marks, _of_text(text)))) if several else docs
    rows = common.with_columns(marked, "n_tokens long, _known long, _base double, score double, _rest array<binary>", compute)
    rows = rows.drop(text).withColumn("train_tokens", F.lit(total).cast("long"))
    names = [c for c in docs.columns if c != text and c.lower() not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    kept = [*names, *(marks if several else [])]
    if complete:  # every training word is in every executor's table
        out = rows.select(*kept, "n_tokens", F.col("_known").alias("n_known"), "train_tokens",
                          (F.col("_base") + F.size("_rest") * F.lit(unknown)).alias("base_score"), "score")
    else:
        # written once, so that a row keeps its number
        rows = common.checkpoint(rows).withColumn("_row", F.monotonically_increasing_id())
        rare = rows.select("_row", F.explode("_rest").alias("word"))
        found = rare.join(words, "word", "left").groupBy("_row").agg(
            F.count("n").alias("found"), F.sum(F.coalesce(F.log10((F.col("n") + 0.1) / F.lit(divisor)), F.lit(unknown))).alias("points"))
        out = rows.drop("_rest").join(found, "_row", "left").select(
            *kept, "n_tokens", (F.col("_known") + F.coalesce("found", F.lit(0))).alias("n_known"), "train_tokens",
            (F.col("_base") + F.coalesce("points", F.lit(0.0))).alias("base_score"), "score")
    if several:
        more = _further(docs, text, trees, mine[1:]).select(F.col("h").alias(marks[0]), F.col("g").alias(marks[1]), F.col("more").alias(first_part + "_more"))
        out = out.withColumnRenamed("score", first_part).join(more, marks, "left").select(
            *names, "n_tokens", "n_known", "train_tokens", "base_score", (F.col(first_part) + F.col(first_part + "_more")).alias("score"))
    return out
