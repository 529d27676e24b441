"""Near copies by SimHash in tiles, every link confirmed by the exact Jaccard similarity of 5-word shingles.

Each different text has a 128-bit SimHash of its set of shingles. Texts are dealt into tiles by their number of shingles:
sets of similarity LEAST or more cannot differ more in size, so most tile pairs are skipped; blocks inside a pair are
skipped when their numbers of set bits differ beyond the radius. The rest is compared bit for bit in numpy: the first word
within the first RADIUS, both within the second. At a similarity of exactly LEAST 128 bits differ in about 19 places, in 4 more or
less; tests measure what the radius loses.

A tile pair returns a spanning forest of its candidates, nearest first, never all pairs. Candidates are confirmed on their
whole sets. Where one failed, the texts that still hang together by candidates are compared once more, exactly, in blocks
of whole sets; a block pair counts common shingles by products of 0-1 matrices and returns a forest of the links it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common, simhash
from ostiary.operators.graph import connected_components

SHINGLE = 5
LEAST = 0.8
RADIUS = (20, 34)
BLOCK = 512
# Texts, and shingles of them, in one side of a block pair of whole sets; sets multiplied at once, and columns.
BLOCK_TEXTS, BLOCK_SHINGLES = 1_000, 500_000
PRODUCT, COLUMNS = 256, 8_192
LEAST_TILE, MOST_TILE = 4_096, 131_072
TILES = 24
STEPS = 64  # size classes: so many to a factor of e


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle, a wordless text has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + 1) - 1
    last = ends[min(size, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], simhash.SEED) for a, b in zip((ends - sizes).tolist(), last)], "<u8"))


def _mixed(words: np.ndarray) -> np.ndarray:
    """Another hash of each hash (finalizer of a public 64-bit mix)."""
    words = (words ^ (words >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    words = (words ^ (words >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return words ^ (words >> np.uint64(31))


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Two words whose bits are set if set in over half the hashes of a set; 0 of none."""
    found = []
    for hashes in (own, _mixed(own)):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):
            part = np.ascontiguousarray(hashes[at:at + 65_536]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        found.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return found[0], found[1]


def _marked(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with ``name``, which stands for the text; null and empty texts are the same."""
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _nodes(texts: DataFrame) -> DataFrame:
    """``_id, _fp, size, first, second`` of rows ``_id, _fp, text``; wordless texts are one node, 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = [shingles(t) for t in common.bytes_of(batch, "text")]
            if sets:
                words = [fingerprint(s) for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                node = np.where(sizes > 0, batch.column("_fp").to_numpy(), 0)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(node), pa.array(sizes), *(pa.array([w[i] for w in words], pa.int64()) for i in (0, 1))],
                                                 names=["_id", "_fp", "size", "first", "second"])

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"_id {kind}, _fp long, size long, first long, second long")


def _forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Unites along edges ``a, b``, those of least ``near`` first at each tree; positions of the edges that united two trees."""
    used = []
    at = np.arange(len(a))
    while True:
        x, y = simhash._roots(parent, a[at]), simhash._roots(parent, b[at])
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if not len(at):
            return np.concatenate(used) if used else at
        by = np.argsort(near[at], kind="stable")
        # each tree's nearest edge; a tree's edges are taken in one order, so no circle can close but by the same edge twice
        trees, first = np.unique(np.stack([x[by], y[by]], 1).ravel(), return_index=True)
        chosen = np.unique(by[first // 2])
        low, high = np.minimum(x[chosen], y[chosen]), np.maximum(x[chosen], y[chosen])
        for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist())):
            lo, hi = _root(parent, lo), _root(parent, hi)
            if lo != hi:
                parent[max(lo, hi)] = min(lo, hi)
                used.append(at[chosen[i:i + 1]])


def _root(parent: np.ndarray, at: int) -> int:
    while parent[at] != at:
        parent[at] = parent[parent[at]]
        at = parent[at]
    return int(at)


def _candidates(rows: np.ndarray, split: int, least: float, radius: tuple[int, int] = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates between ``rows[:split]`` and the rest, or inside all rows (``split`` 0).

    ``rows``: first, second, size.
    """
    order = np.lexsort((np.bitwise_count(rows["first"]), np.arange(len(rows)) >= split if split else np.zeros(len(rows))))
    rows = rows[order]
    ones = np.bitwise_count(rows["first"]).astype(np.int16)
    starts = [np.arange(0, split or len(rows), BLOCK), np.arange(split, len(rows), BLOCK)]
    ends = [np.minimum(starts[0] + BLOCK, split or len(rows)), np.minimum(starts[1] + BLOCK, len(rows))]
    parent = np.arange(len(rows))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first, second, size = rows["first"], rows["second"], rows["size"]
    for start, end in zip(*(x[0] for x in (starts, ends))):
        for other, stop in zip(starts[1], ends[1]):
            if (not split and other < start) or max(ones[other] - ones[end - 1], ones[start] - ones[stop - 1]) > radius[0]:
                continue
            bits = np.bitwise_count(first[start:end, None] ^ first[None, other:stop])
            a, b = np.nonzero(bits <= radius[0])
            near = bits[a, b].astype(np.int64)
            a, b = a + start, b + other
            near += np.bitwise_count(second[a] ^ second[b])
            fits = (near <= radius[1]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)
            if not split:
                fits &= a < b
            a, b, near = a[fits], b[fits], near[fits]
            if len(a):
                edge = _forest(parent, a, b, near)
                found.append((order[a[edge]], order[b[edge]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _tiles(sizes: dict[int, int], least: float) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Size class to (tile, parts), and ``(tile, part, pair, side)`` of all pairs of tiles that can hold a candidate."""
    rows = min(max(LEAST_TILE, -(-sum(sizes.values()) // TILES)), MOST_TILE)
    tile_of: dict[int, tuple[int, int]] = {}
    tiles: list[list[int]] = []  # smallest class, largest class, rows
    for step in sorted(sizes):
        if tiles and tiles[-1][2] + sizes[step] <= rows:
            tiles[-1][1:] = [step, tiles[-1][2] + sizes[step]]
        else:
            tiles.append([step, step, sizes[step]])
        tile_of[step] = (len(tiles) - 1, 1)
    parts = [-(-n // rows) for _, _, n in tiles]
    tile_of = {step: (tile, parts[tile]) for step, (tile, _) in tile_of.items()}
    whole = [(tile, part) for tile in range(len(tiles)) for part in range(parts[tile])]
    pairs, number = [], 0
    reach = math.log(1 / least) * STEPS + 1e-6
    for i, one in enumerate(whole):
        for two in whole[i:]:
            if tiles[two[0]][0] - tiles[one[0]][1] - 1 > reach:
                break
            pairs += [(*one, number, 0)] + ([(*two, number, 1)] if one != two else [])
            number += 1
    return tile_of, pairs


def _compared(nodes: DataFrame, least: float, radius: tuple[int, int]) -> DataFrame:
    """``a, b``: candidates that connect all of ``nodes`` (``_fp, size, first, second``) that candidates connect."""
    spark = nodes.sparkSession
    step = F.floor(F.log(F.col("size")) * STEPS).cast("int")
    stepped = nodes.filter("size > 0").withColumn("step", step)
    sizes = {r["step"]: r["n"] for r in stepped.groupBy("step").agg(F.count("*").alias("n")).collect()}  # STEPS for each factor of e
    tile_of, pairs = _tiles(sizes, least)
    if not pairs:
        return spark.createDataFrame([], "a long, b long")
    classes = spark.createDataFrame([(step, *x) for step, x in tile_of.items()], "step int, tile int, parts int")
    dealt = stepped.join(F.broadcast(classes), "step").withColumn("part", F.pmod(F.xxhash64("_fp"), F.col("parts")).cast("int"))
    table = spark.createDataFrame(pairs, "tile int, part int, pair int, side int")
    rows = dealt.join(F.broadcast(table), ["tile", "part"]).select("pair", "side", "_fp", "size", "first", "second")

    def compare(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        rows = np.zeros(len(order), [("first", "<u8"), ("second", "<u8"), ("size", "<i8")])
        for name in rows.dtype.names:
            rows[name] = block.column(name).to_numpy()[order].view(rows.dtype[name])
        right = int((side == 1).sum())
        a, b = _candidates(rows, len(order) - right if right else 0, least, radius)
        fp = block.column("_fp").to_numpy()[order]
        return pa.table({"a": pa.array(fp[a]), "b": pa.array(fp[b])})

    return rows.groupBy("pair").applyInArrow(compare, "a long, b long")


def _confirmed(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``a, b, near``: the pairs of texts, with whether their similarity is ``least`` or more."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in common.slices(batches):
            near = []
            for a, x, y in zip(batch.column("a").to_pylist(), common.bytes_of(batch, "text_a"), common.bytes_of(batch, "text_b")):
                if last[0] != a:
                    last = (a, shingles(x))
                x, y = last[1], shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    # texts travel instead of their hashes, which no codec makes smaller
    return common.checkpoint(
        pairs.join(known.select(F.col("_fp").alias("b"), F.col("text").alias("text_b")), "b")
        .join(known.select(F.col("_fp").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, near boolean"))


def _labelled(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    joined = connected_components(found, []).select(F.col("node").alias("_fp"), "component")
    return nodes.drop(name).join(joined, "_fp", "left").withColumn(name, F.coalesce("component", "_fp")).drop("component")


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, as products of 0-1 matrices."""
    keys = np.concatenate(left + right)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    _, column = np.unique(keys, return_inverse=True)
    mine = row < len(left)
    both = (np.bincount(column[mine], minlength=column.max(initial=-1) + 1) > 0) & (np.bincount(column[~mine], minlength=column.max(initial=-1) + 1) > 0)
    number = np.cumsum(both) - 1
    keep = both[column]
    row, column, mine = row[keep], number[column[keep]], mine[keep]
    total = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(both.sum()), COLUMNS):
        inside = (column >= at) & (column < at + COLUMNS)
        sides = [np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)]
        sides[0][row[inside & mine], column[inside & mine] - at] = 1
        sides[1][row[inside & ~mine] - len(left), column[inside & ~mine] - at] = 1
        total += np.rint(sides[0] @ sides[1].T).astype(np.int64)  # sums below 2 ** 24 are exact
    return total


def _exact_forest(sets: list[np.ndarray], label: np.ndarray, split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of similarity ``least`` or more that connect different labels, between sets[:split] and the rest or (0) inside."""
    size = np.array([len(s) for s in sets])
    _, first, parent = np.unique(label, return_index=True, return_inverse=True)
    parent = first[parent]
    found = []
    sides = (range(0, split or len(sets), PRODUCT), range(split, len(sets), PRODUCT))
    for start in sides[0]:
        left = np.arange(start, min(start + PRODUCT, split or len(sets)))
        for other in sides[1]:
            right = np.arange(other, min(other + PRODUCT, len(sets)))
            if (not split and other < start) or len(np.unique(simhash._roots(parent, np.concatenate([left, right])))) == 1:
                continue
            both = common_shingles([sets[i] for i in left], [sets[i] for i in right])
            total = size[left][:, None] + size[right][None, :] - both
            a, b = np.nonzero(both >= least * total - 1e-9)
            a, b = left[a], right[b]
            if len(a):
                edge = _forest(parent, a, b, np.zeros(len(a)))
                found.append((a[edge], b[edge]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _in_blocks(members: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``a, b``: links between ``members`` (``_fp, size, of, label``) of one ``of`` and different labels that connect all
    that such links connect. Members of one ``of`` are dealt into parts of bounded size; every pair of parts is one group."""
    spread = members.groupBy("of").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts")).filter("lo < hi").select("of", "parts")
    rows = members.join(spread, "of").withColumn("part", F.pmod(F.xxhash64("_fp"), F.col("parts")).cast("int")).join(known, "_fp")
    copies = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "of", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("right"), "_fp", "label", "text")

    def compare(block: pa.Table) -> pa.Table:
        right = block.column("right").to_numpy()
        order = np.argsort(right, kind="stable")
        texts = block.column("text").cast(pa.binary()).to_pylist()
        sets = [shingles(texts[i] or b"") for i in order]
        split = int((~right).sum()) if right.any() else 0
        a, b = _exact_forest(sets, block.column("label").to_numpy()[order], split, least)
        fp = block.column("_fp").to_numpy()[order]
        return pa.table({"a": pa.array(fp[a]), "b": pa.array(fp[b])})

    # a pair of parts that got no row of its left part compares nothing
    return copies.groupBy("of", "i", "j").applyInArrow(compare, "a long, b long")


def links(nodes: DataFrame, texts: DataFrame, least: float = LEAST, radius: tuple[int, int] = RADIUS) -> DataFrame:
    """``a, b``: links between the candidate texts of similarity ``least`` or more that connect all that such links connect.

    ``nodes``: ``_fp, size, first, second``, one row per different text; ``texts``: ``_fp, text``.
    """
    spark = nodes.sparkSession
    tried = common.checkpoint(_compared(nodes, least, radius))
    ends = tried.select(F.explode(F.array("a", "b")).alias("_fp")).distinct()
    path = common.shared_folder(spark, "near-copies")
    texts.join(ends, "_fp", "left_semi").dropDuplicates(["_fp"]).write.parquet(path)
    known = spark.read.parquet(path)
    tested = _confirmed(tried, known, least)
    found = tested.filter("near").select("a", "b")
    failed = tested.filter("NOT near")
    if failed.isEmpty():
        return found
    # whatever hangs together with a candidate that failed
    members = _labelled(nodes.select("_fp", "size").join(ends, "_fp"), tried, "of")
    apart = members.join(failed.select(F.col("a").alias("_fp")), "_fp", "left_semi").select("of").distinct()
    members = common.checkpoint(_labelled(members.join(apart, "of", "left_semi"), found, "label"))
    return found.unionByName(common.checkpoint(_in_blocks(members, known, least)))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, radius: tuple[int, int] = RADIUS) -> DataFrame:
    """``docs`` with only the row of the smallest id of each group of near copies, unchanged; of repeated rows one stays.

    Null, empty and wordless texts are one group. Rows that share an id are told apart by their texts. Columns of any name
    pass: no column is added to ``docs``.
    """
    texts = _marked(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")), "text", "_fp")
    narrow = common.checkpoint(_nodes(texts))
    nodes = common.checkpoint(narrow.groupBy("_fp").agg(F.first("size").alias("size"), F.first("first").alias("first"), F.first("second").alias("second")))
    found = simhash.components_of(narrow.select("_id", "_fp"), links(nodes, texts.select("_fp", "text"), least, radius), "_id", "_fp")
    wordless = F.length(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")) == 0
    return simhash.first_of_groups(docs, narrow.select("_id", "_fp"), found, doc_id,
                                   lambda rows, name: _marked(rows, text, name).withColumn(name, F.when(wordless, 0).otherwise(F.col(name))))
