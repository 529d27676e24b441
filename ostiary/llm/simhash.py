"""SimHash fingerprints and their exact near-duplicate groups by tiled comparison.

Different fingerprints are dealt into tiles by their number of set bits. Two tiles are compared, bit for bit in numpy,
unless their numbers of set bits differ by more than the radius; inside a pair of tiles the same rule, on the set bits of
each quarter, skips whole sub-tiles. No link is lost: the set bits of two words within the radius, and the sum of the
differences over their quarters, never differ by more.

A pair of tiles returns a spanning forest of its links, at most one row for each fingerprint in it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ostiary.llm import common
from ostiary.operators.graph import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
SUB_TILE = 512
LEAST_TILE, MOST_TILE = 4_096, 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if set in over half the hashes of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1:].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with a signed 64-bit ``fp``; 0 for null, empty and wordless texts."""
    return common.with_columns(docs, f"`{name}` long", lambda batch: [
        pa.array([fingerprint(t) for t in common.bytes_of(batch, text)], pa.int64())])


def hex_digits(fp: str) -> Column:
    """16 lower-case digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        up = parent[root]
        if (up == root).all():
            parent[at] = root
            return root
        root = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of ``a[i]`` and ``b[i]``; the smallest member is the root."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _quarters(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view("<u2").reshape(-1, 4)).astype(np.int16)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within ``radius``, between two tiles or inside one (``right`` None)."""
    tiles = [np.ascontiguousarray(t, "<u8") for t in (left, right) if t is not None]
    boxes, starts = [], []
    for i, tile in enumerate(tiles):
        counts = _quarters(tile)
        by = np.lexsort((counts[:, 3], counts[:, 2], counts[:, 1], counts[:, 0], counts[:, 0] + counts[:, 1]))
        tiles[i], counts = tile[by], counts[by]
        at = np.arange(0, len(tile), SUB_TILE)
        starts.append(at)
        boxes.append((np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)) if len(tile) else (counts, counts))
    words = np.concatenate(tiles)
    shift = 0 if right is None else len(tiles[0])
    parent = np.arange(len(words))
    (low_a, high_a), (low_b, high_b) = boxes[0], boxes[-1]
    for i, start in enumerate(starts[0]):
        gap = np.maximum(np.maximum(low_b - high_a[i], low_a[i] - high_b), 0).sum(1)
        row = tiles[0][start:start + SUB_TILE, None]
        for other in starts[-1][gap <= radius]:
            if right is None and other < start:
                continue
            near = np.bitwise_count(row ^ tiles[-1][None, other:other + SUB_TILE]) <= radius
            a, b = np.nonzero(near)
            a, b = a + start, b + other + shift
            if right is None:
                a, b = a[a < b], b[a < b]
            if len(a):
                _join(parent, a, b)
    member = np.arange(len(words))
    root = _roots(parent, member)
    linked = root != member
    return words[linked].view("<i8"), words[root[linked]].view("<i8")


def links(fingerprints: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect exactly the different ``fp`` values connected by steps of at most ``radius`` bits.

    Work grows with the square of the number of different fingerprints, less what the bit counts skip. ``fingerprints``
    is read several times and should be materialised. Tiles grow with the table up to MOST_TILE rows, so the table
    of tile pairs stays small; one row of it goes to each task.
    """
    spark = fingerprints.sparkSession
    counted = fingerprints.select(F.col(fp).alias("fp"), F.bit_count(fp).alias("ones"))
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    total = sum(sizes.values())
    tile_rows = min(max(LEAST_TILE, -(-total // 24)), MOST_TILE)
    parts = {ones: -(-n // tile_rows) for ones, n in sizes.items()}
    tiles = [(ones, part) for ones in sorted(parts) for part in range(parts[ones])]
    pairs, number = [], 0
    for i, (ones, part) in enumerate(tiles):
        for ones_b, part_b in tiles[i:]:
            if ones_b - ones > radius:
                break
            pairs.append((ones, part, number, 0))
            if (ones, part) != (ones_b, part_b):
                pairs.append((ones_b, part_b, number, 1))
            number += 1
    if not pairs:
        return spark.createDataFrame([], "a long, b long")
    table = spark.createDataFrame(pairs, "ones int, part long, pair long, side int")
    count = F.element_at(F.create_map(*[F.lit(x) for item in parts.items() for x in item]), F.col("ones"))
    dealt = counted.withColumn("part", F.pmod(F.xxhash64("fp"), count)).join(F.broadcast(table), ["ones", "part"])

    def compare(block: pa.Table) -> pa.Table:
        words, side = block.column("fp").to_numpy().view("<u8"), block.column("side").to_numpy()
        right = words[side == 1]
        a, b = forest(words[side == 0], right if len(right) else None, radius)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.select("pair", "side", "fp").groupBy("pair").applyInArrow(compare, "a long, b long")


def components(docs: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """``fp, component, component_id, docs`` per different fingerprint: the smallest fingerprint and the smallest id
    reachable, and its number of documents.

    Equal fingerprints are one node, so groups of exact copies of any size cost one row. Null ids are no smallest id
    unless all are null.
    """
    nodes = common.checkpoint(_nodes(docs, doc_id, fp))
    return _grouped(nodes, links(nodes, "fp", radius))


def components_of(docs: DataFrame, pairs: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """The same of given links ``a, b`` between values of ``fp``."""
    return _grouped(common.checkpoint(_nodes(docs, doc_id, fp)), pairs)


def _nodes(docs: DataFrame, doc_id: str, fp: str) -> DataFrame:
    return docs.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least"), F.count("*").alias("docs"))


def _grouped(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    joined = connected_components(pairs, []).select(F.col("node").alias("fp"), "component")
    members = common.checkpoint(nodes.join(joined, "fp"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    of_members = members.join(least, "component").select("fp", "component", "component_id")
    # written, so that a later join with the documents reads it through a shuffle of its own and a fingerprint that very
    # many documents share can be split
    return common.checkpoint(nodes.join(of_members, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id"), "docs"))


def first_of_groups(docs: DataFrame, narrow: DataFrame, found: DataFrame, doc_id: str, mark: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that are the first of the groups ``found``; ``narrow`` has each row's ``_id`` and ``_fp``, and
    ``mark`` adds the latter to rows of ``docs`` under a given name. Texts are shuffled once, by the last join on the id."""
    id_, fp, of = common.free_names(docs, 3)
    groups = found.select("component_id").distinct()
    first = common.checkpoint(narrow.groupBy("_id").agg(F.count("*").alias("rows")).join(
        groups, F.col("_id").eqNullSafe(F.col("component_id")), "left_semi"))
    alone, repeated = (first.filter(f"rows {size} 1").select(F.col("_id").alias(id_)) for size in ("=", ">"))
    stays = docs.join(alone, docs[doc_id].eqNullSafe(F.col(id_)), "left_semi")
    if repeated.isEmpty():
        return stays
    chosen = narrow.join(repeated, F.col("_id").eqNullSafe(F.col(id_)), "left_semi").join(
        found.withColumnRenamed("fp", "_fp"), "_fp").filter(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min("_fp").alias(of), F.first("_id").alias(id_))
    several = mark(docs.join(repeated, docs[doc_id].eqNullSafe(F.col(id_)), "left_semi"), fp)
    kept = several.join(chosen, several[doc_id].eqNullSafe(F.col(id_)) & (F.col(fp) == F.col(of)), "left_semi")
    return stays.unionByName(kept.dropDuplicates([doc_id, fp]).select(*docs.columns))
