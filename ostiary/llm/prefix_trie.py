"""The trie of all conversation prefixes by range partition: a skeleton of splitter paths and shards that finish the rest.

A conversation's path is the sequence of its turns' digests. Conversations are sorted by path over range partitions, the
shards; the first path of each shard is a splitter. A node's members are neighbours in that order, so a node with members
in several shards is a prefix of a splitter: such nodes are the *skeleton*, whose trie is broadcast. Every other node
lies in one shard, which finishes it in one pass over its sorted rows with a stack as deep as a path. Of skeleton nodes a
shard returns partial aggregates, which are combined by reduction.

A path holds the first HEAD turns. Turns beyond stay rows of their own (``_tails``): running sums of hashes name their
nodes, so that a conversation of any length is never gathered. What is below a path's end reaches the trie as numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ostiary.llm import common
from ostiary.operators import ordering

DIGEST = 32
HEAD = 64
# Rows of a shard, and the largest number of shards: splitters times HEAD digests and skeleton nodes are bounded by it.
SHARD_ROWS = 20_000
MOST_SHARDS = 4_096
END_IDS = 20_000
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def turns_of(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, digest, size``: turns numbered from 1 in the order of ``turn``, null first, equal turns in the order of
    their digests. Null role or text count as empty, ``size`` is the text's bytes. Rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest")
    rows = convs.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest, F.octet_length(text).cast("long").alias("size"))
    return ordering.rank_within(common.checkpoint(rows), ["conv_id"], [F.asc_nulls_first("turn"), F.col("digest")], "pos").drop("turn")


def shared_turns(conv_id: str = "conv_id") -> Column:
    """Number of turns that a conversation takes from the first of its five: the crc32 of its id modulo 9."""
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, n`` of every conversation and ``conv_id, depth, digest, size`` of its rebuilt turns: the first
    ``shared_turns`` of conversation ``conv_id - conv_id % 5``, then its own turns after so many."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    ids = sizes.select("conv_id", "own", shared_turns().alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("first"))
    ids = common.checkpoint(ids.join(sizes.select(F.col("conv_id").alias("first"), F.col("own").alias("firsts")), "first", "left").select(
        "conv_id", "first", "own", "h", F.least("h", F.coalesce("firsts", F.lit(0))).alias("taken")))
    heads = turns.filter("conv_id % 5 = 0 AND pos <= 8").withColumnRenamed("conv_id", "first")
    taken = ids.select("conv_id", "first", "h").join(heads, "first").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "size")
    # turns that a conversation keeps follow those that it took; the shift is a value of the id's own few first turns
    kept = turns.filter(F.col("pos") > shared_turns()).join(ids.select("conv_id", (F.col("taken") - F.col("h")).alias("shift")), "conv_id").select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "digest", "size")
    counts = ids.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n"))
    return counts, taken.unionByName(kept)


def paths_of(counts: DataFrame, turns: DataFrame, head: int) -> DataFrame:
    """``conv_id, n, path, sizes`` with the first ``head`` turns of each conversation."""
    parts = turns.filter(F.col("depth") <= head).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "size"))).alias("t"))
    return counts.join(parts, "conv_id", "left").select(
        "conv_id", "n", F.coalesce(F.expr("aggregate(t.digest, cast('' AS binary), (a, x) -> a || x)"), F.lit("").cast("binary")).alias("path"),
        F.coalesce("t.size", F.expr("cast(array() AS array<long>)")).alias("sizes"))


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
# of finished nodes: parent, a skeleton node's number where the parent is one; of skeleton nodes: node and partial sums; of ids that end there: place, ends
SHARD = NODE + ", parent int, node int, size long, place long, ends binary"


class Skeleton:
    """Trie of the splitter paths. Node 0 is the root."""

    def __init__(self, splitters: list[bytes]) -> None:
        self.splitters = splitters
        self.number = {b"": 0}
        self.parent, self.depth = [-1], [0]
        for path in splitters:
            for end in range(DIGEST, len(path) + 1, DIGEST):
                if path[:end] not in self.number:
                    self.number[path[:end]] = len(self.parent)
                    self.parent.append(self.number[path[:end - DIGEST]])
                    self.depth.append(end // DIGEST)

    def finish(self, partial: pa.Table) -> pa.Table:
        """Skeleton nodes from their combined partial sums: their own leaves and savings are added, for the whole subtree."""
        count = len(self.parent)
        at = partial.column("node").to_numpy()
        sums = {}
        for name in ("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "size"):
            sums[name] = np.zeros(count, np.int64)
            sums[name][at] = partial.column(name).to_numpy()
        children, leaves, saved = sums["n_children"], sums["n_leaves"], sums["saved_tokens"]
        np.add.at(children, np.array(self.parent[1:], np.int64), 1)
        own_leaf, own_saved = (children == 0).astype(np.int64), (sums["n_convs"] - 1) * sums["size"]
        below_leaf, below_saved = own_leaf.copy(), own_saved.copy()
        for node in range(count - 1, 0, -1):  # children are numbered after their parents
            below_leaf[self.parent[node]] += below_leaf[node]
            below_saved[self.parent[node]] += below_saved[node]
        parent = np.array(self.parent)
        parents = pa.array(sums["conv_id"][parent], mask=parent < 0)
        return pa.table({"node": pa.array(np.arange(count), pa.int32()), "conv_id": sums["conv_id"], "depth": pa.array(self.depth, pa.int64()),
                         "parent_conv_id": parents, "n_convs": sums["n_convs"], "n_children": children, "n_leaves": leaves + below_leaf,
                         "saved_tokens": saved + below_saved})


class _Open:
    """A node that the current path passes."""

    __slots__ = ("size", "node", "n", "least", "children", "leaves", "saved", "hash", "ends", "waiting")

    def __init__(self, size: int, node: int) -> None:
        self.size, self.node = size, node  # bytes of its last text; its number in the skeleton or -1
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.hash = hashlib.sha256() if node < 0 else None
        self.ends = 0
        self.waiting: list[list] = []  # finished children, which wait for this node's smallest member


class Shard:
    """One pass over sorted paths. ``out`` collects rows of SHARD."""

    def __init__(self, index: int, skeleton: Skeleton) -> None:
        # the nodes that may go on in the shards beside it: prefixes of its first path and of the next shard's
        near = skeleton.splitters[max(0, index - 1):index + 1]
        self.number = {path[:end]: skeleton.number[path[:end]] for path in near for end in range(0, len(path) + 1, DIGEST)}
        self.number[b""] = 0
        self.index, self.out, self.place = index, [], 0
        self.path = b""
        self.stack = [_Open(0, 0)]
        self.ids: list[int] = []  # ids ending at the skeleton node on top, not yet returned

    def add(self, conv: int, path: bytes, sizes: list[int], ends: bool, children: int, leaves: int, saved: int) -> None:
        stack = self.stack
        same = 0
        most = min(len(path), len(self.path))
        while same < most and path[same:same + DIGEST] == self.path[same:same + DIGEST]:
            same += DIGEST
        if len(path) != len(self.path) or same != len(path):
            self._flush()
        while len(stack) > same // DIGEST + 1:
            self._close()
        for end in range(same + DIGEST, len(path) + 1, DIGEST):
            stack.append(_Open(sizes[end // DIGEST - 1], self.number.get(path[:end], -1)))
        self.path = path
        top = stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.children += children
        top.leaves += leaves
        top.saved += saved
        if ends:
            if top.node < 0:
                top.hash.update(b"%s%d" % (b"," if top.ends else b"", conv))
            else:
                self.ids.append(conv)
                if len(self.ids) >= END_IDS:
                    self._flush()
            top.ends += 1

    def _flush(self) -> None:
        if self.ids:
            self.out.append([None] * 9 + [self.stack[-1].node, None, (self.index << 32) + self.place, b",".join(b"%d" % i for i in self.ids)])
            self.place += 1
            self.ids = []

    def _close(self) -> None:
        node = self.stack.pop()
        depth = len(self.stack)
        above = self.stack[-1] if self.stack else None
        for row in node.waiting:
            row[2] = node.least
            self.out.append(row)
        if node.node >= 0:
            self.out.append([node.least, depth, None, node.n, node.children, node.leaves, node.saved, None, None, node.node, node.size, None, None])
        else:
            leaves = node.leaves if node.children else 1
            node.leaves, node.saved = leaves, node.saved + (node.n - 1) * node.size
            row = [node.least, depth, None, node.n, node.children, leaves, node.saved, node.hash.hexdigest(), None, None, None, None, None]
            above.children += 1
            if above.node >= 0:
                row[8] = above.node
                self.out.append(row)
            else:
                above.waiting.append(row)
        if above is not None:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.leaves += node.leaves
            above.saved += node.saved

    def close(self) -> None:
        self._flush()
        while self.stack:
            self._close()


def _arrow(rows: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [column.split(" ") for column in SHARD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def trie(paths: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Nodes of all prefixes of ``paths``: ``conv_id, path, sizes, ends, below_children, below_leaves, below_saved``.

    ``ends``: the conversation ends with its path; otherwise the ``below_*`` numbers state what it adds below the path's
    end. An empty table has no nodes.
    """
    spark = paths.sparkSession
    paths = common.checkpoint(paths)
    total = paths.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_rows))
    shards = min(wanted, MOST_SHARDS)
    ordered = common.checkpoint(paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")).select(
        F.spark_partition_id().alias("shard"), "path", "conv_id", "sizes", "ends", "below_children", "below_leaves", "below_saved")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    begins = ordered.select("shard", "path").mapInArrow(first, "shard int, path binary").collect()  # one row a shard
    begins.sort(key=lambda r: r["shard"])
    number = {r["shard"]: i for i, r in enumerate(begins)}
    skeleton = Skeleton([bytes(r["path"]) for r in begins[1:]])
    shipped = spark.sparkContext.broadcast((skeleton, number))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in common.slices(batches):
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for part, path, *row in zip(*columns):
                if shard is None:
                    skeleton, number = shipped.value
                    shard = Shard(number[part], skeleton)
                shard.add(row[0], path, *row[1:])
            if shard is not None and shard.out:
                yield _arrow(shard.out)
                shard.out = []
        if shard is not None:
            shard.close()
            yield _arrow(shard.out)

    found = common.checkpoint(ordered.mapInArrow(finish, SHARD))
    if not begins:
        return found.select(*_names())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = found.filter("node IS NOT NULL AND place IS NULL").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), *sums)
    known = spark.createDataFrame(skeleton.finish(partial.toArrow()))  # MOST_SHARDS * HEAD nodes at most
    digests = common.joined_digest(found.filter("place IS NOT NULL").select("node", "place", F.col("ends").alias("body")), "node", b",", "int")
    of_skeleton = known.join(digests, "node", "left").select(*[c for c in _names() if c != "ends_sha256"], F.coalesce("sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"))
    parents = F.broadcast(known.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent")))
    finished = found.filter("node IS NULL").drop("node").join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("of_parent", "parent_conv_id"))
    return finished.select(*_names()).unionByName(of_skeleton)


def _names() -> list[str]:
    return [column.split(" ")[0] for column in NODE.split(", ")]


def _tails(counts: DataFrame, turns: DataFrame, paths: DataFrame, head: int) -> tuple[DataFrame, DataFrame]:
    """Nodes deeper than ``head``, and what each conversation adds below its path's end: ``conv_id, below_children,
    below_leaves, below_saved``.

    A node is named by its depth, the digest of its path and running sums of two hashes of its later turns and their
    places. Its smallest member owns it; subtree sums are sums, over the members, of what they own from its depth on.
    """
    # hash values are added as decimals: they may not overflow
    hashes = {name: F.xxhash64(F.lit(seed), "digest", "depth").cast("decimal(20,0)") for name, seed in (("s", 1), ("t", 2))}
    starts = paths.filter(F.col("n") > head).select("conv_id", "n", F.sha2("path", 256).alias("start"))
    deep = common.checkpoint(turns.filter(F.col("depth") > head))
    named = ordering.running_totals(deep, ["conv_id"], [F.col("depth")], hashes).join(starts, "conv_id")
    key = ["start", "depth", "s", "t"]
    named = common.checkpoint(named.select("conv_id", "n", "size", *key))
    nodes = named.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count("*").alias("members"), (F.max("n") == F.col("depth")).alias("leaf"))
    rows = named.join(nodes, key).withColumn("owns", (F.col("owner") == F.col("conv_id")).cast("long"))
    rows = common.checkpoint(rows.withColumn("own_leaf", F.col("owns") * F.col("leaf").cast("long")).withColumn(
        "own_saved", F.col("owns") * (F.col("members") - 1) * F.col("size")))
    below = common.checkpoint(ordering.running_totals(rows, ["conv_id"], [F.desc("depth")], {
        "leaves": F.col("own_leaf"), "saved": F.col("own_saved")}))
    above = below.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    first = paths.filter(F.col("n") >= head).groupBy(F.sha2("path", 256).alias("start")).agg(F.min("conv_id").alias("of_path"))
    parents = below.filter("owns = 1").join(above, ["conv_id", "depth"], "left").join(first, "start").select(
        *key, F.coalesce("parent_conv_id", "of_path").alias("parent_conv_id"))
    children = below.filter("owns = 1").select("conv_id", (F.col("depth") - 1).alias("depth"), F.lit(1).alias("child"))
    sums = below.join(children, ["conv_id", "depth"], "left").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count("child").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ending = below.filter("n = depth").select(F.sha2(F.concat_ws("|", *key), 256).alias("node"), F.col("conv_id").alias("place"),
                                              F.col("conv_id").cast("string").cast("binary").alias("body"))
    digests = common.joined_digest(ending, "node", b",", "string")
    found = sums.join(parents, key).withColumn("node", F.sha2(F.concat_ws("|", *key), 256)).join(digests, "node", "left").select(
        *[c for c in _names() if c != "ends_sha256"], F.coalesce("sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"))
    adds = below.filter(F.col("depth") == head + 1).select("conv_id", F.col("owns").alias("below_children"), F.col("leaves").alias("below_leaves"),
                                                          F.col("saved").alias("below_saved"))
    return found, adds


def prefix_trie(convs: DataFrame, head: int = HEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with NODE's columns; an empty table has none.

    Columns beyond conv_id, turn, role and text are not read. Repeated rows are turns of their own.
    """
    counts, turns = rebuilt(common.checkpoint(turns_of(convs)))
    turns = common.checkpoint(turns)
    paths = paths_of(counts, turns, head)
    zero = F.lit(0).cast("long")
    none = [zero.alias(f"below_{name}") for name in ("children", "leaves", "saved")]
    ends = (F.col("n") <= head).alias("ends")
    if counts.filter(F.col("n") > head).isEmpty():
        return trie(paths.select("conv_id", "path", "sizes", ends, *none), shard_rows)
    paths = common.checkpoint(paths)
    deeper, adds = _tails(counts, turns, paths, head)
    joined = paths.join(adds, "conv_id", "left").select("conv_id", "path", "sizes", ends, *[
        F.coalesce(f"below_{name}", zero).alias(f"below_{name}") for name in ("children", "leaves", "saved")])
    return trie(joined, shard_rows).unionByName(deeper)
