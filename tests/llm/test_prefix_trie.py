"""The conversation trie against brute force, with few rows a shard and short paths so that every route runs."""

import hashlib
import random
import zlib

import pytest

from ostiary.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"


def _nodes(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == path)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        turns = rng.choice([[], ["same"] * rng.randint(1, 12), [rng.choice("ab") for _ in range(rng.randint(1, 10))],
                            [rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(1, 4))], ["long", *"xyzxyzxyzxyz", rng.choice("pq"), *"ends"]])
        for i, text in enumerate(turns or ["é"]):
            rows.append((c, i, rng.choice(["user", "user", "user", "assistant"]), text, 7, "n"))
    rows += [(3, None, None, None, 1, "x"), (3, None, None, None, 1, "x"), (3, 0, "", "tie", 1, "x"), (3, 0, "", "tied", 1, "x"), (None, 0, "user", "no id", 1, "x"), (995, 0, "user", None, 1, "x")]
    return rows


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("head, rows, seed", [(prefix_trie.HEAD, prefix_trie.SHARD_ROWS, 1), (64, 3, 2), (3, 5, 3), (1, 50, 4), (2, 1, 5)])
def test_equals_brute_force(spark, monkeypatch, head, rows, seed):
    monkeypatch.setattr(prefix_trie, "END_IDS", 3)
    table = _rows(seed)
    found = prefix_trie.prefix_trie(spark.createDataFrame(table, SCHEMA), head, rows)
    assert found.columns == prefix_trie._names() and _found(found) == _nodes(table)


def test_copies_over_many_shards(spark):
    rows = [(c * 5, i, "user", "same", 0, "") for c in range(200) for i in range(9)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_rows=7)
    assert _found(found) == _nodes(rows)


def test_empty_and_only_null_ids(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x", 0, "")], SCHEMA)).count() == 0


def test_hot_conversation_longer_than_a_window(spark, monkeypatch):
    from ostiary import scale

    monkeypatch.setattr(scale, "TASK_GROUP_ROWS", 40)
    rows = [(c, i, "user", f"t{i % 7}" if i < 150 else f"{c}", 0, "") for c in (0, 5, 7) for i in range(200)] + [(11, 0, "user", "one", 0, "")]
    assert _found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), head=8)) == _nodes(rows)


def test_skeleton_holds_every_prefix_of_the_splitters():
    a, b, c = (bytes([i]) * prefix_trie.DIGEST for i in range(3))
    skeleton = prefix_trie.Skeleton([a, a + b, a + b + c, b])
    assert set(skeleton.number) == {b"", a, a + b, a + b + c, b} and skeleton.depth == [0, 1, 2, 3, 1]
