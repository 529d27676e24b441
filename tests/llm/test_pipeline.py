"""The pipeline's stages one by one on the smallest tables, and its empty run."""

import random

import numpy as np
import pytest
from helpers import ODD, documents, sentence

import __spark_entry__
import corpus_pipeline
from ostiary.llm import near_copies, simhash


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == columns and 0.7 * count < out.count() <= count, name
            assert out.join(docs, columns, "left_semi").count() == out.count()  # rows pass unchanged
            docs, count = out, out.count()
    packed = out.toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in docs.collect()}
    assert packed.groupby("doc_id")["length"].sum().equals(packed.groupby("doc_id")["doc_tokens"].max())


def test_stages_on_no_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {f"op{n}_" for n in range(1, 11)} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}


def _groups(texts):
    """Smallest member by brute force over all pairs."""
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {find(i) for i in range(len(texts))}


def _edited(rng, count):
    """Chains of edits, ends replaced as well as single words."""
    texts = ODD + [sentence(rng, words=rng.randint(3, 150)) + " one very common line in many of the texts" for _ in range(30)]
    for _ in range(count):
        words = rng.choice(texts[len(ODD):]).split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(words[rng.randint(0, 2):]))
    return texts


@pytest.mark.parametrize("texts_of_block, radius", [(1_000, (64, 128)), (9, (64, 128)), (1_000, near_copies.RADIUS)])
def test_groups_of_near_copies(spark, monkeypatch, texts_of_block, radius):
    """With a radius that holds every pair, so that most candidates fail, groups equal brute force; the one in use loses hardly a link."""
    monkeypatch.setattr(near_copies, "LEAST_TILE", 20)
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", texts_of_block)
    texts = _edited(random.Random(8), 150)
    docs = documents(spark, texts).withColumnRenamed("part", "_fp").withColumnRenamed("fp", "_free0")
    kept = near_copies.one_per_group(docs, radius=radius)
    found, want = {r["doc_id"] for r in kept.collect()}, _groups(texts)
    assert kept.columns == docs.columns and found >= want and len(found - want) <= (0 if radius[1] == 128 else 2)


def test_dedup_stage_on_repeated_null_and_wordless_rows(spark):
    rows = [(1, "a b c d e", 9), (1, "a b c d e", 9), (1, "q r s t u", 8), (5, "q r s t u", 7), (2, None, 6), (3, "", 5), (4, " \n", 4), (None, "v w x y z", 3)]
    repeated = spark.createDataFrame(rows, "doc_id long, text string, _fp int")
    kept = corpus_pipeline.dedup_stage(spark, repeated, "").collect()
    assert sorted(((r["doc_id"] or -1), r["text"], r["_fp"]) for r in kept) == [(-1, "v w x y z", 3), (1, "a b c d e", 9), (1, "q r s t u", 8), (2, None, 6)]


def test_recall_of_the_radius():
    """Of pairs whose similarity is just LEAST or more, the radius keeps at least 0.95."""
    rng = random.Random(4)
    near = total = 0
    for _ in range(600):
        words = [str(rng.random()) for _ in range(rng.randint(30, 400))]
        other = list(words)
        for _ in range(max(1, round(len(words) * rng.uniform(0.005, 0.03)))):
            other[rng.randrange(len(other))] = str(rng.random())
        a, b = (near_copies.shingles(" ".join(w).encode()) for w in (words, other))
        both = len(set(a.tolist()) & set(b.tolist()))
        if both >= 0.8 * (len(a) + len(b) - both):
            x, y = near_copies.fingerprint(a), near_copies.fingerprint(b)
            bits = [bin((i ^ j) & (2**64 - 1)).count("1") for i, j in zip(x, y)]
            total += 1
            near += bits[0] <= near_copies.RADIUS[0] and sum(bits) <= near_copies.RADIUS[1]
    assert total > 300 and near >= 0.95 * total


def test_forest_connects_what_candidates_connect():
    rng = np.random.default_rng(1)
    for size, split in ((700, 0), (900, 300)):
        rows = np.zeros(size, [("first", "<u8"), ("second", "<u8"), ("size", "<i8")])
        rows["first"], rows["second"], rows["size"] = rng.integers(0, 2**20, size), rng.integers(0, 2**20, size), rng.integers(90, 110, size)
        for name in ("first", "second"):  # few bits: many pairs are near
            rows[name] &= np.uint64(0x8421084210)
        rows["first"] ^= rng.integers(0, 2**40, size).astype("<u8") & np.uint64(rng.integers(0, 2**40))
        a, b = near_copies._candidates(rows, split, 0.8)
        left = np.arange(split or size)
        x, y = np.array([(i, j) for i in left for j in range(max(split, i + 1), size)
                         if (d := int(rows["first"][i] ^ rows["first"][j]).bit_count()) <= 20 and d + int(rows["second"][i] ^ rows["second"][j]).bit_count() <= 34
                         and min(rows["size"][[i, j]]) >= 0.8 * max(rows["size"][[i, j]])]).T
        parents = []
        for i, j in ((a, b), (x, y)):
            parent = np.arange(size)
            simhash._join(parent, i.copy(), j.copy())
            parents.append(simhash._roots(parent, np.arange(size)).tolist())
        assert parents[0] == parents[1] and len(a) == size - len(set(parents[0]))  # a forest, no circle


def test_common_shingles_by_products(monkeypatch):
    rng = random.Random(2)
    sets = [np.unique(np.array(rng.sample(range(300), rng.randint(0, 60)), "<u8")) for _ in range(70)]
    monkeypatch.setattr(near_copies, "COLUMNS", 17)
    found = near_copies.common_shingles(sets[:30], sets[30:])
    assert found.tolist() == [[len(set(x) & set(y)) for y in sets[30:]] for x in sets[:30]]
    assert near_copies.common_shingles(sets[:1], [np.zeros(0, "<u8")]).tolist() == [[0]]
    monkeypatch.setattr(near_copies, "PRODUCT", 8)
    near = [np.unique(np.append(s, rng.randrange(300))).astype("<u8") for s in sets if len(s)] * 2
    for split in (0, 40):
        a, b = near_copies._exact_forest(near, np.arange(len(near)), split, 0.8)
        parents = [np.arange(len(near)) for _ in range(2)]
        simhash._join(parents[0], a.copy(), b.copy())
        pairs = [(i, j) for i in range(split or len(near)) for j in range(max(split, i + 1), len(near))
                 if len(set(near[i]) & set(near[j])) >= 0.8 * len(set(near[i]) | set(near[j]))]
        simhash._join(parents[1], *np.array(pairs).T)
        assert simhash._roots(parents[0], np.arange(len(near))).tolist() == simhash._roots(parents[1], np.arange(len(near))).tolist()
