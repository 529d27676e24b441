"""Token ids, record files and packing against the tokenizers library and by round trip."""

import random
import struct
import zlib

import numpy as np
import pytest
from helpers import ODD, documents, empty, sentence
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ostiary.llm import common, crc32c, packing, records, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return tokens.TextEncoder(tokens.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAéÉ '’stdre<|> \n\t1½.,\x1c\x85\xa0")), max_size=60))
def test_ids_equal_whole_text_encoding(text):
    whole = Tokenizer.from_file(tokens.default_tokenizer()) if not hasattr(test_ids_equal_whole_text_encoding, "t") else test_ids_equal_whole_text_encoding.t
    test_ids_equal_whole_text_encoding.t = whole
    own = tokens.encoder(tokens.default_tokenizer())
    assert list(next(own.encode([text.encode()]))) == whole.encode(text, add_special_tokens=False).ids


def test_odd_texts(library, encoder):
    for text in ODD:
        text = text or ""
        assert list(next(encoder.encode([text.encode()]))) == library.encode(text, add_special_tokens=False).ids


def _crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (crc32c.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    rng = random.Random(1)
    parts = [b"", b"a", b"123456789", *(rng.randbytes(n) for n in (3, 4, 5, 255, 256, 257, 511, 512, 513, 5000))]
    assert crc32c.checksums([b"123456789"])[0] == 0xE3069283  # published check value
    assert list(crc32c.checksums(parts)) == [_crc(p) for p in parts]


def test_frames():
    parts = [b"", b"abc", bytes(1000)]
    blob = b"".join(records.frame(parts))
    assert records.unframe(blob) == parts
    for at in (9, 13, len(blob) - 1, 20):
        broken = bytearray(blob)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        records.unframe(blob[:-1])


def test_record_round_trip(spark, library):
    rng = random.Random(2)
    texts = ODD + [sentence(rng, words=rng.randint(1, 400)) for _ in range(80)]
    docs = documents(spark, texts).orderBy("text")
    store = records.write(docs, common.shared_folder(spark, "test"), tokens.default_tokenizer())
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    rows = records.summary(store).collect()
    assert len(rows) == len(texts)
    start = 0
    for row in sorted(rows, key=lambda r: r["doc_id"]):
        ids = want[row["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    shuffled = store.index.sample(0.5, seed=3).orderBy("size")  # reads in any order
    for row in records.read(store, shuffled).collect():
        assert row["ids"] == want[row["doc_id"]]


def test_records_of_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, None)], "doc_id long, text string")
    rows = records.summary(records.write(docs, common.shared_folder(spark, "test"), tokens.default_tokenizer())).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(False, 0, 2), (True, 1, 1), (True, 1, 3), (True, 1, 3)]
    assert min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert records.summary(records.write(empty(spark), common.shared_folder(spark, "test"), tokens.default_tokenizer())).count() == 0


def test_assign_keeps_all_limits():
    rng = np.random.default_rng(4)
    lengths, losses = rng.integers(0, 300, 500), None
    losses = (lengths * rng.random(500)).astype(int)
    sequence, offset = packing.assign(lengths, losses, (512, 6, 200 + 100))
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        assert lengths[own].sum() <= 512 and len(own) <= 6 and losses[own].sum() <= 300
        by = own[np.lexsort((lengths[own] > 0, offset[own]))]
        assert list(offset[by]) == list(np.cumsum(lengths[by]) - lengths[by])
    with pytest.raises(ValueError):
        packing.assign(np.array([600]), np.array([0]), (512, 6, 300))


def test_packing_is_whole_and_tight(spark, library):
    rng = random.Random(5)
    texts = ODD + [sentence(rng, words=rng.randint(1, 3_000)) for _ in range(120)]
    pieces = common.checkpoint(packing.cut(documents(spark, texts), tokens.default_tokenizer(), ids=True))
    packed = packing.pack(pieces)
    rows = packed.toPandas()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for doc, own in rows.groupby("doc_id"):
        own = own.sort_values("start")
        assert [x for part in own["ids"] for x in part] == ids[doc] and set(own["doc_tokens"]) == {len(ids[doc])}
        assert list(own["start"]) == [0, *own["length"].cumsum()[:-1]]
        for row in own.itertuples():
            assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{row.length}I", *row.ids))
    totals = rows.groupby("sequence_id")["length"].sum()
    assert totals.max() <= 2048
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own["offset"]) == [0, *own["length"].cumsum()[:-1]]
    assert 1 - totals.sum() / (2048 * len(totals)) < 0.05
    whole = packing.sequences(packed).toPandas()
    assert whole["loss_mask"].map(sum).sum() == sum(map(len, ids.values()))
    assert set(whole["ids"].map(len)) - {2 ** k for k in range(11)} <= {2048}


def test_packing_of_nothing_and_instructions(spark):
    assert packing.pack(common.checkpoint(packing.cut(empty(spark), tokens.default_tokenizer()))).count() == 0
    table = spark.createDataFrame([(i, 100, 60, "x") for i in range(50)] + [(99, None, None, None)], "id long, length long, answer long, offset string")
    rows = packing.pack(common.checkpoint(table), loss="answer", max_tokens=1000, max_segments=20, max_loss_tokens=180).toPandas()
    assert len(rows) == 51 and rows.groupby("sequence_id")["answer"].sum().max() <= 180 and rows["sequence_id"].nunique() == 17
