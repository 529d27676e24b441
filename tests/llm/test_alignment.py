"""Alignment of two tokenizers against a brute-force version on whole texts."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from helpers import ODD, documents, empty, sentence
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ostiary.llm import alignment


@pytest.fixture(scope="module")
def encoder():
    return alignment.PairEncoder(*alignment.default_tokenizers())


class Library:
    """Both tokenizers on whole texts, and groups by their definition."""

    def __init__(self):
        a, b = alignment.default_tokenizers()
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def tokens(self, text):
        """Ids and bytes of both, or None where they do not give back the text."""
        if not text:
            return None
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
             for i in self.b.encode(text)]
        body = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == body == b"".join(x for _, x in b) else None

    def groups(self, text):
        found = self.tokens(text)
        if found is None:
            return [], []
        ends = []
        for side in found:
            at, own = 0, {}
            for i, body in side:
                at += len(body)
                own[at] = i
            ends.append(own)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for high in shared:
            groups.append("|".join(",".join(str(i) for end, i in own.items() if low < end <= high) for own in ends))
            low = high
        return groups, [(ends[0][x], ends[1][x]) for x in shared]


def _expected(texts):
    library = Library()
    groups, links = zip(*(library.groups(t) for t in texts)) if texts else ((), ())
    counts = Counter(pair for own in links for pair in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = {}
    for i, text in enumerate(texts):
        found = library.tokens(text) or ([], [])
        rows[i] = (len(found[0]), len(found[1]), len(groups[i]), len(links[i]), sum(counts[p] == best[p[1]] for p in links[i]),
                   sum(counts[p] for p in links[i]), hashlib.sha256(";".join(groups[i]).encode()).hexdigest() if groups[i] else "")
    return rows


def _rows(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()}


MORE = [" lead", "trail ", " ", "  ", "a  b   c", "a\n  b", "a \n\n b\n", "\n", "\nx", "x\xa0 y", "x\x85  y", "▁x", "a ▁ b", "<s> </s> <unk>", "it's 'll 12 345", "\x00 \x1c x",
        "日本語のテキスト " * 40, "word" * 900, "\t\t tab", "é ½ ﬁ ʼn", "x　 y"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAé '’stre<|> \n\t1.,\xa0▁　")), max_size=50))
def test_units_give_the_tokens_of_whole_texts(text):
    own = test_units_give_the_tokens_of_whole_texts
    own.state = getattr(own, "state", None) or (Library(), alignment.Units(alignment.PairEncoder(*alignment.default_tokenizers())))
    library, units = own.state
    valid, digests, counts, keys, _ = units.texts([text])
    groups, links = library.groups(text)
    assert digests == [hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""]
    assert counts[0, 2] == len(links) and [(k >> alignment.B_BITS, k & ((1 << alignment.B_BITS) - 1)) for k in keys.tolist()] == links


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefgh é日\n ,.'", min_size=1, max_size=200), st.integers(1, 40))
def test_composition_is_associative(text, size):
    own = test_composition_is_associative
    own.state = getattr(own, "state", None) or (Library(), alignment.PairEncoder(*alignment.default_tokenizers()))
    library, encoder = own.state
    body = (" " + text).encode()
    parts = [alignment.fragment(encoder, body[begin:end], begin, low, high, i) for i, (low, high, begin, end) in enumerate(alignment.ranges(body, size))]
    closed = {2 * i: groups for i, (_, groups, keys) in enumerate(parts) if len(keys)}

    def fold(items, rng):  # any order of composing neighbours
        items = list(items)
        found = dict(closed)
        while len(items) > 1:
            i = rng.randrange(len(items) - 1)
            whole, group = alignment.compose(items[i], items[i + 1])
            if group:
                found[2 * group[0] - 1] = alignment._group(*group[1:])
            items[i:i + 2] = [whole]
        if items[0].cut:
            found[2 * items[0].at - 1] = alignment._group(*items[0].prefix)
        return items[0], b";".join(found[k] for k in sorted(found))

    results = [fold((p[0] for p in parts), random.Random(seed)) for seed in range(3)]
    assert results[0] == results[1] == results[2] and results[0][0].suffix == ([], [])
    assert results[0][1].decode() == ";".join(library.groups(text)[0])
    assert alignment.compose(alignment.Fragment(), results[0][0])[0] == results[0][0]


@pytest.mark.parametrize("chunk, fan, pairs", [(alignment.CHUNK_BYTES, alignment.FAN, alignment.COMMON_PAIRS), (300, 2, 5), (37, 3, 0)])
def test_summary_equals_brute_force(spark, monkeypatch, chunk, fan, pairs):
    monkeypatch.setattr(alignment, "FAN", fan)
    rng = random.Random(3)
    texts = ODD + MORE + [sentence(rng, rng.choice(["en", "fr"]), rng.randint(1, 300)) for _ in range(30)] + ["same text twice"] * 2
    found = alignment.summary(documents(spark, texts), chunk_bytes=chunk, common_pairs=pairs)
    assert _rows(found) == _expected(texts)


def test_empty_null_and_repeated_ids(spark):
    assert alignment.summary(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "one two"), (1, None), (1, "one two"), (1, "one two")], "doc_id long, text string")
    found = sorted((r["doc_id"] is None, r["n_links"], r["count_sum"]) for r in alignment.summary(rows, chunk_bytes=3).collect())
    assert found == [(False, 0, 0), (False, 2, 6), (False, 2, 6), (True, 2, 6)]


def test_stretch_without_white_space_is_one_range():
    body = b" " + b"x" * 20_000 + b" y" * 500
    found = alignment.ranges(body, 256)
    assert found[0][:2] == (0, 20_224) and [r[0] for r in found[1:]] == [r[1] for r in found[:-1]] and found[-1][1] == len(body)
