"""Language ID, toxicity and suffix-tree scores: brute force, proper distributions, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, documents, empty, sentence
from pyspark.sql import functions as F

from ostiary.llm import kneser_ney, langid, suffix_tree, toxicity


def _pieces(words, columns, counts, order):
    parts = [[] for _ in range(7)]
    for k, *rest in kneser_ney.grams(words, np.array(columns), np.array(counts, float), order):
        for part, value in zip(parts, [np.full(len(rest[1]), k), *rest]):
            part.append(value)
    return [np.concatenate(p) for p in parts]


def _plain_kneser_ney(counts, order):
    """Probability function of one column, straight from the definition."""
    grams = [defaultdict(float) for _ in range(order + 1)]
    for word, n in counts.items():
        text = f" {word} "
        for at in range(1, len(text)):
            for k in range(1, min(order, at + 1) + 1):
                grams[k][text[at - k + 1:at + 1]] += n
    use = [None] * (order + 1)
    for k in range(1, order + 1):
        if k == order:
            use[k] = dict(grams[k])
        else:
            before = Counter(g[1:] for g in grams[k + 1])
            use[k] = {g: (n if k > 1 and g[0] == " " else before.get(g, 0)) for g, n in grams[k].items()}
    alphabet = len(grams[1]) + 1
    cut = [0.0] * (order + 1)
    for k in range(1, order + 1):
        values = list(use[k].values())
        ones, twos = values.count(1), values.count(2)
        cut[k] = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))

    def p(context, symbol, k):
        if k == 0:
            return 1 / alphabet
        context = context[len(context) - k + 1:] if k > 1 else ""
        after = {g: n for g, n in use[k].items() if g[:-1] == context}
        total = sum(after.values())
        lower = p(context[1:], symbol, k - 1)
        if not total:
            return lower
        kinds = sum(n > 0 for n in after.values())
        return max(after.get(context + symbol, 0) - cut[k], 0) / total + cut[k] * kinds / total * lower

    def score(word):
        text = f" {word} "
        return sum(math.log(p(text[:at], text[at], min(order, at + 1))) for at in range(1, len(text)))

    return score


def test_kneser_ney_equals_its_definition():
    rng = random.Random(1)
    counts = Counter(w for w in sentence(rng, words=300).split())
    model = kneser_ney.build(_pieces(list(counts), [0] * len(counts), list(counts.values()), 3), 1, 3)
    plain = _plain_kneser_ney(counts, 3)
    words = list(counts)[:40] + ["th", "zzz", "onq", "hhhhhh"]
    assert kneser_ney.word_scores(model, words)[:, 0] == pytest.approx([plain(w) for w in words], rel=1e-4)
    assert list(kneser_ney.word_scores(model, ["th", "a"])[:, 1]) == [3, 2]
    assert kneser_ney.word_scores(model, []).shape == (0, 2)


def test_language_id(spark):
    rng = random.Random(2)
    texts = [sentence(rng, lang, 40) for lang in ("en", "fr") * 100]
    docs = documents(spark, texts).withColumn("label", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    model = langid.fit(docs.filter("doc_id < 150"))
    rows = langid.identify(docs.filter("doc_id >= 150"), model).collect()
    assert all(r["lang_pred"] == r["label"] and 0.5 < r["score"] <= 1 and not r["rejected"] for r in rows)
    odd = {r["doc_id"]: r for r in langid.identify(documents(spark, ODD + ["qqq xxx jjj " * 200, "1234 %%"]), model).collect()}
    for i in (0, 1, 2, len(ODD) + 1):
        assert (odd[i]["lang_pred"], odd[i]["score"], odd[i]["rejected"]) == ("und", 0.0, True)
    assert odd[len(ODD)]["rejected"] and odd[len(ODD)]["part"] == f"s{len(ODD)}"
    assert langid.identify(empty(spark), model).count() == 0


def test_language_id_without_examples(spark):
    model = langid.fit(documents(spark, ["a b"]).withColumn("label", F.lit(None).cast("string")))
    assert [r["lang_pred"] for r in langid.identify(documents(spark, ["a b", None]), model).collect()] == ["und", "und"]


def test_toxicity(spark):
    rng = random.Random(3)
    texts = []
    for i in range(480):
        words = sentence(rng, words=80).split()
        if i % 3 == 0:
            words[rng.randrange(80)] = rng.choice(["idiot", "scum", "idiots"])
        texts.append(" ".join(words))
    docs = documents(spark, texts).withColumn("label", (F.col("doc_id") % 3 == 0).cast("int"))
    model = toxicity.fit(docs.filter("doc_id < 360"))
    rows = toxicity.score(docs.filter("doc_id >= 360").drop("score"), model).collect()
    assert sum((r["score"] >= 0.5) == bool(r["label"]) for r in rows) >= 0.9 * len(rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    odd = toxicity.score(documents(spark, ODD), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and len(odd) == len(ODD)
    assert toxicity.score(empty(spark), model).count() == 0
    alone = toxicity.fit(docs.filter("label = 0"))
    assert [r["predicted"] for r in toxicity.score(documents(spark, ["x"]), alone).collect()] == [0]


def _brute(texts, train):
    counts = Counter(w for t in train for w in (t or "").encode().lower().split())
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        out.append((len(words) + 1, sum(w in counts for w in words) + 1, total, base + math.log10((len(train) + 0.1) / (total + 0.1 * (kinds + 1)))))
    return out


@pytest.mark.parametrize("common_words", [1_000_000, 20, 0])
def test_base_scores(spark, common_words):
    rng = random.Random(4)
    texts = ODD + [sentence(rng, words=rng.randint(1, 200)) for _ in range(60)]
    docs = documents(spark, texts + texts[:20]).drop("score")
    rows = suffix_tree.score(docs, docs.filter("doc_id % 4 > 0").select("text"), common_words=common_words).collect()
    want = _brute(texts + texts[:20], [t for i, t in enumerate(texts + texts[:20]) if i % 4])
    assert len(rows) == len(want) and "part" in rows[0].asDict()
    for row in rows:
        expected = want[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == expected[:3]
        assert row["base_score"] == pytest.approx(expected[3], rel=1e-9)


def _grown(spark, texts):
    return next(suffix_tree.grow(suffix_tree.count_windows(documents(spark, texts), "text")).trees())


def test_every_context_that_passes_is_kept(spark):
    """The divergence test by its definition, over all contexts of the texts."""
    rng = random.Random(6)
    texts = [sentence(rng, rng.choice(["en", "fr"]), words=120) for _ in range(25)]
    counts = defaultdict(Counter)
    for text in texts:
        whole = b"\n" * suffix_tree.DEPTH + b" ".join(text.encode().lower().split()) + b"\n"
        for at in range(suffix_tree.DEPTH, len(whole)):
            for depth in range(suffix_tree.DEPTH + 1):
                counts[whole[at - depth:at]][whole[at]] += 1
    kept = {b""}
    for context, own in counts.items():
        if context:
            total, above = sum(own.values()), counts[context[1:]]
            gain = sum(n * (math.log(n / total) - math.log(above[s] / sum(above.values()))) for s, n in own.items())
            if gain > len(own) * math.log(total) / 2:
                kept |= {context[i:] for i in range(len(context))}
    tree = _grown(spark, texts)
    found = {c.to_bytes(8, "big")[8 - d:] if d else b"" for d, c in zip(tree.depth.tolist(), tree.context.tolist())}
    assert found == kept and len(kept) > 100


def test_parts_of_the_tree_give_the_same_scores(spark):
    rng = random.Random(7)
    docs = documents(spark, ODD + [sentence(rng, rng.choice(["en", "fr"]), words=rng.randint(1, 150)) for _ in range(40)]).drop("score")
    whole, cut = ({r["doc_id"]: r["score"] for r in suffix_tree.score(docs, docs.select("text"), part_contexts=n).collect()} for n in (10**6, 60))
    forest = suffix_tree.grow(suffix_tree.count_windows(docs, "text"), 60)
    assert len(forest.parts) > 3 and set(whole) == set(cut)
    assert [cut[i] for i in sorted(cut)] == pytest.approx([whole[i] for i in sorted(whole)], rel=1e-5)


def test_tree_scores_equal_longest_suffixes(spark):
    rng = random.Random(5)
    texts = [sentence(rng, words=200) for _ in range(40)]
    tree = _grown(spark, texts)
    assert tree.depth.max() >= 2
    automaton = suffix_tree.Automaton(tree)
    counts = defaultdict(dict)
    for d, c, s, n in zip(tree.depth.tolist(), tree.context.tolist(), tree.symbol.tolist(), tree.n.tolist()):
        counts[c.to_bytes(8, "big")[8 - d:] if d else b""][s] = n
    seen = set(tree.symbol.tolist()) | {10}

    def probability(context, symbol):
        if not context:
            unseen = max(1, 256 - len(seen))
            total = sum(counts[b""].values()) + 0.5 * len(seen) + 0.5 * unseen
            return (counts[b""].get(symbol, 0) + 0.5) / total if symbol in seen else 0.5 / total
        parent = context[1:]
        while parent and parent not in counts:
            parent = parent[1:]
        own, lower = counts[context], probability(parent, symbol)
        return (own.get(symbol, 0) + len(own) * lower) / (sum(own.values()) + len(own))

    for text in [b"", b"th er", b"onan zz \xc3\xa9", texts[0].encode()]:
        whole, total = b"\n" * suffix_tree.DEPTH + text + b"\n", 0.0
        for at in range(suffix_tree.DEPTH, len(whole)):
            context = whole[at - suffix_tree.DEPTH:at]
            while context not in counts and context:
                context = context[1:]
            total += math.log10(probability(context, whole[at]))
        assert automaton.score([text])[0] == pytest.approx(total, rel=1e-4)
    many = [b"th er on", b"", texts[1].encode() * 3]
    assert automaton.score(many) == pytest.approx([automaton.score([t])[0] for t in many], rel=1e-5)


def test_next_symbols_sum_to_one(spark):
    automaton = suffix_tree.Automaton(_grown(spark, ["the cat sat on the mat " * 30]))
    table = 10.0 ** automaton.logs.reshape(-1, automaton.width).astype(float)
    unseen = 256 - (automaton.width - 1)
    assert table[:, 1:].sum(1) + unseen * table[:, 0] == pytest.approx(np.ones(len(table)), rel=1e-4)


def test_scores_without_training(spark):
    docs = documents(spark, ["a b", None]).drop("score")
    rows = suffix_tree.score(docs, docs.limit(0).select("text")).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in rows)
    assert suffix_tree.score(empty(spark), docs.select("text")).count() == 0
