"""Quality rules against plain definitions; the order of rules changes work, not verdicts."""

import random
import re

import pytest
from helpers import ODD, documents, empty, sentence
from hypothesis import given, settings, strategies as st

from ostiary.llm import quality_cascade as quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def _measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(inside)}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é日\n\t\x0b\x1c\x85#*|<.-•…"), max_size=80))
def test_measures(text):
    own = quality.Text(text.encode())
    assert {m: getattr(own, m) for m in quality.MEASURES} == _measures(text)
    words = WORD.findall(text)
    assert own.n_letterless == sum(not re.search("[A-Za-z\x80-\U0010ffff]", w) for w in words)
    assert own.top_word == max(map(words.count, words), default=0)


def test_many_kinds_of_words_are_numbered_in_pairs(monkeypatch):
    words = [b"%d" % (i % 2_200_000) for i in range(2_200_004)]
    assert quality.Text(b" ".join(words)).n_repeat_words == 8


def _texts():
    rng = random.Random(5)
    good = [sentence(rng, rng.choice(["en", "fr"]), rng.randint(60, 200)) for _ in range(20)]
    bad = {"few_words": "too short", "repeated_windows": "the very same words again and " * 30, "word_length": "x " * 30 + " ".join("abcdefghij"[i % 10] + "zyxwvutsrq"[i // 10 % 10] * (i % 2) for i in range(100)),
           "symbols": good[0] + " #" * 40, "repeated_lines": good[1] + "\nsame line" * 20, "letterless_words": " ".join(str(i * 37) + "." for i in range(90)) + " " + good[2][:60],
           "one_word": " ".join(w + (" the" if i % 2 else "") for i, w in enumerate(good[3].split())), "bullet_lines": "\n".join("- " + w + " and more of it " + w[::-1] for w in good[4].split()),
           "ellipsis_lines": "\n".join(w + " goes on" + w[::-1] + " ..." for w in good[5].split())}
    return good, bad


def test_cascade_in_any_order(spark):
    good, bad = _texts()
    docs = documents(spark, ODD + good + list(bad.values()))
    verdicts = []
    for order in (quality.RULES, quality.RULES[::-1], quality.plan(docs)):
        rows = quality.apply(docs, order, measures=quality.MEASURES).orderBy("doc_id").collect()
        verdicts.append([r["rejected_by"] is None for r in rows])
        for r in rows:
            rejecting = [rule.name for rule in order if rule.rejects(quality.Text((r["text"] or "").encode()))]
            assert r["rejected_by"] == (rejecting[0] if rejecting else None)
            assert r["rules_run"] == ([rule.name for rule in order].index(rejecting[0]) + 1 if rejecting else len(order))
            assert {m: r[m] for m in quality.MEASURES} == _measures(r["text"])
    assert verdicts[0] == verdicts[1] == verdicts[2]
    assert all(verdicts[0][len(ODD):len(ODD) + len(good)]) and not any(verdicts[0][len(ODD) + len(good):])
    for name, text in bad.items():
        assert {r.name: r for r in quality.RULES}[name].rejects(quality.Text(text.encode())), name


def test_greedy_order():
    # rule 0: slow, rejects much; rule 1: quick, rejects the same texts; rule 2: quick, rejects others
    patterns = [(0b011, 50, [5.0, 0.5, 0.1]), (0b100, 10, [1.0, 0.1, 0.1]), (0, 40, [4.0, 0.4, 0.2])]
    assert quality._order(patterns, 3) == [1, 2, 0]
    assert quality._order([(0, 5, [3.0, 1.0, 2.0])], 3) == [1, 2, 0]


def test_empty_table_and_clashing_names(spark):
    rules = quality.plan(empty(spark))
    assert rules == quality.RULES and quality.apply(empty(spark), rules).count() == 0
    clash = spark.createDataFrame([(None, "one", 5, "x"), (1, None, 6, "y"), (1, None, 6, "y")], "doc_id long, text string, n_words int, rejected_by string")
    rows = quality.apply(clash, rules, measures=("n_words",)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["rejected_by"]) for r in rows) == [(0, 1, "few_words"), (1, 0, "few_words"), (1, 0, "few_words")]


@pytest.mark.parametrize("sample", [0, 5, 10_000])
def test_plan_on_samples(spark, sample):
    good, bad = _texts()
    docs = documents(spark, good + list(bad.values()))
    assert sorted(r.name for r in quality.plan(docs, sample=sample)) == sorted(r.name for r in quality.RULES)
