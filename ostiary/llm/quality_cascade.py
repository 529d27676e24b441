"""Quality rules as a short-circuit cascade, ordered by what a sample says about their cost and selectivity.

A text is kept if no rule rejects it, so the verdict does not depend on the order of the rules, only the work does. On a
bounded sample every rule is timed and its rejections are recorded; then the rule with the most rejections per second among
the texts that the rules before it leave comes first, and so on. Measures of a text are computed when a rule first asks.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common

# Texts of the sample: about so many, chosen by a hash of the text, and of each at most so many bytes are a text's share.
SAMPLE_TEXTS = 2_000
SYMBOLS = b"#*$%&|<>"
BULLETS = ("-".encode(), "*".encode(), "•".encode())
ELLIPSES = (b"...", "…".encode())
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_CONTINUED = bytes(range(0x80, 0xC0))


class Text:
    """Measures of one text, in UTF-8. Words are what white space of ASCII separates, lines what line feeds do."""

    def __init__(self, body: bytes) -> None:
        self.body = body

    @cached_property
    def words(self) -> list[bytes]:
        return self.body.split()

    @cached_property
    def joined(self) -> bytes:
        return b"".join(self.words)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.body.split(b"\n") if line and not line.isspace()]

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.joined.translate(None, _CONTINUED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.joined) - len(self.joined.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three words that occurs again."""
        if len(self.words) < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, len(self.words))
        kinds = len(number)
        if kinds < 1 << 21:
            windows = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
        else:  # three numbers do not fit one: number the pairs first
            pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * kinds + ids[2:]
        _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[at] > 1
        inside = np.zeros(len(ids), bool)
        for shift in range(3):
            inside[shift:len(ids) - 2 + shift] |= again
        return int(inside.sum())

    @cached_property
    def n_letterless(self) -> int:
        """Words without a letter; every character beyond ASCII counts as one."""
        return sum(n for w, n in self.counts.items() if not w.translate(None, _NOT_LETTERS))

    @cached_property
    def top_word(self) -> int:
        """Occurrences of the most frequent word."""
        return max(self.counts.values(), default=0)

    @cached_property
    def n_bullets(self) -> int:
        return sum(line.lstrip().startswith(BULLETS) for line in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(line.rstrip().endswith(ELLIPSES) for line in self.lines)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 4 * len(t.lines)),
    Rule("letterless_words", lambda t: 10 * t.n_letterless > 3 * t.n_words),
    Rule("one_word", lambda t: 10 * t.top_word > 3 * t.n_words),
    Rule("bullet_lines", lambda t: 10 * t.n_bullets > 9 * len(t.lines)),
    Rule("ellipsis_lines", lambda t: 10 * t.n_ellipses > 3 * len(t.lines)),
)
BASE_RULES = ("few_words", "repeated_windows")


def _order(patterns: list[tuple[int, int, list[float]]], rules: int) -> list[int]:
    """Greedy order: ``patterns`` are (bits of the rejecting rules, texts, seconds of each rule on them)."""
    waiting, left = list(range(rules)), patterns
    order = []
    while waiting:
        def rate(i: int) -> float:
            seconds = sum(p[2][i] for p in left)
            return sum(p[1] for p in left if p[0] >> i & 1) / max(seconds, 1e-12)

        def seconds(i: int) -> float:
            return sum(p[2][i] for p in patterns)

        best = min(waiting, key=lambda i: (-rate(i), seconds(i), i))  # rules that reject nothing more: cheapest first
        waiting.remove(best)
        order.append(best)
        left = [p for p in left if not p[0] >> best & 1]
    return order


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = SAMPLE_TEXTS) -> tuple[Rule, ...]:
    """The rules in the order in which to apply them. Without texts it is the given order."""
    total = docs.count()
    chosen = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < sample * (1 << 20) / max(1, total))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in common.bytes_of(batch, "text"):
                bits, seconds = 0, []
                for i, rule in enumerate(rules):
                    own = Text(body)
                    own.words  # every rule needs them: not part of a rule's cost
                    start = time.thread_time()
                    bits |= rule.rejects(own) << i
                    seconds.append(time.thread_time() - start)
                rows.append({"bits": bits, "seconds": seconds})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("bits", pa.int64()), ("seconds", pa.list_(pa.float64()))]))

    sums = [F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules))]
    found = chosen.mapInArrow(measure, "bits long, seconds array<double>").groupBy("bits").agg(F.count("*").alias("n"), *sums).collect()
    patterns = [(r["bits"], r["n"], [r[f"s{i}"] for i in range(len(rules))]) for r in sorted(found, key=lambda r: r["bits"])]
    return tuple(rules[i] for i in _order(patterns, len(rules))) if patterns else rules


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", measures: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``rejected_by`` (the first rule of the given order that rejects the text, null if kept) and
    ``rules_run``, and with ``measures`` of every text.

    Null texts count as empty. Other columns stay; those of these names are replaced.
    """
    def compute(batch: pa.RecordBatch) -> list:
        rejected, run, found = [], [], []
        for body in common.bytes_of(batch, text):
            own = Text(body)
            name, number = None, 0
            for number, rule in enumerate(rules, 1):
                if rule.rejects(own):
                    name = rule.name
                    break
            rejected.append(name)
            run.append(number)
            found.append([getattr(own, m) for m in measures])
        columns = list(zip(*found)) if found else [[] for _ in measures]
        return [*(pa.array(c, pa.int64()) for c in columns), pa.array(rejected, pa.string()), pa.array(run, pa.int32())]

    fields = ", ".join([*(f"{m} long" for m in measures), "rejected_by string", "rules_run int"])
    return common.with_columns(docs, fields, compute)
