"""Token ids of whole texts by a public tokenizer whose pre-tokenizer drops white space.

Such a tokenizer cuts a text into pieces (runs of letters, digits, runs of other signs) and encodes each by itself, so a
text's ids are its pieces' ids in a row: each different piece goes through the library's BPE model once and is
remembered. Texts or words beyond ASCII and Latin letters, where case, normal forms and classes depend on the Unicode
version, go through the whole tokenizer. ``tests/llm`` compares both with encoding whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from ostiary.llm import common

END_ID = 1
MOST_PIECES = 300_000
MOST_PIECE_CHARS = 6_000_000
# ASCII signs, Latin letters of one case rule, and white space that both sides take for such.
_SIMPLE = regex.compile(r"[\t-\r -~¡-įı-ɏ]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte to the character that stands for it: printable Latin-1 for itself, the rest from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of lower-cased pieces, encoded when first met."""

    def __init__(self, model) -> None:
        self.model = model
        self.letters = _byte_letters()
        self.chars = 0

    def __missing__(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(spelled)]
        ids = self[piece] = struct.pack(f"<{len(found)}I", *found)
        self.chars += len(piece)
        return ids


class TextEncoder:
    """Encodes UTF-8 texts; ``path`` names the tokenizer file, which every executor has installed."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.starts = {t["content"][0] for t in stated["added_tokens"]}  # texts with these characters may hold special tokens
        self.pattern = self._pattern(stated)
        self.model = self.tokenizer.model
        self.pieces = _Pieces(self.model)

    @staticmethod
    def _pattern(stated: dict):
        """The pre-tokenizer's pattern if the tokenizer is of the kind that can be run piece by piece, else None."""
        steps = [s["type"] for s in (stated.get("normalizer") or {}).get("normalizers", [])]
        cuts = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])
        fits = (steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
                and stated["model"]["type"] == "BPE")
        if not fits:
            return None
        stated_pattern = cuts[0]["pattern"]["Regex"]
        for kind in ("L", "N"):  # the built-in engine is faster but lacks these classes: list their members among simple characters
            members = [c for c in map(chr, range(0x250)) if _SIMPLE.fullmatch(c) and regex.fullmatch(rf"\p{{{kind}}}", c)]
            stated_pattern = stated_pattern.replace(rf"\p{{{kind}}}", "".join(members))
        return re.compile(stated_pattern)

    def _simple(self, text: str) -> bool:
        return (self.pattern is not None and _SIMPLE.fullmatch(text) is not None and not any(c in text for c in self.starts)
                and unicodedata.is_normalized("NFC", text))

    def _ids(self, text: str) -> bytes:
        if self._simple(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))
        words = regex.split(r"[\t-\r ]+", text) if self.pattern is not None else [text]
        if len(words) == 1:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        odd = [w for w in words if not self._simple(w)]
        found = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))
        known = {w: np.array(next(found).ids, "<u4").tobytes() for w in odd}
        return b"".join(known[w] if w in known else self._ids(w) for w in words)

    def encode(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, without an end id, in order."""
        for text in texts:
            yield np.frombuffer(self._ids(text.decode("utf-8", "replace")), "<u4")
            if len(self.pieces) > MOST_PIECES or self.pieces.chars > MOST_PIECE_CHARS:
                self.pieces = _Pieces(self.model)


def encoder(path: str) -> TextEncoder:
    return common.once_per_worker(("tokenizer", path), lambda: TextEncoder(path))
