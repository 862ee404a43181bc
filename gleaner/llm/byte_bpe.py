"""Byte-level BPE for many short strings, words of letters by a prefix table.

A string of at most one space and letters of the alphabets in ``LETTERS`` is one word
for the tokenizer's own cutting, so its ids are those of its bytes under the merges
alone. Other strings go to the tokenizer.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from gleaner.llm.prefix_table import MergeTable
from gleaner.llm.wordcache import LETTERS

PLAIN = re.compile(f" ?[{LETTERS}]+")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones
    for themselves, the others for those from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        of = byte_symbols()
        self.text = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items() if all(c in of for c in t)}
        size = max(self.text) + 1
        self.size = np.array([len(self.text.get(i, b"")) for i in range(size)], dtype=np.int64)
        tokens = [tuple(self.text.get(i, b"")) for i in range(size)]
        vocabulary = model["vocab"]
        joins, rank = {}, [0.0] * size
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in vocabulary:
                joins[vocabulary[a], vocabulary[b]] = vocabulary[a + b]
                rank[vocabulary[a + b]] = r
        self.table = MergeTable(256, tokens, rank, joins)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, one after another, and where each string's begin, with the end of all."""
        words = np.fromiter((PLAIN.fullmatch(s) is not None for s in strings), dtype=bool, count=len(strings))
        plain = [s.encode() for s, w in zip(strings, words.tolist(), strict=True) if w]
        sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
        found = self.table.encode(np.frombuffer(b"".join(plain), dtype=np.uint8).astype(np.int64), sizes)
        others = [s for s, w in zip(strings, words.tolist(), strict=True) if not w]
        more = [e.ids for e in self.library.encode_batch_fast(others, add_special_tokens=False)] if others else []
        return _merged(words, found.tokens, np.diff(found.first), more)


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


#: Letters that lower case changes one by one and that stand composed.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")


class WordEnds:
    """A byte-level tokenizer file whose words end in a mark of their own, lower-cased.

    A word of Latin letters goes through the prefix table, its last byte as a symbol with
    the mark; other words go to the tokenizer.
    """

    MARK = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, of = whole["model"], byte_symbols()
        vocabulary = model["vocab"]
        added = {t["id"]: t["content"] for t in whole.get("added_tokens", [])}
        self.names = [""] * (max(*vocabulary.values(), *added) + 1)
        for i, name in added.items():
            self.names[i] = name
        spelled: dict[int, tuple[int, ...]] = {}
        for name, i in vocabulary.items():
            self.names[i] = name
            bare = name.removesuffix(self.MARK)
            if all(c in of for c in bare) and bare:
                row = [of[c] for c in bare]
                spelled[i] = (*row[:-1], row[-1] + 256 * (bare != name))
        number = {i: t for t, i in enumerate(spelled)}
        self.id = np.fromiter(spelled, dtype=np.int64, count=len(spelled))
        joins, rank = {}, [0.0] * len(number)
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in vocabulary:
                made = number[vocabulary[a + b]]
                joins[number[vocabulary[a]], number[vocabulary[b]]] = made
                rank[made] = r
        self.table = MergeTable(512, list(spelled.values()), rank, joins)

    def encode(self, strings: list[str], library) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, one after another, and where each string's begin, with the end of all."""
        words = np.fromiter((LATIN.fullmatch(s) is not None for s in strings), dtype=bool, count=len(strings))
        plain = [s.lower().encode() for s, w in zip(strings, words.tolist(), strict=True) if w]
        sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
        symbols = np.frombuffer(b"".join(plain), dtype=np.uint8).astype(np.int64)
        symbols[np.cumsum(sizes) - 1] += 256
        found = self.table.encode(symbols, sizes)
        others = [s for s, w in zip(strings, words.tolist(), strict=True) if not w]
        more = [e.ids for e in library.encode_batch_fast(others, add_special_tokens=False)] if others else []
        return _merged(words, self.id[found.tokens], np.diff(found.first), more)


def _merged(words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, more: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of strings in order, those of ``words`` from ``ids``, the others from ``more``."""
    counts = np.zeros(len(words), dtype=np.int64)
    counts[words] = sizes
    counts[~words] = [len(i) for i in more]
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(first[-1], dtype=np.int64)
    inside = np.repeat(words, counts)
    out[inside] = ids
    out[~inside] = [x for i in more for x in i]
    return out, first


@lru_cache(maxsize=2)
def word_ends(path: str) -> WordEnds:
    return WordEnds(path)
