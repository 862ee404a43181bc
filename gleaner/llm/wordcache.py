"""Encoding by words: strings that tokenizers encode on their own, each encoded once.

Texts are cut where the tokenizer itself always cuts, so encoding the pieces one by
one gives the ids of the whole. Most words of a corpus repeat, so each worker keeps
the ids of words that come again, up to a fixed number of words.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from gleaner.llm.prefix_table import Kept

KEPT_WORDS = 100_000
LONG_WORD = 64

#: Letters whose strings the tokenizers take as words, white space of the byte-level
#: pattern, that without space and line feed, and printable ASCII but letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΆΈ-ώЀ-ҁҊ-ԯḀ-ỿ"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RARE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SIGNS = "!-@\\[-`{-~"
#: Strings that byte-level tokenizers and the pieces encode on their own. They end before a
#: space or line feed that follows something else than white space, between a letter and
#: an ASCII sign, and between such a sign (but an apostrophe, which contractions begin
#: with) and a letter.
UNIT = re.compile(
    f"[ \\n]*[{LETTERS}]+(?=[ \\n{SIGNS}]|\\Z)"
    f"|[ \\n]*[{SIGNS}]+(?:(?=[ \\n]|\\Z)|(?<!')(?=[{LETTERS}]))"
    f"|[{WHITE}]*[^{WHITE}]+(?:[{RARE}][{WHITE}]*(?:[^{WHITE}]+|\\Z))*"
    f"|[{WHITE}]+"
)
#: The same between white space, which the tokenizer with word ends drops; one letter is
#: left out, which becomes a letter and a mark in lower case.
_CASED = LETTERS.replace("Ø-öø-ɏ", "Ø-öø-įı-ɏ")
WORD_UNIT = re.compile(f"[{_CASED}]+(?=[ \\t\\n\\r{SIGNS}]|\\Z)|[{SIGNS}]+(?:(?=[ \\t\\n\\r]|\\Z)|(?<!')(?=[{_CASED}]))|[^ \\t\\n\\r]+")
PLAIN_WORD = re.compile(r"[^ \t\n\r]+")


def default_tokenizer(name: str) -> str:
    """Path of a tokenizer file of the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer in ``path``, without truncation or padding, once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordCache:
    """Word to (ids as little-endian bytes, tokens joined by spaces), words that come again
    and again kept. Plain words go through a prefix table, others to the tokenizer."""

    def __init__(self, path: str, with_text: bool = False, kept: int = KEPT_WORDS):
        from gleaner.llm.byte_bpe import word_ends

        self.tokenizer, self.with_text = load(path), with_text
        self.words = word_ends(path)
        self.kept = Kept(self._encode, kept, LONG_WORD)

    def _encode(self, words: list[str]) -> list[tuple[bytes, str]]:
        if not words:
            return []
        ids, first = self.words.encode(words, self.tokenizer)
        data, ends = ids.astype("<u4").tobytes(), first.tolist()
        parts = [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
        if not self.with_text:
            return [(p, "") for p in parts]
        names = list(map(self.words.names.__getitem__, ids.tolist()))
        return [(p, " ".join(names[a:b])) for p, a, b in zip(parts, ends, ends[1:], strict=False)]

    def encode(self, words: list[str]) -> list[tuple[bytes, str]]:
        """What each of ``words`` encodes to."""
        return self.kept.all(words)


@lru_cache(maxsize=4)
def cache(path: str, with_text: bool = False) -> WordCache:
    return WordCache(path, with_text)


@lru_cache(maxsize=2)
def _byte_level(path: str) -> Kept:
    from gleaner.llm.byte_bpe import byte_level

    def make(strings: list[str]) -> list[bytes]:
        ids, first = byte_level(path).encode(strings) if strings else (np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64))
        data, ends = ids.astype("<u4").tobytes(), first.tolist()
        return [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]

    return Kept(make, KEPT_WORDS, LONG_WORD)


def byte_level_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts by a byte-level tokenizer, special tokens recognised as it does.

    A text that may hold a special token is given to the tokenizer whole.
    """
    words, spans = [], []
    for text in texts:
        at = len(words)
        if "<|" not in text:
            words.extend(UNIT.findall(text))
        spans.append((at, len(words)))
    ids = _byte_level(path).all(words)
    return [
        np.array(load(path).encode(t, add_special_tokens=False).ids, dtype="<u4") if "<|" in t else np.frombuffer(b"".join(ids[a:b]), dtype="<u4")
        for t, (a, b) in zip(texts, spans, strict=True)
    ]
