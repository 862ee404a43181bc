"""Whole-text SentencePiece encoding and decoding by a prefix table of merge results.

The model's text is the document after one space, every space written as U+2581. No
piece goes on over a line feed, from another character to a space, or from a letter (of
the alphabets in ``LETTERS``) to anything else or back, so tokens always end there: the
text is cut there into strings that are encoded on their own, most of them met before. New strings of a block go
through the prefix table of ``prefix_table`` together. Characters without a piece become
the pieces of their UTF-8 bytes, which join with nothing.

Decoding goes from the ids alone: the pieces' text, U+2581 as a space, bytes as they are,
without the space in front of the text. What a string decodes to is kept only where it is
not the string itself.

Odd rows: a null text is an empty one and has the end id only; a null doc_id is kept; a
repeated row is encoded by itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.prefix_table import Encoded, Kept, MergeTable
from gleaner.llm.wordcache import LETTERS, default_tokenizer

SPACE = "▁"
#: Strings of the text that are encoded on their own.
UNIT = re.compile(f" *[{LETTERS}]+| *[^{LETTERS} \\n]+| +|\\n+")
LETTER = re.compile(f"[{LETTERS}]")
#: Characters of text whose strings are looked up or encoded together.
BLOCK = 1 << 21
KEPT = 100_000
LONGEST = 48

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """The pieces of a model as a merge table, and what they decode to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = {
            model.id_to_piece(i): i
            for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        for a, b in {pair for p in plain for pair in zip(p, p[1:], strict=False)}:
            if "\n" in (a, b) or a != SPACE and (b == SPACE or bool(LETTER.match(a)) != bool(LETTER.match(b))):
                raise ValueError(f"a piece goes on from {a!r} to {b!r}, where texts are cut")
        characters = sorted(set("".join(plain)))
        symbol = {c: i + 1 for i, c in enumerate(characters)}
        texts = ["", *characters, *(p for p in plain if len(p) > 1)]
        number = {p: t for t, p in enumerate(texts)}
        rank = [-model.get_score(plain[p]) if p in plain else 0.0 for p in texts]
        joins = {}
        for p in texts[len(characters) + 1 :]:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    joins[number[p[:k]], number[p[k:]]] = number[p]
        tokens = [(0,), *(tuple(symbol[c] for c in p) for p in texts[1:])]
        self.table = MergeTable(len(characters) + 1, tokens, rank, joins)
        self.symbol = np.zeros(0x110000, dtype=np.int32)
        for c, s in symbol.items():
            self.symbol[ord(c)] = s
        self.symbol[ord(" ")] = symbol[SPACE]
        # Characters without a piece of their own stand for their bytes.
        self.id = np.array([plain.get(p, -1) for p in texts], dtype=np.int64)
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.end_id = model.eos_id()
        self.text: list[bytes] = [b""] * size
        for p, i in plain.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id.tolist()):
            self.text[i] = bytes([b])
        self.size = np.array([len(t) for t in self.text], dtype=np.int64)
        #: Decimal form of id i, at 2 * i inside a string, at 2 * i + 1 at its end.
        self.decimal = [f"{i} {end}" for i in range(size) for end in ("", "\n")]

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, one after another, and where each string's begin, with the end of all."""
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        points = np.frombuffer("".join(strings).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        found: Encoded = self.table.encode(self.symbol[points], sizes)
        ids = self.id[found.tokens]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, found.first
        # A token without an id is one character; its bytes take its place.
        spelled = [chr(points[e - 1]).encode() for e in found.end[odd].tolist()]
        many = np.ones(len(ids), dtype=np.int64)
        many[odd] = [len(s) for s in spelled]
        at = np.concatenate(([0], np.cumsum(many)))
        out = np.repeat(ids, many)
        out[out < 0] = self.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        return out, at[found.first]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def units(text: str) -> list[str]:
    """The strings of a text, with the space that the model puts before it."""
    return UNIT.findall(f" {text.replace(SPACE, ' ')}") if text else []


def spelled(model: Pieces, strings: list[str]) -> list[str]:
    """The ids of each string in decimal, a space after each; where they decode to another
    text than the string, that follows after a line feed."""
    if not strings:
        return []
    ids, first = model.encode(strings)
    last = np.zeros(len(ids), dtype=bool)
    last[first[1:] - 1] = True
    numbers = "".join(map(model.decimal.__getitem__, (2 * ids + last).tolist()))[:-1].split("\n")
    decoded = b"".join(map(model.text.__getitem__, ids.tolist()))
    place = np.concatenate(([0], np.cumsum(model.size[ids])))[first]
    own = np.cumsum([len(s.encode()) for s in strings])
    if decoded == "".join(strings).encode() and (place[1:] == own).all():
        return numbers
    texts = [decoded[a:b].decode(errors="replace") for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
    return [n if s == t else f"{n}\n{t}" for n, s, t in zip(numbers, strings, texts, strict=True)]


@lru_cache(maxsize=2)
def _kept(path: str) -> Kept:
    return Kept(lambda strings: spelled(pieces(path), strings), KEPT, LONGEST)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters in all."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > size:
            yield texts[start:i]
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield texts[start:]


def encode_texts(path: str, texts: list[str]) -> list[tuple[int, str, str]]:
    """(number of ids, ids in decimal joined by spaces, decoded text) of whole texts, end id last."""
    end = str(pieces(path).end_id)
    strings, spans = [], []
    for text in texts:
        at = len(strings)
        strings.extend(units(text))
        spans.append((at, len(strings)))
    found = _kept(path).all(strings)
    out = []
    for a, b in spans:
        ids = "".join(found[a:b])
        if "\n" not in ids:
            decoded = "".join(strings[a:b])
        else:
            parts = [x.partition("\n") for x in found[a:b]]
            ids = "".join([x[0] for x in parts])
            decoded = "".join([x[2] if x[1] else s for x, s in zip(parts, strings[a:b], strict=True)])
        out.append((ids.count(" ") + 1, ids + end, decoded[1:]))
    return out


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    path = model or default_tokenizer("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, ids, decoded = [], [], []
            for part in blocks(texts):
                for n, numbers, text in encode_texts(path, part):
                    counts.append(n)
                    ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)
