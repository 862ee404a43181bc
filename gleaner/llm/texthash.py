"""Numpy helpers over whole texts: byte buffers, words, lines and their 64-bit hashes.

Texts of one Arrow batch are laid end to end as UTF-8 bytes, one line feed after
each, and every hash below comes from prefix sums over that buffer: a byte is looked
up in a table of random 64-bit numbers, multiplied by a power of an odd base and
summed modulo 2**64, so that the hash of any stretch is one subtraction and one
multiplication. Buffers hold about ``BLOCK`` bytes, so memory does not grow with the
batch; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
_RANDOM = np.random.default_rng(8191)
BYTE_TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0.. of the base and of its inverse, at least ``size`` of each."""
    return _powers(1 << max(21, (size - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches:
    """Hashes of stretches of one sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, width: int) -> np.ndarray:
        """Hash of every stretch of ``width`` numbers."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


class Block:
    """Some texts as one byte buffer; ``begin``/``end`` are each text's bytes."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes
        self.count = len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)

    def words(self, table: np.ndarray = BYTE_TABLE) -> Words:
        return Words(self, table)

    def counts(self, wanted: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many bytes of each stretch have a true entry in ``wanted`` (256 flags)."""
        total = np.zeros(len(self.bytes) + 1, dtype=np.int64)
        np.cumsum(wanted[self.bytes], out=total[1:])
        return total[end] - total[start]


class Words:
    """The words of a block: place, text number and hash of each."""

    def __init__(self, block: Block, table: np.ndarray):
        self.block = block
        inside = ~SEPARATOR[block.bytes]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, block.begin)
        last = np.searchsorted(self.start, block.end)
        self.per_text = last - self.first
        self.text = np.repeat(np.arange(block.count), self.per_text)
        stretches = Stretches(table[block.bytes])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix(stretches.hash(self.start, self.end) + length)
        self.stretches = stretches


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[slice, Block]]:
    """Consecutive texts as blocks of about ``limit`` bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield slice(start, i), Block(texts[start:i])
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield slice(start, len(texts)), Block(texts[start:])


def encoded(column) -> list[bytes]:
    """Texts of a pandas column as UTF-8 bytes; a null is an empty text."""
    return [t.encode() if isinstance(t, str) else b"" for t in column]
