"""Repeatable draws: md5 of (seed, step, row key), the same on every retry."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(*columns: Column | str) -> Column:
    """One string naming a row; the columns together must be unique."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat_ws("|", *parts)


def draw(seed: int, step: str | Column, key: Column) -> Column:
    """32 hex digits for this row and step."""
    name = F.lit(step) if isinstance(step, str) else step
    return F.md5(F.concat_ws("|", F.lit(str(seed)), name, key))


def share_cut(share: float) -> str:
    """The 8-digit hex bound with ``share`` of all draws below it."""
    return format(min(math.ceil(share * 2**32), 2**32 - 1), "08x")


def below(digest: Column, share: float) -> Column:
    """True for about ``share`` of the draws."""
    return F.substring(digest, 1, 8) < F.lit(share_cut(share))


def coin(seed: int, step: str, key: Column) -> Column:
    """A fair coin independent of the draw that selected the row."""
    return F.substring(draw(seed, step + ":coin", key), 1, 1) < F.lit("8")


#: Rounds of md5: what is added and by how much is turned, 16 rounds of each kind.
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [np.uint32(t) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
#: Numbers hashed in one go, about.
_HASHED = 16_384


def _md5_blocks(words: np.ndarray) -> np.ndarray:
    """The four words of the md5 of each column, a message of one padded block of 16 words."""
    start = [np.full(words.shape[1], x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[at]
        f += _ADDED[i]
        a, d, c, b = d, c, b, b + ((f << _TURNS[i]) | (f >> (np.uint32(32) - _TURNS[i])))
    return np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)])


def numbered_md5(prefixes: list[bytes], counts: list[int]) -> Iterator[np.ndarray]:
    """For each prefix the md5 of it followed by 0, 1, ... in decimals, as many as its count:
    (4, count) unsigned 32-bit numbers, eight hex digits each."""
    at = 0
    while at < len(prefixes):
        end, total = at + 1, counts[at]
        while end < len(prefixes) and total + counts[end] <= _HASHED:
            total += counts[end]
            end += 1
        block, first = np.zeros((total, 64), dtype=np.uint8), 0
        for prefix, count in zip(prefixes[at:end], counts[at:end], strict=True):
            rows = block[first : first + count]
            first += count
            if len(prefix) + len(str(count)) > 55:
                continue
            rows[:, : len(prefix)] = np.frombuffer(prefix, dtype=np.uint8)
            low, digits = 0, 1
            while low < count:
                part = rows[low : 10**digits]
                number = np.arange(low, low + len(part))
                for k in range(digits):
                    part[:, len(prefix) + k] = 48 + number // 10 ** (digits - 1 - k) % 10
                size = len(prefix) + digits
                part[:, size] = 0x80
                part[:, 56], part[:, 57] = 8 * size % 256, 8 * size // 256
                low, digits = 10**digits, digits + 1
        found, first = _md5_blocks(np.ascontiguousarray(block.view("<u4").T)).byteswap(), 0
        for prefix, count in zip(prefixes[at:end], counts[at:end], strict=True):
            if len(prefix) + len(str(count)) > 55:
                # More than one block.
                raw = b"".join(hashlib.md5(b"%b%d" % (prefix, i)).digest() for i in range(count))
                yield np.frombuffer(raw, dtype=">u4").reshape(count, 4).T.astype(np.uint32)
            else:
                yield found[:, first : first + count]
            first += count
        at = end


def normal_draws(key: Column, width: int, seed: int) -> Column:
    """``width`` standard normal draws that depend on the seed and the key alone."""

    def uniform(i: Column, which: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, i, F.lit(which), F.lit(seed)), 11)
        return (bits.cast("double") + 0.5) / F.lit(float(2**53))

    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.sqrt(F.lit(-2.0) * F.log(uniform(i, 0))) * F.cos(F.lit(2 * math.pi) * uniform(i, 1)),
    )
