"""Repetition coverage: how much of a text sits in duplicated word n-grams and lines.

Words are stretches without space, tab, line feed, vertical tab, form feed or carriage
return. For each of several lengths n, a rolling hash of every n words is sorted within
its text; an n-gram found twice or more is duplicated, and the characters of all words
under any of its places count once. Longer lengths look only at places whose shorter
n-grams repeat, since an n-gram cannot repeat without them. The commonest n-gram of
two to four words is measured in the same way, and so are lines equal to an earlier one.

A text passes if it has enough words, repeats few of them, and no measure exceeds its
limit. The work is one pass over the texts without a shuffle; a block of about one MB
is in memory at a time, a longer text being a block of its own.

Odd rows: a null or blank text has no words and fails; a null doc_id is kept; repeated
rows are measured each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gleaner.llm.texthash import Block, Stretches, Words, blocks, encoded, mix

#: Largest share of word characters under the commonest n-gram, by n.
COMMONEST = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of word characters under n-grams found twice or more, by n. The first
#: place counts too, so the limits are higher than those used for later places only.
DUPLICATED = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Largest share of lines that equal an earlier line, and of word characters in them.
DUP_LINES, DUP_LINE_CHARS = 0.40, 0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_STARTS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80

COVERAGE = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"top_{n}_chars double" for n in COMMONEST)
    + ", "
    + ", ".join(f"dup_{n}_chars double" for n in DUPLICATED)
    + ", dup_line_share double, dup_line_chars double, base_failed boolean, kept boolean"
)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: the number of its group, and how many keys the group has."""
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    return group, size[group]


def _covered(at: np.ndarray, width: int, total: int) -> np.ndarray:
    """Flags of the words under windows of ``width`` words beginning at ``at``."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change[:-1]) > 0


def measure(block: Block) -> dict[str, np.ndarray]:
    """Every measure of every text of a block."""
    words: Words = block.words()
    n_texts, n_words = block.count, len(words.start)
    points = np.concatenate(([0], np.cumsum(_STARTS_CODE_POINT[block.bytes])))
    chars = points[words.end] - points[words.start]
    per_text = lambda values: np.bincount(words.text, weights=values, minlength=n_texts)
    word_chars = per_text(chars)
    share = 1 / np.maximum(word_chars, 1)
    out = {
        "n_words": words.per_text,
        "word_chars": word_chars.astype(np.int64),
        "n_symbols": block.counts(_SYMBOLS, block.begin, block.end),
    }

    rolling = Stretches(words.hash)
    in_text = mix(words.text.astype(np.uint64) + np.uint64(1))
    # Places where an n-gram begins and repeats; longer ones are looked for only there.
    alive = np.ones(n_words, dtype=bool)
    for width in range(2, max(DUPLICATED) + 1):
        at = np.flatnonzero(alive[: max(n_words - width + 1, 0)])
        at = at[words.text[at] == words.text[at + width - 1]]
        keys = mix(rolling.hash(at, at + width)) ^ in_text[at]
        group, size = _groups(keys)
        again = at[size > 1]
        if width == 3:
            flags = _covered(again, width, n_words)
            out["n_repeat_words"] = per_text(flags).astype(np.int64)
        if width in COMMONEST:
            # The first n-gram of the largest group of each text; ties to the earlier place.
            order = np.lexsort((at, -size, words.text[at]))
            first = order[np.unique(words.text[at][order], return_index=True)[1]] if len(at) else order
            commonest = np.zeros(len(group) and group.max() + 1, dtype=bool)
            commonest[group[first[size[first] > 1]]] = True
            flags = _covered(at[commonest[group]], width, n_words) if len(at) else np.zeros(n_words, dtype=bool)
            out[f"top_{width}_chars"] = per_text(chars * flags) * share
        if width in DUPLICATED:
            out[f"dup_{width}_chars"] = per_text(chars * _covered(again, width, n_words)) * share
        alive = np.zeros(n_words, dtype=bool)
        alive[again] = True
        # A longer n-gram repeats only if the one inside it that begins a word later does too.
        alive[:-1] &= alive[1:]
        alive[-1:] = False

    ends = np.flatnonzero(block.bytes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    text = np.searchsorted(block.end, ends)
    words_before = np.searchsorted(words.start, starts)
    filled = np.searchsorted(words.start, ends) > words_before
    starts, ends, text = starts[filled], ends[filled], text[filled]
    keys = mix(words.stretches.hash(starts, ends) + (ends - starts).astype(np.uint64)) ^ mix(text.astype(np.uint64) + np.uint64(1))
    earlier = np.ones(len(keys), dtype=bool)
    earlier[np.unique(keys, return_index=True)[1]] = False
    char_sums = np.concatenate(([0], np.cumsum(chars)))
    line_chars = char_sums[np.searchsorted(words.start, ends)] - char_sums[np.searchsorted(words.start, starts)]
    per_line = lambda values: np.bincount(text, weights=values, minlength=n_texts)
    out["n_dup_lines"] = per_line(earlier).astype(np.int64)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(per_line(np.ones(len(keys))), 1)
    out["dup_line_chars"] = per_line(line_chars * earlier) * share

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    failed = out["base_failed"] | (out["dup_line_share"] > DUP_LINES) | (out["dup_line_chars"] > DUP_LINE_CHARS)
    for name, limits in (("top", COMMONEST), ("dup", DUPLICATED)):
        for width, limit in limits.items():
            failed = failed | (out[f"{name}_{width}_chars"] > limit)
    out["kept"] = ~failed
    return out


def coverage(docs: DataFrame) -> DataFrame:
    """All measures and the verdict for every document."""
    names = [c.split()[0] for c in COVERAGE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = encoded(batch["text"])
            for part, block in blocks(texts):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].array, **measure(block)})[names].astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, COVERAGE)
