"""Whole-text BPE encoding and decoding, long texts by tree concatenation.

A text longer than ``LEAF`` characters is halved until no part is longer, the parts are
encoded in parallel tasks, and neighbours are joined pairwise up a tree. Only the
stretch without white space at a join can come out differently; it is settled by
encoding a window around the join that doubles until it agrees with both sides: two
successive tokens of the left side, and two of the right, come out of the window at
the same places. BPE output is right exactly if every two adjacent tokens are what
their own text encodes to, and each adjacent pair of the joined result stands in one of
the three encodings, so agreement proves the result; a window that reaches both ends is
the encoding itself. Stretches that may hold a special token are encoded again whole.

Inside a text, words between plain white space are encoded one by one with a cache,
which the tokenizer's own cutting at white space allows.

Odd rows: a null text is an empty one, of no ids; a null doc_id is kept; a repeated row
is encoded by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import wordcache
from gleaner.llm.session_tools import shuffle_width

LEAF = 32_768
WINDOW = 64
PLAIN_SPACE = " \t\n\r"

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_PART = "row long, doc_id long, leaf int, part binary"


@dataclass
class Run:
    """A stretch without plain white space: its text, ids and each token's place in it."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def encode_run(tokenizer, text: str) -> Run:
    found = tokenizer.encode(text, add_special_tokens=False)
    places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
    return Run(text, np.array(found.ids, dtype="<u4"), places[:, 0], places[:, 1])


def _agreeing(one: Run, other: Run, shift: int) -> list[tuple[int, int]]:
    """(i, j) where tokens i-1, i of ``one`` are tokens j-1, j of ``other``, whose places are ``shift`` later."""
    mine = {(int(s), int(e), int(t)): i for i, (s, e, t) in enumerate(zip(one.start, one.end, one.ids, strict=True))}
    found = []
    before = None
    for j, (s, e, t) in enumerate(zip(other.start, other.end, other.ids, strict=True)):
        i = mine.get((int(s) + shift, int(e) + shift, int(t)))
        clean = j > 0 and other.start[j] == other.end[j - 1]
        if i is not None and before is not None and before == i - 1 and clean and one.start[i] == one.end[i - 1]:
            found.append((i, j))
        before = i
    return found


def join_runs(tokenizer, left: Run, right: Run, window: int = WINDOW) -> Run:
    """The run of both texts together, encoded only around the join where that settles it."""
    text, n = left.text + right.text, len(left.text)
    if "<|" not in text:
        while window < max(n, len(right.text)):
            at = max(n - window, 0)
            middle = encode_run(tokenizer, text[at : n + window])
            lefts = [(i, j) for i, j in _agreeing(left, middle, at) if j >= 2]
            rights = [(i, j) for i, j in _agreeing(right, middle, at - n) if j <= len(middle.ids) - 2]
            if lefts and rights and lefts[0][1] < rights[-1][1]:
                (a, b), (d, c) = lefts[0], rights[-1]
                join = lambda x, y, z: np.concatenate([x[:a], y[b:c], z[d:]])  # noqa: B023, E731
                return Run(
                    text,
                    join(left.ids, middle.ids, right.ids),
                    join(left.start, middle.start + at, right.start + n),
                    join(left.end, middle.end + at, right.end + n),
                )
            window *= 2
    return encode_run(tokenizer, text)


@dataclass
class Part:
    """An encoded part of a text. ``head`` and ``tail`` are the stretches at its ends that
    may go on in the neighbours, ``ids`` and ``tokens`` what lies between. A part without
    any white space has its whole stretch in ``head`` and is ``solid``."""

    head: Run | None
    ids: list[bytes]
    tokens: list[str]
    tail: Run | None
    solid: bool = False


def encode_part(path: str, text: str) -> Part:
    tokenizer, cache = wordcache.load(path), wordcache.cache(path, True)
    if not text:
        return Part(None, [], [], None, True)
    words = wordcache.PLAIN_WORD.findall(text)
    if not words:
        return Part(None, [], [], None)
    if len(words) == 1 and len(words[0]) == len(text):
        return Part(encode_run(tokenizer, text), [], [], None, True)
    head = tail = None
    if text[0] not in PLAIN_SPACE:
        head = encode_run(tokenizer, words.pop(0))
    if words and text[-1] not in PLAIN_SPACE:
        tail = encode_run(tokenizer, words.pop())
    found = cache.encode(words)
    return Part(head, [x[0] for x in found], [x[1] for x in found if x[1]], tail)


def _packed(part: Part) -> bytes:
    plain = lambda run: run and (run.text, run.ids, run.start, run.end)
    return pickle.dumps((plain(part.head), part.ids, part.tokens, plain(part.tail), part.solid))


def _unpacked(data: bytes) -> Part:
    head, ids, tokens, tail, solid = pickle.loads(data)
    return Part(head and Run(*head), ids, tokens, tail and Run(*tail), solid)


def _settled(tokenizer, run: Run | None) -> tuple[list[bytes], list[str]]:
    if run is None or not len(run.ids):
        return [], []
    return [run.ids.tobytes()], [tokenizer.decode(run.ids.tolist(), skip_special_tokens=False)]


def join_parts(tokenizer, left: Part, right: Part) -> Part:
    def joined(a: Run | None, b: Run | None) -> Run | None:
        return join_runs(tokenizer, a, b) if a is not None and b is not None else a if b is None else b

    if left.solid and right.solid:
        return Part(joined(left.head, right.head), [], [], None, True)
    if left.solid:
        return Part(joined(left.head, right.head), right.ids, right.tokens, right.tail)
    if right.solid:
        return Part(left.head, left.ids, left.tokens, joined(left.tail, right.head))
    ids, tokens = _settled(tokenizer, joined(left.tail, right.head))
    return Part(left.head, left.ids + ids + right.ids, left.tokens + tokens + right.tokens, right.tail)


def finish(tokenizer, part: Part) -> tuple[bytes, str]:
    """Ids and decoded text of a whole text."""
    first, last = _settled(tokenizer, part.head), _settled(tokenizer, part.tail)
    return b"".join(first[0] + part.ids + last[0]), " ".join(first[1] + part.tokens + last[1])


def _digest(ids: bytes, decoded: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_whole(path: str, texts: list[str]) -> list[tuple[bytes, str]]:
    """Ids and decoded text of texts that are one part each."""
    tokenizer, cache = wordcache.load(path), wordcache.cache(path, True)
    words, spans = [], []
    for text in texts:
        at = len(words)
        words.extend([text] if "<|" in text else wordcache.WORD_UNIT.findall(text))
        spans.append((at, len(words)))
    found = cache.encode(words)
    return [(b"".join([x[0] for x in found[a:b]]), " ".join([x[1] for x in found[a:b] if x[1]])) for a, b in spans]


def encode(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    path = tokenizer or wordcache.default_tokenizer("word_bpe_49k.json")
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for at in range(0, len(texts), 512):
                rows += [_digest(*x) for x in encode_whole(path, texts[at : at + 512])]
            frame = pd.DataFrame(rows, columns=names[1:])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame.astype({"doc_id": "Int64"})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                part = _packed(encode_part(path, row["text"].iloc[0]))
                yield row.drop(columns="text").assign(part=[part]).astype({"doc_id": "Int64"})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        tokenizer = wordcache.load(path)
        level = [_unpacked(p) for p in frame.sort_values("leaf")["part"]]
        while len(level) > 1:
            level = [join_parts(tokenizer, *pair) for pair in zip(level[::2], level[1::2], strict=True)]
        row = pd.DataFrame([_digest(*finish(tokenizer, level[0]))], columns=names[1:])
        row.insert(0, "doc_id", frame["doc_id"].iloc[:1].array)
        return row.astype({"doc_id": "Int64"})

    texts = docs.select("doc_id", "text")
    length = F.coalesce(F.char_length("text"), F.lit(0))
    small = texts.filter(length <= leaf).mapInPandas(short, ENCODED)
    # 2**k parts of a text, so that every part has a neighbour at each level.
    count = F.pow(F.lit(2), F.ceil(F.log2(F.col("length") / leaf))).cast("int")
    bound = lambda i: F.floor(F.col("length") * i / F.col("count")).cast("int")
    leaves = (
        texts.filter(length > leaf)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("length", length.cast("long"))
        .withColumn("count", count)
        .withColumn("leaf", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        .select(
            "row",
            "doc_id",
            "leaf",
            F.substring("text", bound(F.col("leaf")) + 1, bound(F.col("leaf") + 1) - bound(F.col("leaf"))).alias("text"),
        )
        .repartition(shuffle_width(docs.sparkSession), "row", "leaf")
    )
    long = leaves.mapInPandas(parts, _PART).groupBy("row").applyInPandas(joined, ENCODED)
    return small.unionByName(long)
