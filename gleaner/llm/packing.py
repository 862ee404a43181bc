"""Best-fit packing of documents into token sequences, certified by lower bounds.

Every document becomes its token ids and an end id. A document longer than the
sequence is cut into full pieces, its first piece taking what is left over; only such
documents are cut. Pieces are then packed:

1. Pieces are dealt by a hash over partitions of bounded size. Each partition packs
   its pieces by best-fit decreasing: a piece goes to the fullest sequence it fits.
2. A dual feasible function maps lengths so that the images of what fits one sequence
   sum to one at most, so the sum over all pieces, rounded up, is a lower bound of the
   number of sequences. A partition whose count meets the largest such bound is
   certified: no packing of its pieces is better.
3. While all partitions together need more sequences than the bound over all pieces, each
   gives up its sequences with the most free room, at least as much as its gap takes. The
   pieces of those are dealt anew over fewer partitions and packed again. A round's result
   is taken only where it needs fewer sequences than were given up; after a round without
   gain the same pieces are dealt otherwise, ``TRIES`` times, or once in a single partition.

Only (length, place) of pieces is shuffled, never ids. Results for odd rows: a null
text is an empty one; an empty text is one piece of the end id alone; a null doc_id is
kept as it is; a repeated row is packed again, on its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import wordcache
from gleaner.llm.session_tools import materialize

CAPACITY = 2048
END_ID = 0
#: Pieces of one partition at most, about; packing them takes some 50 MB.
PART_PIECES = 50_000
#: Rounds without gain after which no more exchanges are tried.
TRIES = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
_ROUND = f"{PACKED}, part long, free long, given boolean"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document, with a checksum of its ids."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for at in range(0, len(texts), 512):
                names = batch["doc_id"].iloc[at : at + 512]
                for name, ids in zip(names, wordcache.byte_level_ids(texts[at : at + 512], tokenizer), strict=True):
                    raw = np.concatenate([ids, end]).tobytes()
                    name = None if pd.isna(name) else int(name)
                    for i, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        rows.append((name, i, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(encode, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: sequence and offset of every length, free room per sequence."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has r tokens free
    free: list[int] = []
    for i in order.tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(free)
            free.append(capacity)
        sequence[i], offset[i] = chosen, capacity - room
        left = room - need
        free[chosen] = left
        if left:
            open_by_room[left].append(chosen)
            rooms |= 1 << left
    return sequence, offset, np.array(free, dtype=np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Largest bound by dual feasible functions; ``counts[x]`` pieces have length ``x``.

    Two families are tried. The rounding functions u_k map x to k*x/capacity rounded
    down where that is not whole, and x*(k+1)/capacity stays exact otherwise; the
    threshold functions count a piece above capacity - t as a whole sequence, keep a
    middle piece at its share and drop those below t.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * x
        image = np.where(scaled % capacity == 0, k * x, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * image).sum()) // (k * capacity)))
    present = np.flatnonzero(counts[: capacity // 2 + 1])
    number, weight = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * x)
    for t in present.tolist():
        if t == 0:
            continue
        above = int(number[capacity - t + 1]) if t else 0
        middle = int(weight[capacity - t] - weight[t - 1])
        best = max(best, above + -(-middle // capacity))
    return best


def _pack_part(capacity: int, stage: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy(dtype=np.int64)
        part = int(frame["part"].iloc[0])
        sequence, offset, free = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # Even a certified partition may leave a sequence half empty that others could fill.
        gap = len(free) - bound + 1
        given = np.zeros(len(free), dtype=bool)
        loosest = np.argsort(-free, kind="stable")
        room = np.cumsum(free[loosest])
        enough = int(np.searchsorted(room, 4 * capacity * gap)) + 1
        given[loosest[:enough]] = free[loosest[:enough]] > 0
        return frame.assign(
            sequence_id=(stage << 56) + (part << 24) + sequence,
            offset=offset,
            free=free[sequence],
            given=given[sequence],
        )[[*(c.split()[0] for c in _ROUND.split(", "))]]

    return pack


def _packed(rows: DataFrame, parts: int, capacity: int, stage: int) -> DataFrame:
    # By place in the written table, so that repeated rows do not meet in one partition.
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(stage))
    dealt = rows.withColumn("part", F.pmod(place, F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(_pack_part(capacity, stage), _ROUND)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    part_pieces: int = PART_PIECES,
) -> DataFrame:
    """Pieces of ``docs`` with the sequence and the place each was given."""
    tokenizer = tokenizer or wordcache.default_tokenizer("byte_bpe_50k.json")
    all_pieces = materialize(pieces(docs, tokenizer, capacity), "pieces")
    names = [c.split()[0] for c in PIECES.split(", ")]
    results = names + ["sequence_id", "offset"]
    whole = all_pieces.filter(F.col("length") == capacity).select(
        *names,
        (F.lit(127 << 56) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = all_pieces.filter(F.col("length") < capacity)
    # At most a row for each length.
    lengths = np.zeros(capacity + 1, dtype=np.int64)
    for row in rest.groupBy("length").count().collect():
        lengths[row["length"]] = row["count"]
    count = int(lengths.sum())
    if not count:
        return whole
    bound = lower_bound(lengths, capacity)
    packed = materialize(_packed(rest, -(-count // part_pieces), capacity, 1), "packed")
    settled, given = [packed.filter("NOT given")], packed.filter("given")
    kept, open_ = _sequences(settled[0]), _sequences(given)
    failed, stage = 0, 2
    while open_ > 1 and kept + open_ > bound and failed < TRIES:
        parts = -(-given.count() // part_pieces)
        again = materialize(_packed(materialize(given.select(*names), "given"), parts, capacity, stage), "packed")
        if _sequences(again) < open_:
            settled.append(again.filter("NOT given"))
            given = again.filter("given")
            kept, open_, failed = kept + _sequences(settled[-1]), _sequences(given), 0
        else:
            failed += TRIES if parts == 1 else 1
        stage += 1
    out = whole
    for part in [*settled, given]:
        out = out.unionByName(part.select(*results))
    return out


def _sequences(packed: DataFrame) -> int:
    return packed.agg(F.count_distinct("sequence_id")).first()[0]
