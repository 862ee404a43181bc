"""Exact removal of repeated 100-byte strings by range-partitioned suffix sorting.

A byte goes if it lies in a 100-byte string that also begins earlier: in a document of
smaller id, or earlier in the same one. Sorting every suffix would move each text a
hundred times, so the first of two sorts works on *anchors*: each 100-byte string
chooses the ``SEED``-byte string inside it of least hash, so equal strings choose equal
anchors. Successive strings with one anchor are a run, some 30 strings.

1. *Runs.* A run is known by its anchor (three bytes and 40 bits of its hash) and the hash
   of all bytes its strings cover. Splitters sampled from some documents' runs deal the
   runs over buckets. Of equal runs all but the first are repeated whole. The first of them
   can only hold strings that repeat elsewhere if another run has the same anchor; such
   runs, and those at a bucket's ends, are open.
2. *Suffixes.* The text of each open run is cut out once. Every string of it stands for the
   suffix that begins at its anchor, with what precedes the anchor after that: a sorting key
   of anchor, the anchor's place in the string, the string, document and place. Splitters
   sampled from these keys range-partition the suffixes by leading tokens; as a key holds
   document and place, a splitter can fall between equal strings too. A bucket is sorted by
   multikey quicksort, eight bytes of text a turn, each turn only where rows are still tied.
   A string equal to its predecessor is repeated, and the first one of a bucket is compared
   with the last one of the bucket before.
3. Repeated strings are gathered per document and their bytes cut out.

A task keeps only the first of equal runs it produces and sends the rest, already known as
repeated, to any bucket in turn, so a passage found in a third of all documents reaches its
own bucket once per task. Rows travel as packed arrays. Hashes decide equality of runs with
more than 100 bits; strings are compared by their text.

The driver holds some 20 keys of 161 bytes for each million open strings, and tasks one of
them: 3 kB a GB of text on tables where one string in 25 is open.

Odd rows: a null text is an empty one; texts under 100 bytes lose nothing; a missing id
counts as larger than all others; rows with one id are ordered by a hash of their text,
and equal rows are one document, each returned with the same result; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.session_tools import materialize
from gleaner.llm.texthash import BYTE_TABLE, Stretches, mix

SPAN = 100
SEED = 40
#: Bytes of text per bucket, about: a bucket holds some half million runs.
BUCKET_BYTES = 16 << 20
#: Runs sampled for splitters, at least, for each bucket, and most taken from one document.
SAMPLE, SAMPLE_PER_BUCKET, SAMPLE_PER_TEXT = 40_000, 200, 200
#: Strings per bucket of suffixes, about, and keys sampled for each bucket.
BUCKET_STRINGS, KEYS_PER_BUCKET = 1_000_000, 20
#: Bytes handled at once; places in a piece fit 20 bits.
PIECE = 1 << 19

LAST_ID = 2**63 - 1
_LOW20 = np.uint64((1 << 20) - 1)
_DOC = np.dtype([("id", "<i8"), ("text", "<i8")])

PACKET = "bucket int, kind int, packet binary"
#: Entries of one document: (place, shape) pairs of 32-bit numbers.
FLAGGED = "id long, text_key long, kind int, entries binary"
WHOLE, OPEN = 0, 1
CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def multikey_order(n: int, words: list[Callable[[np.ndarray], np.ndarray]], equal: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of n rows by several words, and which rows equal the one before in the first ``equal``.

    Multikey quicksort: rows are sorted by one word, and each run of ties by the next word;
    a word is asked for only where rows are still tied.
    """
    order = np.arange(n)
    again = np.zeros(n, dtype=bool)
    part, run = np.arange(n), np.zeros(n, dtype=np.int64)
    for depth, word in enumerate(words, 1):
        key = word(order[part])
        sorted_to = np.lexsort((key, run))
        order[part] = order[part][sorted_to]
        key = key[sorted_to]
        same = (run[1:] == run[:-1]) & (key[1:] == key[:-1])
        if depth == equal:
            again[part[1:][same]] = True
        tied = np.zeros(len(part), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        if not tied.any():
            break
        run = np.cumsum(np.concatenate(([True], ~same)))[tied]
        part = part[tied]
    return order, again


def _same_place(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Which ordered rows are those before once more: the same place of a repeated row."""
    out = np.zeros(len(order), dtype=bool)
    out[1:] = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    return out


def _columns(*arrays: np.ndarray) -> list[Callable[[np.ndarray], np.ndarray]]:
    return [a.__getitem__ for a in arrays]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` successive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])
    return out


class Piece:
    """Whole texts, or a part of one text, laid end to end; strings do not cross texts."""

    def __init__(self, data: bytes, begin: np.ndarray, length: np.ndarray, shift: int):
        self.bytes = np.frombuffer(data, dtype=np.uint8)
        self.begin, self.length, self.shift = begin, length, shift
        self.hashes = Stretches(BYTE_TABLE[self.bytes])

    def runs(self) -> tuple[np.ndarray, ...]:
        """(text number, place, shape, leading token, hash) of every run.

        The shape is the number of strings and, above eight bits, the anchor's distance.
        """
        n = len(self.bytes)
        none = np.zeros(0, dtype=np.int64)
        if n < SPAN:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        seeds = mix(self.hashes.rolling(SEED))
        ranked = (seeds & ~_LOW20) | np.arange(len(seeds), dtype=np.uint64)
        anchor = (_sliding_min(ranked, SPAN - SEED + 1) & _LOW20).astype(np.int64)
        strings = len(anchor)
        text = np.repeat(np.arange(len(self.begin)), self.length)[:strings]
        end = (self.begin + self.length)[text]
        valid = np.arange(strings) + SPAN <= end
        change = np.ones(strings, dtype=bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
        start = np.flatnonzero(change & valid)
        if not len(start):
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        last = np.concatenate((start[1:], [strings]))
        # A run ends where the next begins or where strings stop fitting the text.
        count = np.minimum(last, end[start] - SPAN + 1) - start
        at = anchor[start]
        lead = self.bytes.astype(np.uint64)
        token = (lead[at] << np.uint64(56)) | (lead[at + 1] << np.uint64(48)) | (lead[at + 2] << np.uint64(40))
        token |= seeds[at] >> np.uint64(24)
        body = self.hashes.hash(start, start + count + SPAN - 1)
        body = mix(body + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        body = mix(body + (at - start).astype(np.uint64))
        return text[start], start - self.begin[text[start]] + self.shift, count | ((at - start) << 8), token, body


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, Piece]]:
    """(number of the first text, piece) over all texts; a long text gives several that overlap."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > PIECE:
            for at in range(0, len(texts[i]) - SPAN + 1, PIECE):
                part = texts[i][at : at + PIECE + SPAN - 1]
                yield i, Piece(part, np.array([0]), np.array([len(part)]), at)
            i += 1
            continue
        first, size = i, 0
        while i < len(texts) and size + len(texts[i]) <= PIECE:
            size += len(texts[i])
            i += 1
        length = np.array([len(t) for t in texts[first:i]], dtype=np.int64)
        yield first, Piece(b"".join(texts[first:i]), np.cumsum(length) - length, length, 0)


def _text_bytes(column) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in column]


def _pack(docs: np.ndarray, doc: np.ndarray, place: np.ndarray, shape: np.ndarray, *keys: np.ndarray) -> bytes:
    """Rows as column after column, with a table of the documents they are in."""
    used, number = np.unique(doc, return_inverse=True)
    head = np.array([len(used), len(doc)], dtype="<i8")
    columns = [number.astype("<u4"), place.astype("<u4"), shape.astype("<u2"), *keys]
    return b"".join(x.tobytes() for x in (head, docs[used], *columns))


def _unpack(packets: list[bytes], n_keys: int) -> tuple[np.ndarray, ...]:
    """(id, text key, place, shape, keys..., bytes after the rows) of the rows of all packets."""
    found, rest = [], []
    for data in packets:
        n_docs, n = np.frombuffer(data, dtype="<i8", count=2)
        at = 16
        docs = np.frombuffer(data, dtype=_DOC, count=n_docs, offset=at)
        at += n_docs * 16
        columns = []
        for kind in ("<u4", "<u4", "<u2", *["<u8"] * n_keys):
            columns.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
        own = docs[columns[0]]
        found.append((own["id"], own["text"], *(c.astype(np.int64) for c in columns[1:3]), *columns[3:]))
        rest.append(np.frombuffer(data, dtype=np.uint8, offset=at))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4 + n_keys)) + (np.zeros(0, dtype=np.uint8),)
    return *(np.concatenate(x) for x in zip(*found, strict=True)), np.concatenate(rest)


def _send(splitters: np.ndarray, docs: np.ndarray, rows: list[tuple]) -> pd.DataFrame:
    """Runs (doc, place, shape, token, body) of a task as packets to the buckets of their tokens."""
    doc, place, shape, token, body = (np.concatenate(x) for x in zip(*rows, strict=True))
    ids, texts = docs["id"][doc], docs["text"][doc]
    order, again = multikey_order(len(doc), _columns(token, body, ids, texts, place), 2)
    bucket = np.searchsorted(splitters, token, side="right")
    out = []
    chosen = order[~again]
    edges = np.flatnonzero(np.diff(bucket[chosen], prepend=-1)) if len(chosen) else []
    for a, b in zip(edges, [*edges[1:], len(chosen)]):
        part = chosen[a:b]
        out.append((int(bucket[part[0]]), OPEN, _pack(docs, doc[part], place[part], shape[part], token[part], body[part])))
    # What is known as repeated needs no bucket of its own.
    known = order[again & ~_same_place(order, ids, texts, place)]
    for i, part in enumerate(np.array_split(known, -(-len(known) // KNOWN_ROWS)) if len(known) else []):
        turn = (int(docs["text"][0]) + i) % (len(splitters) + 1)
        out.append((turn, WHOLE, _pack(docs, doc[part], place[part], shape[part])))
    return pd.DataFrame(out, columns=["bucket", "kind", "packet"])


def _flagged(ids: np.ndarray, texts: np.ndarray, place: np.ndarray, shape: np.ndarray, kind: int) -> pd.DataFrame:
    """One row per document, its entries packed."""
    if not len(ids):
        none = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"id": none, "text_key": none, "kind": none, "entries": none.astype(object)})
    order = np.lexsort((place, texts, ids))
    ids, texts = ids[order], texts[order]
    entries = np.stack([place[order], shape[order]], axis=1).astype("<u4")
    edges = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]))))
    packed = [entries[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(ids)], strict=True)]
    return pd.DataFrame({"id": ids[edges], "text_key": texts[edges], "kind": kind, "entries": packed})


#: Runs a task gathers before it sends packets, and most in a packet of known ones and of open ones.
SENT_ROWS, KNOWN_ROWS, OPEN_ROWS = 2_000_000, 50_000, 20_000


class _Gathered:
    """Rows of a task on their way to the buckets."""

    def __init__(self, splitters: np.ndarray):
        self.splitters, self.docs, self.rows, self.count = splitters, [], [], 0

    def document(self, doc_id: int, text_key: int) -> int:
        self.docs.append((doc_id, text_key))
        return len(self.docs) - 1

    def add(self, *row: np.ndarray) -> None:
        self.rows.append(row)
        self.count += len(row[0])

    def packets(self, least: int) -> Iterator[pd.DataFrame]:
        if self.count > least:
            yield _send(self.splitters, np.array(self.docs, dtype=_DOC), self.rows)
            self.docs, self.rows, self.count = [], [], 0


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key they are known by."""
    return docs.select(
        *docs.columns,
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("text_key"),
    )


def _splitters(docs: DataFrame) -> np.ndarray:
    """Leading tokens that cut the sorted runs into buckets of like size, from sampled runs."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("texts")).first()
    buckets = -(-(size["bytes"] or 0) // BUCKET_BYTES)
    if buckets < 2:
        return np.zeros(0, dtype=np.uint64)
    share = min(1.0, max(SAMPLE, SAMPLE_PER_BUCKET * buckets) / 50 / size["texts"])

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in _text_bytes(batch["text"]):
                tokens = [piece.runs()[3] for _, piece in _pieces([text])]
                tokens = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
                step = -(-len(tokens) // SAMPLE_PER_TEXT) or 1
                yield pd.DataFrame({"token": tokens[::step].view(np.int64)})

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(10**12)) < int(share * 10**12) + 1)
    tokens = np.array([r[0] for r in chosen.select("text").mapInPandas(sample, "token long").collect()], dtype=np.int64)
    if not len(tokens):
        return np.zeros(0, dtype=np.uint64)
    tokens = np.sort(tokens.view(np.uint64))
    return np.unique(tokens[(np.arange(1, buckets) * len(tokens)) // buckets])


def _run_packets(splitters: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Gathered(splitters)
        for batch in batches:
            texts = _text_bytes(batch["text"])
            numbers = [out.document(int(a), int(b)) for a, b in zip(batch["id"], batch["text_key"], strict=True)]
            numbers = np.array(numbers, dtype=np.int64)
            for first, piece in _pieces(texts):
                text, place, shape, token, body = piece.runs()
                out.add(numbers[text + first], place, shape, token, body)
            yield from out.packets(SENT_ROWS)
        yield from out.packets(0)

    return run


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(bucket, packets to sort, packets already known) of every bucket of a task."""
    found: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for batch in batches:
        for bucket, kind, packet in batch.itertuples(index=False):
            known, fresh = found.setdefault(int(bucket), ([], []))
            (fresh if kind == OPEN else known).append(packet)
    for bucket in sorted(found):
        known, fresh = found.pop(bucket)
        yield bucket, fresh, known


def _sort_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs repeated whole, and open runs, of each bucket."""
    for _, fresh, repeated in _by_bucket(batches):
        yield _flagged(*_unpack(repeated, 0)[:4], WHOLE)
        ids, texts, place, shape, token, body, _ = _unpack(fresh, 2)
        if not len(ids):
            continue
        order, again = multikey_order(len(ids), _columns(token, body, ids, texts, place), 2)
        known = order[again & ~_same_place(order, ids, texts, place)]
        yield _flagged(*(x[known] for x in (ids, texts, place, shape)), WHOLE)
        firsts = np.flatnonzero(~again)
        t = token[order[firsts]]
        shared = t[1:] == t[:-1]
        is_open = np.zeros(len(firsts), dtype=bool)
        is_open[1:] |= shared
        is_open[:-1] |= shared
        is_open[[0, -1]] = True
        chosen = order[firsts[is_open]]
        yield _flagged(*(x[chosen] for x in (ids, texts, place, shape)), OPEN)


class Strings:
    """All strings of some open runs, whose texts lie end to end."""

    def __init__(self, ids: np.ndarray, texts: np.ndarray, place: np.ndarray, shape: np.ndarray, data: np.ndarray):
        self.ids, self.texts, self.place = ids, texts, place
        self.count, self.ahead, self.data = shape & 255, shape >> 8, data
        size = self.count + SPAN - 1
        self.begin = np.cumsum(size) - size
        first = np.cumsum(self.count) - self.count
        self.run = np.repeat(np.arange(len(ids)), self.count)
        self.nth = np.arange(len(self.run)) - first[self.run]

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes of text as a number."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, 8)[at]).view(">u8").ravel().astype(np.uint64)

    def words(self) -> list[Callable[[np.ndarray], np.ndarray]]:
        """What strings are ordered by: anchor, its place, the string, document and place."""

        def start(rows: np.ndarray) -> np.ndarray:
            return self.begin[self.run[rows]] + self.nth[rows]

        def anchor(skip: int) -> Callable[[np.ndarray], np.ndarray]:
            return lambda rows: self.word(self.begin[self.run[rows]] + self.ahead[self.run[rows]] + skip)

        def text(skip: int) -> Callable[[np.ndarray], np.ndarray]:
            return lambda rows: self.word(start(rows) + skip)

        return [
            *[anchor(k) for k in range(0, SEED, 8)],
            lambda rows: self.ahead[self.run[rows]] - self.nth[rows],
            *[text(min(k, SPAN - 8)) for k in range(0, SPAN, 8)],
            lambda rows: self.ids[self.run[rows]],
            lambda rows: self.texts[self.run[rows]],
            lambda rows: self.place[self.run[rows]] + self.nth[rows],
        ]

    def keys(self, run: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The same order as bytes."""
        windows = np.lib.stride_tricks.sliding_window_view
        out = np.empty((len(run), KEY), dtype=np.uint8)
        out[:, :SEED] = windows(self.data, SEED)[self.begin[run] + self.ahead[run]]
        out[:, SEED] = self.ahead[run] - nth
        out[:, SEED + 1 : TEXT_KEY] = windows(self.data, SPAN)[self.begin[run] + nth]
        signed = np.stack([self.ids[run], self.texts[run]], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, TEXT_KEY : TEXT_KEY + 16] = signed.astype(">u8").view(np.uint8).reshape(len(run), 16)
        out[:, TEXT_KEY + 16 :] = (self.place[run] + nth).astype(">u4").view(np.uint8).reshape(len(run), 4)
        return out.view(f"S{KEY}").ravel()


#: Bytes of a key up to the end of the string, and whole.
TEXT_KEY, KEY = SEED + 1 + SPAN, SEED + 1 + SPAN + 20

STRETCHES = "strings long, packet binary"


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open runs with their texts, some thousand a packet."""
    docs, rows, parts, n = [], [], [], 0

    def packet() -> pd.DataFrame:
        number, place, shape = (np.concatenate(x) for x in zip(*rows, strict=True))
        data = _pack(np.array(docs, dtype=_DOC), number, place, shape) + b"".join(parts)
        return pd.DataFrame({"strings": [int((shape & 255).sum())], "packet": [data]})

    for batch in batches:
        for doc_id, text_key, text, lists in batch[["id", "text_key", "text", "open"]].itertuples(index=False):
            entries = np.frombuffer(b"".join(lists), dtype="<u4").reshape(-1, 2).astype(np.int64)
            data = text.encode()
            for a in range(0, len(entries), OPEN_ROWS):
                own = entries[a : a + OPEN_ROWS]
                docs.append((int(doc_id), int(text_key)))
                rows.append((np.full(len(own), len(docs) - 1), own[:, 0], own[:, 1]))
                parts.extend(data[p : p + (e & 255) + SPAN - 1] for p, e in own.tolist())
                n += len(own)
                if n >= OPEN_ROWS:
                    yield packet()
                    docs, rows, parts, n = [], [], [], 0
    if n:
        yield packet()


def _key_splitters(stretches: DataFrame) -> np.ndarray:
    """Keys that cut the sorted strings into buckets of like size, every so many strings sampled."""
    total = stretches.agg(F.sum("strings")).first()[0] or 0
    buckets = -(-total // BUCKET_STRINGS)
    if buckets < 2:
        return np.zeros(0, dtype=f"S{KEY}")
    step = max(1, total // (buckets * KEYS_PER_BUCKET))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packet in batch["packet"]:
                strings = Strings(*_unpack([packet], 0))
                # Another start in each packet, so that small ones are not left out.
                chosen = np.arange(zlib.crc32(packet) % step, len(strings.run), step)
                if len(chosen):
                    keys = strings.keys(strings.run[chosen], strings.nth[chosen]).tobytes()
                    yield pd.DataFrame({"keys": [keys]})

    found = stretches.select("packet").mapInPandas(sample, "keys binary").collect()
    keys = np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in found), dtype=f"S{KEY}"))
    if not len(keys):
        return keys
    return np.unique(keys[(np.arange(1, buckets) * len(keys)) // buckets])


def _route(splitters: np.ndarray):
    """Open runs to the buckets of their strings; a run over several buckets is cut."""

    def cut(s: Strings) -> tuple[np.ndarray, ...]:
        """(bucket, run, first string, number of strings) of parts of runs."""
        runs = np.arange(len(s.ids))
        low = np.searchsorted(splitters, s.keys(runs, s.count - 1), side="right")
        high = np.searchsorted(splitters, s.keys(runs, 0 * runs), side="right")
        wide = (low != high)[s.run]
        run, nth = s.run[wide], s.nth[wide]
        bucket = np.searchsorted(splitters, s.keys(run, nth), side="right")
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])
        edges = np.flatnonzero(new)
        size = np.diff(np.append(edges, len(run)))
        whole = runs[low == high]
        return (
            np.concatenate([low[whole], bucket[edges]]),
            np.concatenate([whole, run[edges]]),
            np.concatenate([0 * whole, nth[edges]]),
            np.concatenate([s.count[whole], size]),
        )

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packet in batch["packet"]:
                s = Strings(*_unpack([packet], 0))
                docs, number = np.unique(np.array(list(zip(s.ids, s.texts)), dtype=_DOC), return_inverse=True)
                bucket, run, nth, size = cut(s)
                order = np.argsort(bucket, kind="stable")
                bucket, run, nth, size = (x[order] for x in (bucket, run, nth, size))
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                data, out = s.data.tobytes(), []
                for a, b in zip(edges, [*edges[1:], len(bucket)]):
                    r, j, n = run[a:b], nth[a:b], size[a:b]
                    at = s.begin[r] + j
                    text = b"".join(data[x : x + m + SPAN - 1] for x, m in zip(at.tolist(), n.tolist()))
                    rows = _pack(docs, number[r], s.place[r] + j, n | ((s.ahead[r] - j) << 8))
                    out.append((int(bucket[a]), OPEN, rows + text))
                yield pd.DataFrame(out, columns=["bucket", "kind", "packet"])

    return route


#: The ends of a sorted bucket, for the comparison across boundaries.
SORTED = f"{FLAGGED}, bucket int, first_key binary, last_key binary"


def _sort_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings equal to their predecessor, one row a run, and each bucket's first string with its ends."""
    names = [c.split()[0] for c in SORTED.split(", ")]
    for bucket, fresh, _ in _by_bucket(batches):
        s = Strings(*_unpack(fresh, 0))
        words = s.words()
        order, again = multikey_order(len(s.run), words, len(words) - 3)
        found = np.sort(order[again])
        # Repeated strings of a run that follow one another are one entry.
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1] + 1) | (s.run[found[1:]] != s.run[found[:-1]])
        edges = np.flatnonzero(new)
        size = np.diff(np.append(edges, len(found)))
        run, nth = s.run[found[edges]], s.nth[found[edges]]
        entries = np.stack([s.place[run] + nth, size], axis=1).astype("<u4")
        cuts = np.flatnonzero(np.diff(run, prepend=-1))
        rows = [
            (int(s.ids[run[a]]), int(s.texts[run[a]]), WHOLE, entries[a:b].tobytes(), None, None, None)
            for a, b in zip(cuts, [*cuts[1:], len(run)])
        ]
        ends = order[[0, -1]]
        run, nth = s.run[ends], s.nth[ends]
        keys = s.keys(run, nth)
        first, last = (keys[i : i + 1].tobytes()[:TEXT_KEY] for i in (0, 1))
        entry = np.array([s.place[run[0]] + nth[0], 1], dtype="<u4").tobytes()
        rows.append((int(s.ids[run[0]]), int(s.texts[run[0]]), OPEN, entry, int(bucket), first, last))
        yield pd.DataFrame(rows, columns=names).astype({"bucket": "Int64"})


def _dealt(packets: DataFrame, splitters: np.ndarray) -> DataFrame:
    return packets.repartitionById(len(splitters) + 1, "bucket")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, lists in batch[["text", "entries"]].itertuples(index=False):
            data = np.frombuffer(text.encode() if isinstance(text, str) else b"", dtype=np.uint8)
            entries = b"".join(lists if lists is not None else [])
            entries = np.frombuffer(entries, dtype="<u4").reshape(-1, 2).astype(np.int64)
            change = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(change, entries[:, 0], 1)
            np.add.at(change, entries[:, 0] + (entries[:, 1] & 255) + SPAN - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            kept = data[~gone].tobytes()
            rows.append((kept.decode(errors="ignore"), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        found = pd.DataFrame(rows, columns=["text", *(c.split()[0] for c in CUT.split(", "))], index=batch.index)
        yield pd.concat([batch.drop(columns=["text", "entries"]), found], axis=1)


def deduplicate(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns ``carried``, the kept text, size, bytes and spans
    removed, and the digest of the kept bytes.

    The kept text leaves out bytes of a character that was cut in two; the digest counts them.
    """
    # Carried columns go by numbers, as their names may be those used here.
    numbered = [f"_carried{i}" for i in range(len(carried))]
    docs = _keyed(docs.select("doc_id", *[F.col(f"`{c}`").alias(n) for c, n in zip(carried, numbered)], "text"))
    splitters = _splitters(docs)
    packets = docs.select("id", "text_key", "text").mapInPandas(_run_packets(splitters), PACKET)
    runs = materialize(_dealt(packets, splitters).mapInPandas(_sort_runs, FLAGGED), "runs")
    still = _lists(runs.filter(F.col("kind") == OPEN)).withColumnRenamed("entries", "open")
    # A shuffle of the texts at any size: the list of documents grows with the table.
    texts = docs.select("id", "text_key", "text").join(still.hint("merge"), ["id", "text_key"])
    texts = texts.dropDuplicates(["id", "text_key"])
    stretches = materialize(texts.select("id", "text_key", "text", "open").mapInPandas(_cut_out, STRETCHES), "stretches")
    splitters = _key_splitters(stretches)
    packets = stretches.select("packet").mapInPandas(_route(splitters), PACKET)
    strings = materialize(_dealt(packets, splitters).mapInPandas(_sort_strings, SORTED), "strings")

    # One row per bucket: is its first string the last one of the bucket before? No bucket
    # between two others is empty, as each begins with a splitter's own string.
    ends = strings.filter(F.col("bucket").isNotNull())
    before = ends.select((F.col("bucket") + 1).alias("bucket"), F.col("last_key").alias("first_key"))
    across = ends.join(before, ["bucket", "first_key"])
    names = ["id", "text_key", "entries"]
    repeated = runs.filter(F.col("kind") == WHOLE).select(names)
    repeated = repeated.union(strings.filter(F.col("kind") == WHOLE).select(names)).union(across.select(names))
    cut = docs.join(_lists(repeated).hint("merge"), ["id", "text_key"], "left").select("doc_id", *numbered, "text", "entries")
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("doc_id", *numbered, "text")), CUT])
    return cut.mapInPandas(_cut, schema).withColumnsRenamed(dict(zip(numbered, carried)))


def _lists(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("id", "text_key").agg(F.collect_list("entries").alias("entries"))
