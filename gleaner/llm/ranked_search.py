"""Ranked lexical search: every item against every document, through K2-treaps.

1. One pass over the documents keeps, of each, its number of terms and how often it holds
   the terms that any item asks for.
2. N, L and the terms' document counts follow from those rows, and from them the weights.
3. Each task lays its documents out as grids of terms by documents, ``TILE`` documents to
   a grid, documents in the order of their ids and terms in that of their weights, so
   that terms of like impact share quadtree cells. The impacts go into a K2-treap, and
   every item's rows are followed down together, best first. The best found in a task's
   earlier grids already bound the search in the next.
4. A task gives each item's ``k`` best, and a ranking of those is the result.

Items are a stated query set that meets all documents in blocks: a block's terms and
texts, at most ``ITEM_CHARS`` characters (or one longer item), go to every task; more
items make more blocks, each with its own passes.

Odd rows: a null text, of a document or an item, has no terms; a row without doc_id is
ranked after equal scores with one; a repeated document counts and ranks as often as it
is there; items equal in id and text are one; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.k2_treap import K2Treap
from gleaner.llm.session_tools import materialize

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents and cells of a grid at most, about.
TILE = 16_384
CELLS = 4_000_000
#: Characters of the items of a block, and bytes of a text looked at in one go.
ITEM_CHARS = 16_000_000
PART = 1 << 22
NO_ID = np.iinfo(np.int64).max

_HELD = "doc_id long, n long, terms binary, counts binary"


def _parts(data: bytes, size: int) -> Iterator[bytes]:
    """A text in parts that end between terms."""
    at = 0
    while len(data) - at > size:
        inside = TERM.match(data, at + size)
        end = inside.end() if inside else at + size
        yield data[at:end]
        at = end
    yield data[at:]


def term_counts(text: str | None, wanted: dict[bytes, int] | None = None, size: int = PART) -> tuple[int, Counter]:
    """How many terms a text has, and how often those of ``wanted`` (else all)."""
    total, held = 0, Counter()
    for part in _parts((text or "").encode().lower(), size):
        terms = TERM.findall(part)
        total += len(terms)
        held.update(terms if wanted is None else filter(wanted.__contains__, terms))
    return total, held


def held_terms(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms, and the numbers and counts of those in ``wanted``; none without terms."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            ids, ns, terms, counts = [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n, held = term_counts(text.as_py(), number)
                if n:
                    ids.append(i)
                    ns.append(n)
                    terms.append(np.array([number[t] for t in held], dtype="<i4").tobytes())
                    counts.append(np.array(list(held.values()), dtype="<i4").tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _HELD)


def document_counts(held: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of ``terms`` terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<i4")
            total += np.bincount(numbers, minlength=terms)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["term", "count"])

    found = held.select("terms").mapInArrow(run, "term int, count long").groupBy("term").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(terms, dtype=np.int64)
    counts[found.column("term").to_numpy()] = found.column("count").to_numpy()
    return counts


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What terms of these weights and counts add to the score of documents of n terms."""
    m = 100 - 25 + (25 * n * documents) // length
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Grid:
    """The documents of a grid: their terms' rows and impacts in a K2-treap."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, rows: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, length: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        of = np.repeat(np.arange(len(ids)), sizes)
        values = impacts(weights[rows], tf, n[of], documents, length)
        good = values > 0
        self.treap = K2Treap(rows[good], place[of[good]], values[good])

    def best(self, rows: np.ndarray, times: np.ndarray, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """(score, doc_id) of the best documents for an item's rows and how often it has each."""
        return [(s, int(self.ids[c])) for s, c in self.treap.best(rows, times, self.ids, k, floor)]


def _grids(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[list[np.ndarray]]:
    """Rows as (ids, n, sizes, terms, counts), about ``tile`` documents together."""
    held: list[list] = [[], [], [], []]
    cells = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, tile - len(held[0]))
            terms = part.column("terms").to_pylist()
            # As many as fit the cells of a grid, at least one.
            ends = np.cumsum([len(t) // 4 for t in terms])
            fit = max(1, int(np.searchsorted(ends, CELLS - cells, side="right"))) if held[0] or ends[-1] > CELLS else len(terms)
            part, terms = part.slice(0, fit), terms[:fit]
            held[0] += part.column("doc_id").to_pylist()
            held[1] += part.column("n").to_pylist()
            held[2] += terms
            held[3] += part.column("counts").to_pylist()
            cells += int(ends[len(terms) - 1])
            at += len(terms)
            if len(held[0]) >= tile or cells >= CELLS:
                yield _arrays(held)
                held, cells = [[], [], [], []], 0
    if held[0]:
        yield _arrays(held)


def _arrays(held: list[list]) -> list[np.ndarray]:
    ids = np.array([NO_ID if i is None else i for i in held[0]], dtype=np.int64)
    flat = [np.frombuffer(b"".join(x), dtype="<i4").astype(np.int64) for x in held[2:]]
    return [ids, np.array(held[1], dtype=np.int64), np.array([len(t) // 4 for t in held[2]], dtype=np.int64), *flat]


def _block_search(docs: DataFrame, items: list, k: int, tile: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item, by its place in ``items``, of every task."""
    spark = docs.sparkSession
    asked = [term_counts(row["text"])[1] for row in items]
    terms = sorted({t for counts in asked for t in counts})
    number = {t: i for i, t in enumerate(terms)}
    held = materialize(held_terms(docs, number), "held-terms")
    sums = held.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = sums["documents"], sums["length"] or 1
    weights = np.array([weight(documents, int(c)) for c in document_counts(held, len(terms))], dtype=np.int64)
    # Rows by weight, so that cells of a quarter have like impacts.
    by_weight = np.argsort(-weights, kind="stable")
    row = np.empty(len(terms), dtype=np.int64)
    row[by_weight] = np.arange(len(terms))
    wanted = []
    for counts in asked:
        numbers = np.array([number[t] for t in counts], dtype=np.int64)
        wanted.append((row[numbers], np.array(list(counts.values()), dtype=np.int64)))
    shared = spark.sparkContext.broadcast((row, weights[by_weight], wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        row, weights, wanted = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for ids, n, sizes, numbers, tf in _grids(batches, tile):
            grid = Grid(ids, n, sizes, row[numbers], tf, weights, documents, length)
            for i, (rows, times) in enumerate(wanted):
                floor = best[i][-1] if len(best[i]) >= k else None
                found = grid.best(rows, times, k, floor)
                best[i] = sorted(best[i] + found, key=lambda x: (-x[0], x[1]))[:k]
        out = [(i, None if d == NO_ID else d, s) for i, own in enumerate(best) for s, d in own]
        columns = [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return held.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, tile: int = TILE, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with scores above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.char_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-chars // item_chars))
    result = None
    for block in range(blocks):
        # By what it is cut into, one block is item_chars characters, give or take.
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = _block_search(docs, rows, k, tile).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return result


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
scores AS (
  SELECT q.item_id, tf.doc_id,
    CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + ((25 * l.n * c.docs) // c.len))))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN lengths l ON l.doc_id = tf.doc_id, corpus c
  GROUP BY q.item_id, tf.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
