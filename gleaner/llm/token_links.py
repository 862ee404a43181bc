"""Alignment of two tokenizers over a corpus, every distinct text aligned once.

Documents are shuffled by their full text and counted, so that copies meet; each
distinct text is then tokenised by both tokenizers and cut into groups at the byte
offsets where tokens of both end. The two tokens that end there are a link. Link counts
of the corpus weigh each text by its copies, and a last join takes the measures of a text
to its documents.

1. Texts are cut into short strings where both tokenizers always cut; groups never cross
   such a place, so what a string gives is kept for the next time it is met.
2. Of two tokens that end together the shorter is the end of the longer. So the pairs
   that can ever be linked follow from the vocabularies alone: some hundred thousand,
   numbered once. A text's links are stored as those numbers, a task's counts are an
   array over them, and the counts of the whole corpus are sent to every task, a size
   that the vocabularies bound whatever the corpus.

Odd rows: a null or empty text, and one whose tokens do not spell it (it holds U+2581,
which the pieces read as a space), has zeros and an empty digest; a null doc_id is kept; a
repeated row counts as a document and gets its row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.byte_bpe import byte_level
from gleaner.llm.piece_bpe import blocks, pieces
from gleaner.llm.prefix_table import IntMap, Kept
from gleaner.llm.session_tools import materialize
from gleaner.llm.wordcache import UNIT, default_tokenizer

KEPT = 60_000
LONGEST = 48

ALIGNED = "key string, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
MEASURED = "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Two tokenizers, the byte-level one (a) and the pieces (b), and the numbers of their pairs."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_level(a_path), pieces(b_path)
        self.width = len(self.b.text)
        by_text: dict[bytes, list[int]] = defaultdict(list)
        for i, t in enumerate(self.b.text):
            if t:
                by_text[t].append(i)
        a_of = {t: i for i, t in self.a.text.items()}
        codes = {i * self.width + j for t, i in a_of.items() for k in range(len(t)) for j in by_text.get(t[k:], ())}
        codes |= {a_of[t[k:]] * self.width + j for t, js in by_text.items() for k in range(1, len(t)) if t[k:] in a_of for j in js}
        self.codes = np.array(sorted(codes), dtype=np.int64)
        self.number = IntMap(self.codes, np.arange(len(self.codes), dtype=np.int32))
        # Forms of token i in a group: of a inside and last, of b inside, last, and last of its string.
        self.forms = [f"{i}{e}" for i in range(len(self.a.size)) for e in ",|"]
        self.b_forms = len(self.forms)
        self.forms += [f"{i}{e}" for i in range(self.width) for e in (",", ";", ";\n")]
        self.kept = Kept(self._aligned, KEPT, LONGEST)

    def _aligned(self, strings: list[str]) -> list[tuple[str, bytes, int, int]]:
        """(groups, a semicolon after each; numbers of the links; tokens of a; tokens of b) of each string."""
        if not strings:
            return []
        a, a_first = self.a.encode(strings)
        b, b_first = self.b.encode([s.replace("▁", " ") for s in strings])
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        bounds = np.cumsum([len(s.encode()) for s in strings])
        if not (np.array_equal(a_end[a_first[1:] - 1], bounds) and np.array_equal(b_end[b_first[1:] - 1], bounds)):
            # Some string is not spelled by its tokens: sort those out one by one.
            if len(strings) == 1:
                return [("", b"", -1, -1)]
            half = len(strings) // 2
            return self._aligned(strings[:half]) + self._aligned(strings[half:])
        total = int(bounds[-1]) + 1
        ends = np.zeros(total, dtype=np.int8)
        ends[a_end] += 1
        ends[b_end] += 1
        a_last, b_last = ends[a_end] == 2, ends[b_end] == 2
        links = self.number.get(a[a_last] * self.width + b[b_last])
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        final = np.zeros(len(b), dtype=np.int64)
        final[b_first[1:] - 1] = 1
        forms = np.concatenate([2 * a + a_last, self.b_forms + 3 * b + b_last + final])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        groups = "".join(map(self.forms.__getitem__, forms[order].tolist()))[:-1].split("\n")
        # Groups before each string: those that end up to its begin.
        many = np.concatenate(([0], np.cumsum(b_last)))[b_first].tolist()
        data = links.astype("<i4").tobytes()
        own = [data[4 * x : 4 * y] for x, y in zip(many, many[1:], strict=False)]
        return list(zip(groups, own, np.diff(a_first).tolist(), np.diff(b_first).tolist(), strict=True))

    def align(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """(tokens of a, tokens of b, groups, numbers of the links) of whole texts; a text
        that its tokens do not spell has none."""
        strings, spans = [], []
        for text in texts:
            at = len(strings)
            strings.extend(UNIT.findall(f" {text}"))
            spans.append((at, len(strings)))
        found = self.kept.all(strings)
        out = []
        for x, y in spans:
            own = found[x:y]
            counts = [e[2] for e in own]
            if -1 in counts:
                out.append((0, 0, "", b""))
            else:
                out.append((sum(counts), sum([e[3] for e in own]), "".join([e[0] for e in own])[:-1], b"".join([e[1] for e in own])))
        return out


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every distinct text's digest, copies, token counts, groups and links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            for part in blocks(texts):
                rows = both.align(part)
                columns = [
                    batch.column("key").slice(at, len(part)),
                    batch.column("copies").slice(at, len(part)),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[3]) // 4 for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[2].encode()).hexdigest() if r[0] else "" for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.binary()),
                ]
                at += len(part)
                yield _batch(ALIGNED, columns)

    texts = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select("text", F.sha2("text", 256).alias("key"), "copies").mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, count): how many links of the whole corpus hold each pair, by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pair(a_path, b_path).codes), dtype=np.int64)
        for batch in batches:
            links = batch.column("links")
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            many = [len(x) // 4 for x in links.to_pylist()]
            numbers = np.frombuffer(b"".join(links.to_pylist()), dtype="<i4")
            once = np.repeat(copies == 1, many)
            total += np.bincount(numbers[once], minlength=len(total))
            more = np.flatnonzero(~once)
            if len(more):
                np.add.at(total, numbers[more], np.repeat(copies, many)[more])
        held = np.flatnonzero(total)
        yield _batch("pair int, count long", [pa.array(held, pa.int32()), pa.array(total[held], pa.int64())])

    parts = rows.select("links", "copies").mapInArrow(run, "pair int, count long")
    return parts.groupBy("pair").agg(F.sum("count").alias("count"))


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Token, group and link measures of every document."""
    spark = docs.sparkSession
    a_path, b_path = a or default_tokenizer("byte_bpe_50k.json"), b or default_tokenizer("piece_bpe_32k.model")
    rows = materialize(aligned(docs, a_path, b_path), "aligned")
    both = pair(a_path, b_path)
    counts = np.zeros(len(both.codes), dtype=np.int64)
    # At most one row for each numbered pair, whatever the corpus.
    found = pair_counts(rows, a_path, b_path).toArrow()
    counts[found.column("pair").to_numpy()] = found.column("count").to_numpy()
    highest = np.zeros(both.width, dtype=np.int64)
    np.maximum.at(highest, both.codes % both.width, counts)
    shared = spark.sparkContext.broadcast((counts, counts == highest[both.codes % both.width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            links = [np.frombuffer(x, dtype="<i4") for x in batch.column("links").to_pylist()]
            columns = [batch.column(c) for c in ("key", "n_a", "n_b", "n_groups")]
            columns += [
                batch.column("n_groups"),
                pa.array([int(best[x].sum()) for x in links], pa.int64()),
                pa.array([int(counts[x].sum()) for x in links], pa.int64()),
                batch.column("groups_sha256"),
            ]
            yield _batch(MEASURED, columns)

    measured = rows.mapInArrow(run, MEASURED)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = texts.filter("text <> ''").select("doc_id", F.sha2("text", 256).alias("key")).join(measured, "key", "left").drop("key")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    empty = texts.filter("text IS NULL OR text = ''").select("doc_id", *zero, F.lit("").alias("groups_sha256"))
    return named.unionByName(empty)
