"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The vocabulary is the words whose presence goes with the label most, by chi-squared over
the labelled examples; rare and very common words are left out. Examples become unit
vectors of (1 + log tf) * idf over it, kept as an inverted index whose posting lists are
cut into blocks of ``BLOCK`` successive examples, with the largest weight of each block.
The sum of a text's weights times block maxima bounds every cosine in a block, so blocks
are read from the largest bound down until no bound exceeds the ``NEAREST``-th cosine
found: the result is exact. Neighbours vote by 1 / (distance + ``SOFT``), and an isotonic
fit of left-one-out votes of the examples turns votes into chances. The nearest examples
come with the score as evidence.

The index holds at most ``EXAMPLES`` labelled documents, chosen by a hash of their id, so
what is sent to tasks is bounded; every document is scored over its whole text.

Odd rows: a null or empty text, or one without vocabulary words, has no neighbours and the
share of toxic examples among such texts; a null doc_id is kept; repeated rows are scored
each, and of contradicting labels the larger counts; without labels every score is 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 6_000
VOCABULARY = 1_000
#: Least documents of a word, largest share of documents, least chi-squared (one in a thousand).
MIN_DOCS, MAX_SHARE, MIN_CHI2 = 3, 0.2, 10.83
BLOCK, NEAREST, SOFT, EVIDENCE = 64, 15, 0.05, 3
#: Words of a training text are counted once each; longer words are not looked at.
MAX_WORD = 60
WORD = re.compile(r"[^\W\d_]+")

SCORED = "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"


class Index:
    """Inverted index of unit vectors with the largest weight of each block."""

    def __init__(self, vectors: list[list[tuple[int, float]]], terms: int):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for example, vector in enumerate(vectors):
            for term, weight in vector:
                postings[term].append((example, weight))
        self.example = [np.array([e for e, _ in p], dtype=np.int64) for p in postings]
        self.weight = [np.array([w for _, w in p]) for p in postings]
        self.cut = [np.searchsorted(e, np.arange(self.blocks + 1) * BLOCK) for e in self.example]
        self.most = np.zeros((terms, self.blocks))
        for term, (e, w) in enumerate(zip(self.example, self.weight, strict=True)):
            np.maximum.at(self.most[term], e // BLOCK, w)

    def nearest(self, vector: list[tuple[int, float]], k: int, without: int = -1) -> list[tuple[int, float]]:
        """The k examples of largest positive cosine, ties to the earlier example."""
        if not vector or not self.size:
            return []
        terms, weights = [t for t, _ in vector], np.array([w for _, w in vector])
        bound = weights @ self.most[terms]
        best: list[tuple[int, float]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(best) == k and bound[block] < best[-1][1] - 1e-12):
                break
            cosine = np.zeros(BLOCK)
            for term, weight in zip(terms, weights, strict=True):
                a, b = self.cut[term][block], self.cut[term][block + 1]
                if a < b:
                    cosine[self.example[term][a:b] - block * BLOCK] += weight * self.weight[term][a:b]
            if without // BLOCK == block and without >= 0:
                cosine[without % BLOCK] = 0
            found = np.flatnonzero(cosine > (best[-1][1] - 1e-12 if len(best) == k else 0))
            best += [(block * BLOCK + int(i), float(cosine[i])) for i in found]
            best = sorted(best, key=lambda x: (-x[1], x[0]))[:k]
        return best


def vote(found: list[tuple[int, float]], toxic: np.ndarray) -> float:
    """Distance-weighted share of toxic neighbours; -1 without neighbours."""
    if not found:
        return -1.0
    weight = np.array([1 / (1 - min(c, 1.0) + SOFT) for _, c in found])
    return float(weight @ toxic[[e for e, _ in found]] / weight.sum())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending steps (x, value) that fit y best by x; each value is pulled a little to the mean."""
    values, counts = np.unique(x, return_counts=True)
    sums = np.array([y[x == v].sum() for v in values], dtype=float)
    merged: list[list[float]] = []
    for v, s, n in zip(values, sums, counts, strict=True):
        merged.append([v, s, n])
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            _, s, n = merged.pop()
            merged[-1][1] += s
            merged[-1][2] += n
    mean = y.mean() if len(y) else 0.0
    return np.array([m[0] for m in merged]), np.array([(m[1] + mean) / (m[2] + 1) for m in merged])


class Model:
    """Vocabulary, index, labels and calibration, built from labelled texts' word counts."""

    def __init__(self, words: list[str], idf: np.ndarray, examples: list[tuple[int, dict[int, int], int]]):
        self.number = {w: i for i, w in enumerate(words)}
        self.idf = idf
        self.ids = [d for d, _, _ in examples]
        self.toxic = np.array([y for _, _, y in examples], dtype=float)
        vectors = [self.vector(counts) for _, counts, _ in examples]
        self.index = Index(vectors, len(words))
        votes = np.array([vote(self.index.nearest(v, NEAREST, i), self.toxic) for i, v in enumerate(vectors)])
        self.steps, self.chance = isotonic(votes, self.toxic)

    def vector(self, counts: dict[int, int]) -> list[tuple[int, float]]:
        weights = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = np.sqrt(sum(w * w for w in weights.values()))
        return [(t, w / norm) for t, w in sorted(weights.items())]

    def counts(self, text: str | None) -> dict[int, int]:
        number = self.number
        return Counter([number[w] for w in WORD.findall(text.lower()) if w in number]) if text else {}

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        if not self.ids:
            return 0.0, []
        found = self.index.nearest(self.vector(self.counts(text)), NEAREST)
        at = int(np.searchsorted(self.steps, vote(found, self.toxic), side="right")) - 1
        evidence = [(self.ids[e], c, int(self.toxic[e])) for e, c in found[:EVIDENCE]]
        return float(self.chance[max(at, 0)]), evidence


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> Model:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, text in zip(batch["_label"], batch["text"], strict=True):
                words = {w for w in WORD.findall(text.lower()) if len(w) <= MAX_WORD} if text else set()
                yield pd.DataFrame({"word": ["", *words], "toxic": int(label)})

    counted = rows.mapInPandas(distinct_words, "word string, toxic int").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t")
    )
    all_rows = counted.filter("word = ''").first()
    if all_rows is None:
        return Model([], np.zeros(0), [])
    total, toxic = all_rows["n"], all_rows["t"]
    a, b = F.col("t"), F.col("n") - F.col("t")
    c, d = F.lit(toxic) - a, F.lit(total - toxic) - b
    chi2 = F.pow(a * d - b * c, 2) * total / F.greatest((a + b).cast("double") * (c + d) * toxic * (total - toxic), F.lit(1.0))
    words = (
        counted.filter((F.col("word") != "") & (F.col("n") >= MIN_DOCS) & (F.col("n") <= MAX_SHARE * total))
        .withColumn("chi2", chi2)
        .filter(F.col("chi2") >= MIN_CHI2)
        .orderBy(F.desc("chi2"), "word")
        .limit(VOCABULARY)
        .collect()
    )
    vocabulary = [r["word"] for r in words]
    number = {w: i for i, w in enumerate(vocabulary)}
    idf = np.array([np.log((1 + total) / (1 + r["n"])) + 1 for r in words])

    def in_vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, label, text in batch[["doc_id", "_label", "text"]].itertuples(index=False):
                counts = Counter([number[w] for w in WORD.findall(text.lower()) if w in number]) if text else {}
                pairs = sorted(counts.items())
                rows.append((doc_id, label, [t for t, _ in pairs], [n for _, n in pairs]))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "terms", "counts"])

    found = rows.mapInPandas(in_vocabulary, "doc_id long, label int, terms array<int>, counts array<int>").collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["terms"], r["counts"]))
    return Model(vocabulary, idf, [(r["doc_id"], dict(zip(r["terms"], r["counts"], strict=True)), r["label"]) for r in found])


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None) -> DataFrame:
    """doc_id, score, predicted and evidence of every document."""
    model = train(docs, labels, label, F.lit(True) if usable is None else usable)
    sent = docs.sparkSession.sparkContext.broadcast((list(model.number), model.idf, model.ids, model.toxic, model.index.__dict__, model.steps, model.chance))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, idf, ids, toxic, index, steps, chance = sent.value
        own = Model.__new__(Model)
        own.number, own.idf, own.ids, own.toxic = {w: i for i, w in enumerate(words)}, idf, ids, toxic
        own.index, own.steps, own.chance = Index.__new__(Index), steps, chance
        own.index.__dict__.update(index)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                score, evidence = own.score(text if isinstance(text, str) else None)
                rows.append((doc_id, score, int(score >= 0.5), [{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in evidence]))
            yield pd.DataFrame(rows, columns=["doc_id", "score", "predicted", "evidence"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCORED)
