"""Document quality from a linear-chain conditional random field over lines.

Each line gets shares of character kinds, repeated words and length as features, together
with those of the line before and after. A two-state chain (bad, good) is fitted by
gradient ascent on labelled documents, every line carrying its document's label. Scoring
runs forward-backward over all lines of a text, averages the marginal chance of ``good``
weighted by line length, and maps the average to a chance by a logistic fit.

The fit uses at most ``TRAIN_TEXTS`` labelled documents, chosen by a hash of their id, of
at most ``TRAIN_LINES`` lines each; every document is scored over its whole text.

Odd rows: a null or empty text is one empty line; a null doc_id is kept; repeated rows are
scored each, and of contradicting labels the larger counts; without labels of both kinds
every score is the share of good labels, or one half; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.texthash import Block, blocks, encoded

TRAIN_TEXTS = 2_000
TRAIN_LINES = 128
STEPS, RATE, DECAY = 200, 0.1, 1e-3

SCORED = "doc_id long, score double, predicted int"


def _kind(characters: str) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[[ord(c) for c in characters]] = True
    return flags


_UPPER = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _kind("abcdefghijklmnopqrstuvwxyz")
_KINDS = [_kind("#*$%&<>"), _kind("|"), _kind("!"), _kind("0123456789"), _kind(".,;:?")]
#: Features of one line: a constant, five shares of kinds, capitals, repeats, word length, length.
OWN = 10
FEATURES = 3 * OWN - 2


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, text number) of every line of a block."""
    end = np.flatnonzero(block.bytes == 10)
    start = np.concatenate(([0], end[:-1] + 1)).astype(np.int64)
    text = np.searchsorted(block.end, end)
    length = end - start
    words = block.words()
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n_words = last - first
    repeats = np.zeros(len(words.hash) + 1, dtype=np.int64)
    same = words.hash[1:] == words.hash[:-1]
    np.cumsum(same, out=repeats[2:]) if len(same) else None
    # Repeats of the word before, inside the line.
    repeated = repeats[last] - repeats[np.minimum(first + 1, last)]
    per_byte = 1 / np.maximum(length, 1)
    own = np.ones((len(end), OWN))
    for i, kind in enumerate(_KINDS):
        own[:, 1 + i] = block.counts(kind, start, end) * per_byte
    own[:, 6] = block.counts(_UPPER, start, end) / np.maximum(block.counts(_LETTER, start, end), 1)
    own[:, 7] = repeated / np.maximum(n_words - 1, 1)
    own[:, 8] = np.minimum(length / np.maximum(n_words, 1) / 20, 3)
    own[:, 9] = np.log1p(length) / 5
    before, after = np.zeros((len(end), OWN - 1)), np.zeros((len(end), OWN - 1))
    chained = text[1:] == text[:-1]
    before[1:][chained] = own[:-1, 1:][chained]
    after[:-1][chained] = own[1:, 1:][chained]
    return np.hstack([own, before, after]), length, text


@dataclass
class Chain:
    """Weights of the good state, log potentials of the four moves, and the logistic map."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def marginals(chain: Chain, scores: np.ndarray, lengths: np.ndarray):
    """Chance of ``good`` at every step, and expected moves, of chains given as padded rows
    of good-state scores. ``lengths`` holds at least 1 each."""
    rows, steps = scores.shape
    move = np.exp(chain.moves - chain.moves.max())
    # Potentials of both states, scaled so that the larger is 1.
    good = np.exp(np.minimum(scores, 0))
    bad = np.exp(-np.maximum(scores, 0))
    forward = np.zeros((steps, rows, 2))
    backward = np.ones((steps, rows, 2))
    live = np.arange(steps)[:, None] < lengths[None, :]
    for t in range(steps):
        prior = forward[t - 1] @ move if t else np.ones((rows, 2))
        now = prior * np.stack([bad[:, t], good[:, t]], axis=1)
        forward[t] = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
    for t in range(steps - 2, -1, -1):
        later = (backward[t + 1] * np.stack([bad[:, t + 1], good[:, t + 1]], axis=1)) @ move.T
        later /= np.maximum(later.sum(axis=1, keepdims=True), 1e-300)
        backward[t] = np.where(live[t + 1][:, None], later, 1.0)
    both = forward * backward
    both /= np.maximum(both.sum(axis=2, keepdims=True), 1e-300)
    expected = np.zeros((2, 2))
    for t in range(steps - 1):
        emit = backward[t + 1] * np.stack([bad[:, t + 1], good[:, t + 1]], axis=1)
        pair = forward[t][:, :, None] * move[None] * emit[:, None, :]
        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
        expected += pair[live[t + 1]].sum(axis=0)
    return both[:, :, 1].T, expected


def _padded(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of ``values`` laid out per text; ``lengths`` are rows per text."""
    out = np.zeros((len(lengths), int(lengths.max()), *values.shape[1:]))
    row = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, step] = values
    return out


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]]) -> Chain | None:
    """Chain of (features, line lengths, label) of labelled texts; None without both labels."""
    labels = np.array([y for _, _, y in texts])
    if len(set(labels.tolist())) < 2:
        return None
    order = np.argsort([len(x) for x, _, _ in texts], kind="stable")
    groups = []
    for part in np.array_split(order, max(1, len(order) // 250)):
        lengths = np.array([len(texts[i][0]) for i in part])
        groups.append((_padded(np.concatenate([texts[i][0] for i in part]), lengths), lengths, labels[part]))
    total = sum(int(n.sum()) for _, n, _ in groups)
    observed = np.zeros((2, 2))
    for _, n, y in groups:
        observed[0, 0] += (n - 1)[y == 0].sum()
        observed[1, 1] += (n - 1)[y == 1].sum()
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    theta, mean, square = np.zeros(FEATURES + 4), 0.0, 0.0
    for step in range(1, STEPS + 1):
        slope, moves = np.zeros(FEATURES), observed.copy()
        for x, n, y in groups:
            good, expected = marginals(chain, x @ chain.weights, n)
            live = np.arange(x.shape[1])[None, :] < n[:, None]
            slope += np.einsum("dt,dtf->f", (y[:, None] - good) * live, x)
            moves -= expected
        gradient = np.concatenate([slope, moves.ravel()]) / total - DECAY * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        chain = Chain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
    raw = np.concatenate([averages(chain, [t[0] for t in texts[i : i + 500]], [t[1] for t in texts[i : i + 500]]) for i in range(0, len(texts), 500)])
    chain.slope, chain.shift = _logistic(_logit(raw), labels)
    return chain


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, lightly held back so that it stays finite."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        hessian = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        gradient = np.array([((y - p) * x).sum() - a, (y - p).sum() - 0.1 * b])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def averages(chain: Chain, features: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    """Length-weighted mean chance of ``good`` of each text."""
    sizes = np.array([len(x) for x in features])
    out = np.zeros(len(sizes))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # Texts of like size together, so that padding at most doubles the work.
        most = 2 * sizes[order[at]]
        part = order[at : at + int(np.searchsorted(sizes[order[at:]], most, side="right"))]
        part = part[: max(1, 200_000 // int(sizes[part].max()))]
        n = sizes[part]
        scores = _padded(np.concatenate([features[i] @ chain.weights for i in part]), n)
        weight = _padded(np.concatenate([lengths[i] + 1.0 for i in part]), n)
        good, _ = marginals(chain, scores, n)
        out[part] = (good * weight).sum(axis=1) / weight.sum(axis=1)
        at += len(part)
    return out


def _lines(texts: list[bytes]) -> Iterator[tuple[slice, list[np.ndarray], list[np.ndarray]]]:
    for part, block in blocks(texts):
        x, length, text = line_features(block)
        cuts = np.searchsorted(text, np.arange(1, block.count))
        yield part, np.split(x, cuts), np.split(length, cuts)


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> tuple[Chain | None, float]:
    """(chain, share of good labels) from a bounded sample of the usable labelled rows."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_TEXTS)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = docs.select("doc_id", "text").filter(lines <= TRAIN_LINES).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, x, n in _lines(encoded(batch["text"])):
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[part].array,
                        "label": batch["_label"].iloc[part].array,
                        "x": [v.astype("<f4").tobytes() for v in x],
                        "n": [v.astype("<i8").tobytes() for v in n],
                    }
                )

    found = rows.mapInPandas(run, "doc_id long, label int, x binary, n binary").toPandas().sort_values(["doc_id", "x"])
    texts = [
        (np.frombuffer(x, dtype="<f4").reshape(-1, FEATURES).astype(float), np.frombuffer(n, dtype="<i8"), int(y))
        for y, x, n in found[["label", "x", "n"]].itertuples(index=False)
    ]
    share = float(np.mean([y for _, _, y in texts])) if texts else 0.5
    return fit(texts), share


def quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    usable: Column | None = None,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, the columns ``carried``, score and predicted of every document."""
    chain, share = train(docs, labels, label, F.lit(True) if usable is None else usable)
    out = ["doc_id", *carried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, x, n in _lines(encoded(batch["text"])):
                if chain is None:
                    score = np.full(len(x), share)
                else:
                    score = 1 / (1 + np.exp(-(chain.slope * _logit(averages(chain, x, n)) + chain.shift)))
                yield batch.iloc[part][out].assign(score=score, predicted=(score >= 0.5).astype("int32"))

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", score double, predicted int"
    return docs.select(*out, *({"text"} - set(out))).mapInPandas(run, schema)
