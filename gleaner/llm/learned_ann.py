"""Nearest vectors by inner product through learned partitions.

1. A bounded sample of the vectors is joined into a graph of nearest neighbours, and the
   graph is cut into parts of equal size so that few edges cross: parts start from median
   splits along main axes, then vertices move to the part most of their neighbours are in
   while parts keep within ``SLACK`` of their size.
2. A small network with one hidden layer learns to give, for a vector, the chance that its
   neighbours lie in each part.
3. There are about as many parts as the square root of the rows. Beyond ``COARSE`` parts
   they come in two levels: each coarse part has a graph, parts and a network of its own,
   fitted by tasks on a bounded sample of its rows, and the chances are multiplied.
4. Every vector is indexed in its most probable part. A query goes to its several most
   probable parts and is compared there with every vector, in double precision. How many
   parts is the least number that finds ``TARGET`` of the true neighbours of a bounded set
   of trial queries, which are compared with all vectors; the share found is returned
   beside the results. Vectors without any structure need most of their parts.

Queries are cut into blocks of ``ASKED`` at most, about, those with the same first part
together, and a vector travels once to every block that needs its part. There the vectors
are dealt over slots, and a task keeps the k best of a query over all the vectors of a
slot, which it reads as a stream: neither a part that holds a third of all rows nor a block
of queries is ever whole in memory, and rows found grow with the queries.

What the driver and every task hold of the index is at most ``COARSE`` networks of
``FINE_HIDDEN`` units and one of ``HIDDEN`` units: some 3 MB for 64 numbers a vector.

Odd rows: a vector that is null, zero, of another length than most of the table, or holds
null or non-finite numbers, and a row without id, take no part; of ties the smaller id is
nearer; rows that share the query's id are the query's own; of queries with the same id the
least vector is asked; a repeated row can be found twice; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.session_tools import materialize, shuffle_width

SAMPLE = 4_096
#: Rows of a coarse part that its own parts are learned from.
FINE_SAMPLE = 1_000
COARSE, FINE = 64, 60
#: Sampled rows behind a part at least.
LEAST_ROWS = 16
NEIGHBOURS, SLACK, PASSES = 16, 1.1, 12
HIDDEN, EPOCHS, RATE = 128, 60, 3e-3
FINE_HIDDEN = 32
TRIALS, TARGET = 128, 0.95
#: Rows of a part that meet the blocks of queries in one place.
BLOCK = 4_096
ASKED = 4_096
#: Slots of a block of queries at least, and rows of the table behind a further one.
SLOTS, SLOT_ROWS = 16, 1_000_000
#: Vectors compared with a block of queries at a time, and found rows kept between merges.
CHUNK, BUFFER = 1_024, 300_000

FOUND = "query_id long, vec_id long, score double, part int"
_EMPTY = "query_id long, rank int, vec_id long, score double, trial_recall double"


def usable(vectors: DataFrame, kind: str, length: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, embedding as ``kind``) of the rows that take part, and the length of their
    vectors: ``length`` or else the commonest one."""
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")
    )
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(fine & F.exists("embedding", lambda x: x != 0))
    if length is None:
        common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = common["n"] if common else 0
    return rows.filter(F.size("embedding") == length), length


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def balanced_parts(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of every sampled vector, its neighbours in the graph)."""
    n = len(x)
    k = min(NEIGHBOURS, n - 1)
    near = np.zeros((n, k), dtype=np.int64)
    for at in range(0, n, 1024):
        scores = x[at : at + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        near[at : at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else near[at : at + 1024]
    part = np.zeros(n, dtype=np.int64)
    groups = [(np.arange(n), 0, parts)]
    while groups:
        rows, first, count = groups.pop()
        if count == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        low = count // 2
        cut = len(rows) * low // count
        groups += [(order[:cut], first, low), (order[cut:], first + low, count - low)]
    most = math.ceil(SLACK * n / parts)
    for _ in range(PASSES):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), k), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, k)), 1)
        wanted = votes.argmax(axis=1)
        gain = votes[np.arange(n), wanted] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[wanted[i]] < most:
                size[part[i]] -= 1
                size[wanted[i]] += 1
                part[i] = wanted[i]
                moved += 1
        if not moved:
            break
    return part, near


class Router:
    """Chance of each of ``parts`` parts for a vector."""

    def __init__(self, scale: float, weights: list[np.ndarray]):
        self.scale, self.weights = scale, weights
        self.parts = len(weights[3])

    @staticmethod
    def fit(x: np.ndarray, parts: int, hidden: int = HIDDEN) -> "Router":
        """Learn balanced parts of the graph of ``x``."""
        part, near = balanced_parts(x, parts)
        rng = np.random.default_rng(7)
        n, dim = x.shape
        scale = float(np.sqrt((x**2).mean())) or 1.0
        target = np.zeros((n, parts))
        np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1.0)
        target[np.arange(n), part] += 1.0
        target /= target.sum(axis=1, keepdims=True)
        w = [rng.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        mean, square = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        step, z = 0, x / scale
        for _ in range(EPOCHS if parts > 1 else 0):
            order = rng.permutation(n)
            for at in range(0, n, 256):
                rows = order[at : at + 256]
                h = np.maximum(z[rows] @ w[0] + w[1], 0)
                error = (np.exp(_log_softmax(h @ w[2] + w[3])) - target[rows]) / len(rows)
                back = (error @ w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0))):
                    mean[i] = 0.9 * mean[i] + 0.1 * g
                    square[i] = 0.999 * square[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
        return Router(scale, w)

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return _log_softmax(np.maximum((x / self.scale) @ w[0] + w[1], 0) @ w[2] + w[3])

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(a).tobytes() for a in self.weights)

    @staticmethod
    def unpacked(scale: float, parts: int, hidden: int, dim: int, data: bytes) -> "Router":
        flat, weights = np.frombuffer(data), []
        for shape in ((dim, hidden), (hidden,), (hidden, parts), (parts,)):
            size = math.prod(shape)
            weights.append(flat[:size].reshape(shape))
            flat = flat[size:]
        return Router(scale, weights)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Parts:
    """The parts of both levels, numbered through in the order of the coarse ones."""

    def __init__(self, coarse: Router, fine: dict[int, Router]):
        self.coarse, self.fine = coarse, fine
        self.count = sum(fine[c].parts if c in fine else 1 for c in range(coarse.parts))

    def ranked(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable parts of every vector, most probable first."""
        out = []
        for at in range(0, len(x), CHUNK):
            z = x[at : at + CHUNK]
            top = self.coarse.log_chances(z)
            chances = np.concatenate(
                [top[:, [c]] + (self.fine[c].log_chances(z) if c in self.fine else 0.0) for c in range(self.coarse.parts)], axis=1
            )
            out.append(chances.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-chances, axis=1, kind="stable")[:, :probes])
        return np.concatenate(out).astype("int32")


def learn_parts(rows: DataFrame, total: int) -> Parts | None:
    """Parts of the usable vectors ``rows``, ``total`` of them."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).toPandas()
    if not len(chosen):
        return None
    x = _matrix(chosen["embedding"])
    dim = x.shape[1]
    wanted = math.ceil(math.sqrt(total))
    coarse = Router.fit(x, max(1, min(COARSE, wanted, len(x) // LEAST_ROWS)))
    fine = min(FINE, math.ceil(wanted / coarse.parts))
    if fine == 1 or coarse.parts < COARSE:
        return Parts(coarse, {})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(part=coarse.log_chances(_matrix(batch["embedding"])).argmax(axis=1).astype("int32"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        parts = max(1, min(fine, len(rows) // LEAST_ROWS))
        router = Router.fit(_matrix(rows["embedding"]), parts, FINE_HIDDEN)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "parts": [parts], "scale": [router.scale], "weights": [router.packed()]})

    kind = dict(rows.dtypes)["embedding"]
    placed = rows.select("vec_id", "embedding").mapInPandas(place, f"vec_id long, embedding {kind}, part int")
    order = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id")
    # Few enough for Spark to cut each task's rows before they are shuffled.
    sampled = placed.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= FINE_SAMPLE).drop("at")
    fitted = sampled.groupBy("part").applyInPandas(fit, "part int, parts int, scale double, weights binary").collect()
    return Parts(coarse, {r["part"]: Router.unpacked(r["scale"], r["parts"], FINE_HIDDEN, dim, bytes(r["weights"])) for r in fitted})


def routed(rows: DataFrame, parts: Parts, probes: int, name: str) -> DataFrame:
    """``rows`` (``name``, embedding) with their ``probes`` most probable parts as the array ``parts``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(parts=list(parts.ranked(_matrix(batch["embedding"]), probes)))

    kind = dict(rows.dtypes)["embedding"]
    return rows.select(name, "embedding").mapInPandas(run, f"{name} long, embedding {kind}, parts array<int>")


def index(rows: DataFrame, parts: Parts) -> DataFrame:
    """(vec_id, embedding, part) of every vector, written."""
    placed = routed(rows, parts, 1, "vec_id")
    return materialize(placed.select("vec_id", "embedding", F.col("parts")[0].alias("part")), "base")


class _Slot:
    """The k best of a block of queries over the vectors of a slot."""

    def __init__(self, k: int):
        self.k, self.asked, self.ids = k, [], None
        self.found: list[tuple] = []
        self.waiting = 0

    def add(self, rows: pd.DataFrame) -> None:
        kind = rows["kind"].to_numpy()
        if (kind == 0).any():
            self.asked.append(rows[kind == 0])
        rest = rows[kind == 1]
        if not len(rest) or not self.asked:
            return
        if self.ids is None:
            self._ready()
        part = rest["part"].to_numpy()
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ids, x = rest["id"].to_numpy(), _matrix(rest["embedding"])
        for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
            mine = self.by_part.get(int(part[a]))
            for at in range(a, b, CHUNK) if mine is not None else ():
                self._compare(mine, ids[at : min(b, at + CHUNK)], x[at : min(b, at + CHUNK)], part[a])

    def _ready(self) -> None:
        asked = pd.concat(self.asked, ignore_index=True)
        self.ids, self.x = asked["id"].to_numpy(), _matrix(asked["embedding"])
        self.length = np.sqrt((self.x**2).sum(axis=1))
        self.least = np.full(len(asked), -np.inf)
        places = np.repeat(np.arange(len(asked)), asked["parts"].map(len))
        parts = np.concatenate(asked["parts"].to_numpy())
        order = np.argsort(parts, kind="stable")
        values, starts = np.unique(parts[order], return_index=True)
        self.by_part = dict(zip(values.tolist(), np.split(places[order], starts[1:]), strict=True))

    def _compare(self, mine: np.ndarray, ids: np.ndarray, x: np.ndarray, part: int) -> None:
        scores = self.x[mine] @ x.T
        for at in np.flatnonzero(np.isin(ids, self.ids[mine])).tolist():
            scores[self.ids[mine] == ids[at], at] = -np.inf
        least = self.least[mine]
        if len(ids) >= self.k:
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        # A product of matrices may round otherwise than two rows by themselves.
        slack = 8 * x.shape[1] * np.finfo(float).eps * self.length[mine] * np.sqrt((x**2).sum(axis=1).max())
        q, v = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
        for at in range(0, len(q), 65_536):
            a, b = mine[q[at : at + 65_536]], v[at : at + 65_536]
            exact = (self.x[a] * x[b]).sum(axis=1)
            self.found.append((a, ids[b], exact, np.full(len(a), part, dtype="int32")))
            self.waiting += len(a)
            if self.waiting > BUFFER:
                self._merge()

    def _merge(self) -> None:
        q, ids, score, part = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score, part = q[order], ids[order], score[order], part[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        last = place == self.k - 1
        self.least[q[last]] = score[last]
        best = place < self.k
        self.found, self.waiting = [(q[best], ids[best], score[best], part[best])], 0

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.found:
            self._merge()
            q, ids, score, part = self.found[0]
            yield pd.DataFrame({"query_id": self.ids[q], "vec_id": ids, "score": score, "part": part})


def _slots(k: int):
    """Rows of several slots, sorted by slot with the queries first, to the best of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, slot = None, None
        for batch in batches:
            if not len(batch):
                continue
            own = batch[["asked", "slot"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])
            for a, b in zip(starts, np.r_[starts[1:], len(own)], strict=True):
                if key != tuple(own[a]):
                    if slot is not None:
                        yield from slot.rows()
                    key, slot = tuple(own[a]), _Slot(k)
                slot.add(batch.iloc[a:b])
        if slot is not None:
            yield from slot.rows()

    return run


def nearest(base: DataFrame, total: int, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of every query (query_id, embedding, parts) in the parts listed for it.

    ``base`` is an index of ``total`` vectors and ``queries`` a written table.
    """
    spark = base.sparkSession
    # At most a row for each part.
    begin, at = [], 0
    for row in queries.groupBy(F.col("parts")[0].alias("first")).count().orderBy("first").collect():
        begin.append((row["first"], at, row["count"]))
        at += row["count"]
    starts = F.broadcast(spark.createDataFrame(begin, "first int, start long, many long"))
    blocked = queries.withColumn("first", F.col("parts")[0]).join(starts, "first")
    spot = F.col("start") + F.pmod(F.xxhash64("query_id"), F.col("many"))
    blocked = blocked.select("query_id", "embedding", "parts", F.floor(spot / ASKED).cast("int").alias("asked"))
    sizes = base.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = materialize(sizes, "sizes")
    needs = blocked.select("asked", F.explode("parts").alias("part")).distinct().join(F.broadcast(sizes), "part")
    needs = needs.select("asked", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")
    sent = base.join(F.broadcast(sizes), "part").withColumn("block", block).join(needs, ["part", "block"])
    slots = max(SLOTS, math.ceil(total / SLOT_ROWS))
    sent = sent.select(
        "asked",
        F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int").alias("slot"),
        F.lit(1).alias("kind"),
        "part",
        F.col("vec_id").alias("id"),
        "embedding",
        F.lit(None).cast("array<int>").alias("parts"),
    )
    asking = blocked.select(
        "asked",
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
        F.lit(0).alias("kind"),
        F.lit(-1).alias("part"),
        F.col("query_id").alias("id"),
        "embedding",
        "parts",
    )
    met = (
        sent.unionByName(asking)
        .repartition(shuffle_width(spark), "asked", "slot")
        .sortWithinPartitions("asked", "slot", "kind", "part")
    )
    found = met.mapInPandas(_slots(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def probes_for(base: DataFrame, total: int, asked: DataFrame, parts: Parts, k: int) -> tuple[int, float]:
    """(how many parts find ``TARGET`` of the neighbours of trial queries, the share found)."""
    trials = asked.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(TRIALS)
    trials = materialize(routed(trials, parts, parts.count, "query_id"), "trials")
    true = nearest(base, total, trials, k).select("query_id", "part").join(trials.select("query_id", "parts"), "query_id")
    # At most a row for each part.
    places = true.groupBy(F.array_position("parts", F.col("part")).alias("place")).count().orderBy("place").collect()
    seen, every = 0, sum(r["count"] for r in places)
    for r in places:
        seen += r["count"]
        if seen >= TARGET * every:
            return int(r["place"]), seen / every
    return parts.count, 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest vectors found for each query,
    and trial_recall, the share of true neighbours found for trial queries.

    ``queries`` has columns vec_id and embedding; a vector of the query's id is not its
    neighbour.
    """
    # Floats travel as they are; products are taken in double precision all the same.
    floats = {dict(t.dtypes)["embedding"] for t in (vectors, queries)} == {"array<float>"}
    kind = "array<float>" if floats else "array<double>"
    rows, length = usable(vectors, kind)
    rows = materialize(rows, "vectors")
    total = rows.count()
    parts = learn_parts(rows, total)
    if parts is None:
        return vectors.sparkSession.createDataFrame([], _EMPTY)
    asked, _ = usable(queries, kind, length)
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = materialize(asked, "asked")
    base = index(rows, parts)
    probes, recall = probes_for(base, total, asked, parts, k)
    ready = materialize(routed(asked, parts, probes, "query_id"), "routed")
    return nearest(base, total, ready, k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score", F.lit(recall).alias("trial_recall")
    )
