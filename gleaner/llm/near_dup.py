"""Near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets.

1. A document's set is its distinct shingles of five lower-cased words as 64-bit hashes.
   One pass gives each document its set's size and digest and one hash per band of four
   minima.
2. Documents of equal sets become one class, named by its smallest id; copies go no
   further. The number of bands makes the chance that two classes at the threshold share
   none ``MISS`` at most.
3. Classes that share a band bucket are candidates. For them alone the full set and the
   low four bits of 512 minima, packed into longs, are written once.
4. In a few rounds every class is compared with one class out of all its buckets, so a
   round has at most as many pairs as classes. A pair goes on if the similarity estimated from
   equal low bits, corrected for chance agreement, is within six standard deviations of
   the threshold, and is then confirmed on full sets.
5. Buckets whose classes are still not all connected are compared class by class, in tiles
   of bounded size, by bit counts inside tasks. Classes with a likely partner of another
   component meet once more with their full sets, and a tile gives only the confirmed links
   that connect something new: fewer than it has classes. No class and no bucket is skipped
   or capped.
6. Connected components over all confirmed links give each class its component.

Odd rows: a null or blank text has an empty set, no links and its own component; rows
with equal ids count as one document; a row without id is never linked, has no component
and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.components import components
from gleaner.llm.session_tools import materialize, shuffle_width
from gleaner.llm.texthash import LOWER_TABLE, Block, blocks, encoded, mix

WORDS = 5
ROWS = 4
MISS = 1e-6
#: Minima whose low four bits are kept of a candidate.
MINIMA = 512
#: Rounds in which a class is compared with one other.
STAR_ROUNDS = 3
#: Classes and shingles of one tile side at most, about, when a bucket is compared class by class.
TILE, TILE_SHINGLES = 1_000, 4_000_000

_SEEDS = np.random.default_rng(104729).integers(1, 2**63, (2, MINIMA + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(WORDS)], dtype=np.uint64)
_LENGTH = np.array([pow(0xA0761D6478BD642F, i + 1, 1 << 64) for i in range(WORDS + 1)], dtype=np.uint64)

#: Columns of a class in a tile.
TILED = ["id", "component", "bucket", "block", "b1", "b2"]
FEATURES = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"


def bands_for(percent: int) -> int:
    """Bands of ``ROWS`` minima so that a pair at the threshold is missed with chance ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of a block, in order, repeats included."""
    words = block.words(LOWER_TABLE)
    h, text, n = words.hash, words.text, len(words.hash)
    at = np.flatnonzero(text[: max(n - WORDS + 1, 0)] == text[WORDS - 1 :])
    total = np.full(len(at), _LENGTH[WORDS], dtype=np.uint64)
    for j in range(WORDS):
        total += h[at + j] * _STEP[j]
    texts, hashes = [text[at]], [total]
    for length in range(1, WORDS):
        short = np.flatnonzero(words.per_text == length)
        total = np.full(len(short), _LENGTH[length], dtype=np.uint64)
        for j in range(length):
            total += h[words.first[short] + j] * _STEP[j]
        texts.append(short)
        hashes.append(total)
    return np.concatenate(texts), mix(np.concatenate(hashes))


def distinct_sets(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text's distinct shingle hashes in ascending order, one text after another,
    with where each text's begin and how many there are."""
    text, h = shingles(block)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[new], h[new]
    size = np.bincount(text, minlength=block.count)
    return h, np.cumsum(size) - size, size


def _minima(h: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima over every stretch of ``h`` that begins at ``start``."""
    least = np.zeros((count, len(start)), dtype=np.uint64)
    for j in range(count if len(start) else 0):
        least[j] = np.minimum.reduceat((h ^ _SEEDS[0, j]) * _SEEDS[1, j], start)
    return least


def features(docs: DataFrame, percent: int) -> DataFrame:
    """Set size, set digest and band hashes of every document."""
    bands = bands_for(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, block in blocks(encoded(batch["text"])):
                h, start, size = distinct_sets(block)
                full = np.flatnonzero(size)
                least = _minima(h, start[full], bands * ROWS)
                keys = np.zeros((2, block.count), dtype=np.uint64)
                for k in range(2 if len(full) else 0):
                    keys[k, full] = np.add.reduceat(mix(h ^ _SEEDS[k, -1]), start[full])
                hashes = [np.zeros(0, dtype=np.int64)] * block.count
                band = np.zeros((len(full), bands), dtype=np.uint64)
                for b in range(bands):
                    value = np.full(len(full), b + 1, dtype=np.uint64)
                    for j in range(b * ROWS, (b + 1) * ROWS):
                        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + least[j])
                    band[:, b] = value
                for i, text in enumerate(full.tolist()):
                    hashes[text] = band[i].view(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[part].array,
                        "n_shingles": size,
                        "key1": keys[0].view(np.int64),
                        "key2": keys[1].view(np.int64),
                        "bands": hashes,
                    }
                ).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, FEATURES)


def sets_of(docs: DataFrame) -> DataFrame:
    """(id, its distinct shingle hashes, ascending, as bytes; the low bits of its minima)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, block in blocks(encoded(batch["text"])):
                h, start, size = distinct_sets(block)
                full = np.flatnonzero(size)
                nibbles = _minima(h, start[full], MINIMA) & np.uint64(15)
                low = np.zeros((len(full), MINIMA // 16), dtype=np.uint64)
                for j in range(MINIMA):
                    low[:, j // 16] |= nibbles[j] << np.uint64(4 * (j % 16))
                ids = batch["doc_id"].iloc[part].to_numpy()
                own = [h[start[t] : start[t] + size[t]].tobytes() for t in full]
                yield pd.DataFrame({"id": ids[full], "shingles": own, "low": list(low.view(np.int64))})

    return docs.select("doc_id", "text").mapInPandas(run, "id long, shingles binary, low array<long>")


def least_equal(percent: int, minima: int = MINIMA) -> int:
    """Equal low-bit groups below which a pair at the threshold is six deviations away."""
    p = percent / 100 + (1 - percent / 100) / 16
    return math.floor(minima * p - 6 * math.sqrt(minima * p * (1 - p)))


def _unequal(a: str, b: str) -> Column:
    """How many four-bit groups of two packed signatures differ."""

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    # Over the arrays and not written out by place: the plan is kept many times on the driver.
    return F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda total, n: total + n)


def _similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets, ascending, reach the threshold."""
    a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [_similar(a, b, percent) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[np.array(good, dtype=bool), ["u", "v"]]

    rows = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v"
    )
    # A set that is too small for its partner needs no look at what it holds.
    sizes = F.least(F.length("a"), F.length("b")) * 100 >= F.greatest(F.length("a"), F.length("b")) * percent
    return rows.filter(sizes).select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def _partners(g: pd.DataFrame, least: int, comp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every row of a tile with the other rows it is to be compared with that are, as
    ``comp`` says at that time, of another component and pass the estimate."""
    low = np.stack(g["low"].to_numpy()).view(np.uint64)
    ids, block = g["id"].to_numpy(), g["block"].to_numpy()
    b1, b2 = int(g["b1"].iloc[0]), int(g["b2"].iloc[0])
    for i in np.flatnonzero(block == b1).tolist():
        j = np.flatnonzero((comp != comp[i]) & ((ids > ids[i]) if b1 == b2 else (block == b2)))
        x = low[j] ^ low[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        unequal = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
        yield i, j[MINIMA - unequal >= least]


def _hopeful(least: int):
    """The rows of a tile that have a partner there."""

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(g), dtype=bool)
        for i, j in _partners(g, least, g["component"].to_numpy()):
            found[j] = True
            found[i] |= len(j) > 0
        return g.loc[found, TILED]

    return compare


def _joined(least: int, percent: int):
    """Links of a tile, confirmed on full sets, that connect its components."""

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        ids, sets, comp = g["id"].to_numpy(), g["shingles"].to_numpy(), g["component"].to_numpy().copy()
        us, vs = [], []
        for i, others in _partners(g, least, comp):
            for j in others.tolist():
                if comp[j] != comp[i] and _similar(sets[i], sets[j], percent):
                    comp[comp == comp[j]] = comp[i]
                    us.append(min(ids[i], ids[j]))
                    vs.append(max(ids[i], ids[j]))
        return pd.DataFrame({"u": us, "v": vs}, dtype="int64")

    return compare


def _by_tile(rows: DataFrame, compare, columns: list[str], schema: str) -> DataFrame:
    """``compare`` of the rows of each tile, which meet in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by tile; a tile may go over several batches.
        rest: list[pd.DataFrame] = []
        tile = None
        for batch in batches:
            if not len(batch):
                continue
            key = batch[["bucket", "b1", "b2"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for a, b in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                if rest and tuple(key[a]) != tile:
                    yield compare(pd.concat(rest, ignore_index=True))
                    rest = []
                tile = tuple(key[a])
                rest.append(batch.iloc[a:b])
        if rest:
            yield compare(pd.concat(rest, ignore_index=True))

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2")
    return dealt.select(*columns).mapInPandas(run, schema)


def links(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(features of every document, (u, component) of classes that are linked to a smaller one)."""
    least = least_equal(percent)
    rows = materialize(features(docs, percent), "features")
    named = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("c"))
    in_bands = classes.select(F.col("c.doc_id").alias("id"), F.col("c.n_shingles").alias("n"), F.explode("c.bands").alias("bucket"))
    in_bands = materialize(in_bands, "bands")
    sizes = in_bands.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")
    sizes = sizes.select("bucket", blocks.alias("blocks"))
    in_bands = in_bands.drop("n")
    members = materialize(in_bands.join(sizes, "bucket"), "members")
    # Always a shuffle of the texts: the candidates grow with the documents.
    candidates = members.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    sets = materialize(sets_of(docs.join(candidates, "doc_id", "left_semi")), "sets")
    signs = sets.select("id", "low")

    linked = None
    for stage in range(STAR_ROUNDS):
        members, pivots = _open(members, linked, stage)
        stars = (
            members.join(pivots, "bucket")
            .filter("component <> pivot_component")
            .groupBy("id")
            .agg(F.min(F.struct(_order("pivot", stage).alias("order"), "pivot"))["pivot"].alias("pivot"))
            .select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v"))
            .distinct()
        )
        likely = (
            stars.join(signs.select(F.col("id").alias("u"), F.col("low").alias("lu")), "u")
            .join(signs.select(F.col("id").alias("v"), F.col("low").alias("lv")), "v")
            .filter(F.lit(MINIMA) - _unequal("lu", "lv") >= least)
            .select("u", "v")
        )
        linked = _with(linked, materialize(_confirmed(likely, sets, percent), "links"))

    members, _ = _open(members, linked, STAR_ROUNDS)
    tiles = (
        members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b1", F.least("block", "other"))
        .withColumn("b2", F.greatest("block", "other"))
        .select(*TILED)
    )
    schema = "id long, component long, bucket long, block int, b1 int, b2 int"
    hopeful = _by_tile(tiles.join(signs, "id"), _hopeful(least), [*TILED, "low"], schema)
    new = _by_tile(hopeful.join(sets, "id"), _joined(least, percent), [*TILED, "low", "shingles"], "u long, v long")
    return rows, _with(linked, materialize(new, "links"))


def _order(name: str, stage: int) -> Column:
    """By id at first, later otherwise in every round."""
    return F.col(name) if stage == 0 else F.xxhash64(name, F.lit(stage))


def _open(members: DataFrame, linked: DataFrame | None, stage: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with several components, with their component; one class of each
    such bucket: the smallest at first, any other later."""
    plain = members.select("id", "bucket", "blocks")
    if linked is None:
        placed = plain.withColumn("component", F.col("id"))
    else:
        placed = plain.join(linked.withColumnRenamed("u", "id"), "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
    placed = materialize(placed, "placed")
    order = _order("id", stage)
    pivots = (
        placed.groupBy("bucket")
        .agg(
            F.min(F.struct(order.alias("order"), "id", "component")).alias("p"),
            F.min("component").alias("first"),
            F.max("component").alias("last"),
        )
        .filter("first < last")
        .select("bucket", F.col("p.id").alias("pivot"), F.col("p.component").alias("pivot_component"))
    )
    return materialize(placed.join(pivots.select("bucket"), "bucket"), "open"), pivots


def _with(linked: DataFrame | None, more: DataFrame) -> DataFrame:
    """Components of the links so far and of more links."""
    return components(more if linked is None else more.union(linked.select("u", F.col("component").alias("v"))))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Two documents are linked where 100 * intersection >= ``percent`` * union.
    """
    rows, linked = links(docs, percent)
    own = rows.select("doc_id", "n_shingles", "key1", "key2")
    empty = own.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    named = own.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("key1", "key2").agg(F.min("doc_id").alias("id"))
    classes = classes.join(linked.withColumnRenamed("u", "id"), "id", "left").select(
        "key1", "key2", F.coalesce("component", "id").alias("component_id")
    )
    full = named.join(classes, ["key1", "key2"]).select("doc_id", "n_shingles", "component_id")
    return full.union(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
