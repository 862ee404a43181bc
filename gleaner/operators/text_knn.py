"""Rating of a text from the nearest train texts by TF-IDF.

The nearest texts are found from sparse vectors in long form (term, text, weight):

1. A few postings of greatest weight under an asked text's strongest terms bound the score
   of its k-th neighbour from below.
2. Its terms are ordered by what they can add at most, its own weight times the greatest
   weight under the term. The weakest terms that stay below that score even together lead
   to no neighbour on their own: only the others, the prefix, are joined with the table.
3. Asked texts are dealt into groups and the others into slices. A task has one of each, of
   bounded size, and only texts that hold a prefix term of its group. Vectors travel packed,
   and pairs are scored as matrix products, so a pair never becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.features import TfIdf
from gleaner.operators.ranking import sorted_ids, top_k
from gleaner.operators.scoring import best_with_block, dot_scores
from gleaner.operators.skew import hot_keys, skew_join
from gleaner.session import materialize

#: Strongest terms of an asked text, and postings under each, that give first candidates.
FIRST_TERMS = 3
FIRST_POSTINGS = 20
DIGITS = 6
_SLACK = 2 * 10.0**-DIGITS
#: Asked texts of a group and others of a slice, at most, about.
GROUP, SLICE = 20_000, 50_000
#: Asked texts that are scored together, and cells of the matrix they are multiplied with.
ASKED, CELLS = 1024, 4_000_000
#: Groups are marked by the bits of a long; further groups share them.
BITS = 63


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, _codes, _weights): one row a text, its terms ascending."""
    cells = F.array_sort(F.collect_list(F.struct("_code", "weight")))
    return rows.groupBy(key).agg(cells.alias("_c")).select(key, F.col("_c._code").alias("_codes"), F.col("_c.weight").alias("_weights"))


def _dealt(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class _Sparse:
    """Sparse vectors of some texts, by ascending key."""

    def __init__(self, parts: list[pd.DataFrame], key: str):
        rows = pd.concat(parts).sort_values(key, kind="stable")
        self.keys = rows[key].to_numpy()
        self.ends = np.concatenate(([0], np.cumsum(rows["_codes"].map(len).to_numpy())))
        self.codes = np.concatenate(rows["_codes"].to_numpy())
        self.weights = np.concatenate(rows["_weights"].to_numpy())

    def dense(self, first: int, last: int, columns: np.ndarray) -> np.ndarray:
        """The texts from place ``first`` to ``last`` over some terms, ascending."""
        part = slice(self.ends[first], self.ends[last])
        place = np.minimum(np.searchsorted(columns, self.codes[part]), len(columns) - 1)
        kept = columns[place] == self.codes[part]
        row = np.repeat(np.arange(last - first), np.diff(self.ends[first : last + 1]))
        # A term that comes twice counts twice.
        cells = np.bincount(row[kept] * len(columns) + place[kept], self.weights[part][kept], (last - first) * len(columns))
        return cells.reshape(last - first, len(columns))


def _neighbours(asked: _Sparse, held: _Sparse, k: int) -> Iterator[pd.DataFrame]:
    """The k best of ``held`` for each of ``asked``, scores above 0 only."""
    for at in range(0, len(asked.keys), ASKED):
        end = min(at + ASKED, len(asked.keys))
        columns = np.unique(asked.codes[asked.ends[at] : asked.ends[end]])
        vectors, best = asked.dense(at, end, columns), None
        step = max(1, CELLS // len(columns))
        for first in range(0, len(held.keys), step):
            last = min(first + step, len(held.keys))
            best = best_with_block(vectors, held.keys[first:last], held.dense(first, last, columns), k, DIGITS, dot_scores, best)
        if best is not None:
            best = best[np.round(best["score"], DIGITS) > 0]
            yield pd.DataFrame({"user": asked.keys[at:end][best["user"].to_numpy(dtype=np.int64)], "item": best["item"], "score": best["score"]})


def _matched(k: int):
    """Best pairs of the cells of a task, rows coming by cell, held texts before asked ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, parts, held = None, [], None
        waiting: list[pd.DataFrame] = []

        def answer() -> Iterator[pd.DataFrame]:
            if waiting and held is not None:
                yield from _neighbours(_Sparse(waiting, "user"), held, k)
            waiting.clear()

        for batch in batches:
            mark = batch[["_group", "_slice", "_kind"]].ne(batch[["_group", "_slice", "_kind"]].shift()).any(axis=1).cumsum()
            for _, part in batch.groupby(mark.to_numpy(), sort=False):
                here = (part["_group"].iloc[0], part["_slice"].iloc[0])
                if here != cell:
                    yield from answer()
                    cell, parts, held = here, [], None
                if part["_kind"].iloc[0] == 0:
                    parts.append(part)
                    continue
                if parts:
                    held, parts = _Sparse(parts, "item"), []
                waiting.append(part)
                if sum(map(len, waiting)) >= ASKED:
                    yield from answer()
        yield from answer()

    return run


def nearest_by_terms(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(user, item, score, rank): the k items of largest dot product, scores above 0 only.

    ``asked`` (user, term, weight) and ``held`` (item, term, weight) are sparse vectors
    without negative weights. Ranked by the score rounded to ``DIGITS`` places, ties by item.
    """
    asked, held = materialize(asked, "asked-terms"), materialize(held, "held-terms")
    tops = materialize(held.groupBy("term").agg(F.max("weight").alias("_top")), "term-tops")
    reach = asked.join(tops, "term").withColumn("_reach", F.col("weight") * F.col("_top"))
    by_reach = Window.partitionBy("user").orderBy(F.col("_reach").desc(), "term")
    ordered = materialize(reach.withColumn("_place", F.row_number().over(by_reach)), "terms-by-reach")

    leading = top_k(held, "term", [F.col("weight").desc(), F.col("item")], FIRST_POSTINGS).select("term", "item", F.col("weight").alias("_b"))
    # What a few terms add is no more than the score.
    first = ordered.filter(F.col("_place") <= FIRST_TERMS).join(leading, "term")
    first = first.groupBy("user", "item").agg(F.sum(F.col("weight") * F.col("_b")).alias("score"))
    best = top_k(first, "user", [F.col("score").desc()], k)
    least = best.filter(F.col("rank") == k).select("user", F.col("score").alias("_least"))

    # What the terms from a place on can add together.
    rest = F.sum("_reach").over(by_reach.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    bounded = ordered.join(least, "user", "left").withColumn("_least", F.coalesce("_least", F.lit(0.0)) - _SLACK).withColumn("_rest", rest)
    prefix = bounded.filter(F.col("_rest") >= F.col("_least")).select("user", "term")

    users, items = ordered.select("user").distinct().count(), held.select("item").distinct().count()
    groups = max(1, math.ceil(users / GROUP))
    slices = max(1, math.ceil(items / SLICE), math.ceil(2 * held.sparkSession.sparkContext.defaultParallelism / groups))
    bit = F.lit(1).cast("long") if groups == 1 else F.expr(f"shiftleft(1L, cast(pmod(xxhash64(user), {groups}) % {BITS} as int))")
    marked = materialize(prefix.select("term", bit.alias("_bit")).groupBy("term").agg(F.bit_or("_bit").alias("_bits")), "prefix-terms")
    met = skew_join(marked, held.select("term", "item"), "term", ["term"], hot_keys(marked, held, "term"))
    wanted = met.groupBy("item").agg(F.bit_or("_bits").alias("_bits"))

    codes = materialize(sorted_ids(tops, "term", "_code").select("term", "_code"), "term-codes")
    kind = f"user {asked.schema['user'].dataType.simpleString()}, item {held.schema['item'].dataType.simpleString()}"
    numbers = F.array(*[F.lit(g) for g in range(groups)])
    theirs = _packed(held.join(codes, "term"), "item").join(wanted, "item").select("*", F.explode(numbers).alias("_group"))
    theirs = theirs.filter(F.getbit("_bits", F.col("_group") % BITS) == 1).select(
        "_group", _dealt("item", slices).alias("_slice"), F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["user"].dataType).alias("user"), "item", "_codes", "_weights"
    )
    mine = _packed(ordered.join(codes, "term"), "user").select(
        _dealt("user", groups).alias("_group"),
        F.explode(F.array(*[F.lit(x) for x in range(slices)])).alias("_slice"),
        F.lit(1).alias("_kind"),
        "user",
        F.lit(None).cast(held.schema["item"].dataType).alias("item"),
        "_codes",
        "_weights",
    )
    cells = theirs.unionByName(mine).repartitionById(groups * slices, F.col("_group") * slices + F.col("_slice"))
    found = cells.sortWithinPartitions("_group", "_slice", "_kind").mapInPandas(_matched(k), f"{kind}, score double")
    return top_k(found, "user", [F.round("score", DIGITS).desc(), F.col("item")], k)


def neighbour_ratings(
    train: DataFrame, test: DataFrame, key: str, text: str, rating: str, k: int = 5, max_terms: int = 1000
) -> DataFrame:
    """(key, rating, estimate): mean rating of the k nearest train texts.

    On unit vectors the smallest Euclidean distance is the largest dot product. A text
    that shares terms with fewer than k others is filled up with those of smallest key,
    all equally far. ``key`` names a row of either side.
    """
    model = TfIdf.fit(train, text, max_terms)
    asked = model.weights(test, text, [key]).withColumnRenamed(key, "user")
    held = model.weights(train, text, [key]).withColumnRenamed(key, "item")
    near = materialize(nearest_by_terms(asked, held, k).select("user", "item"), "near-texts")
    # At most k found keys can be among the smallest 2 k, so k others are left.
    smallest = [r[0] for r in train.select(key).orderBy(key).limit(2 * k).collect()]
    users = test.select(F.col(key).alias("user")).distinct()
    counts = near.groupBy("user").agg(F.count("*").alias("_n"))
    short = users.join(counts, "user", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_n") < k)
    others = F.explode(F.array(*[F.lit(x) for x in smallest]).cast(f"array<{train.schema[key].dataType.simpleString()}>"))
    spare = short.withColumn("item", others).join(near, ["user", "item"], "left_anti")
    place = F.row_number().over(Window.partitionBy("user").orderBy("item"))
    filled = spare.withColumn("_p", place).filter(F.col("_p") <= k - F.col("_n")).select("user", "item")
    rated = near.unionByName(filled).join(train.select(F.col(key).alias("item"), F.col(rating).alias("_r")), "item")
    means = rated.groupBy("user").agg(F.avg("_r").alias("estimate"))
    return test.select(key, rating).join(means.withColumnRenamed("user", key), key)


def mean_squared_error(rows: DataFrame, actual: str, predicted: str = "estimate") -> DataFrame:
    gap = F.col(actual) - F.col(predicted)
    return rows.agg(F.avg(gap * gap).alias("mse"))
