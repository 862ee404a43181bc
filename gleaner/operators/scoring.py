"""Every user against every item, keeping only each user's best items.

Items are cut into blocks of bounded size, those of greatest length first. A block goes to
every task, and users are read past it with the best items they have so far; scores are
matrix products, so the full score table never exists as rows. By Cauchy and Schwarz a
user's length times that of the longest item still to come bounds what can follow: users
whose k-th best score is above that are done and are not read again. Users are dealt out
once; an item table of one block needs one pass over them.

Dot products and cosines are screened in single precision: with k items in hand, only items
whose single-precision score comes within the error of such a product of the k-th best are
scored in double precision and ranked. Other scorers rank every item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.vectors import as_doubles, norm
from gleaner.session import materialize

BROADCAST_BYTES = 128 * 1024 * 1024
CHUNK_CELLS = 4_000_000
#: Items ranked without a screen to begin with; each screen then covers as many as came before.
FIRST_ITEMS = 1024
#: Users that are screened together, and items of one product of theirs.
SCREEN_USERS, SCREEN_ITEMS = 512, 4096
#: A user with more than one in so many items past the screen has them all ranked.
CROWD = 16

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine_scores(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Cosine of each user row with each item row; zero vectors score 0."""
    lengths = np.linalg.norm(users, axis=1)[:, None] * np.linalg.norm(items, axis=1)[None, :]
    return np.divide(users @ items.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)


def dot_scores(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    return users @ items.T


def nothing_of(kind: str) -> Column:
    """An empty array of the array type ``kind``, null of any other.

    Lists that are null are slow on their way to Python: after each row, Spark's Arrow writer
    goes over those at the end of the batch once more.
    """
    return F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _best_of_block(
    user_ids: np.ndarray,
    users: np.ndarray,
    item_ids: np.ndarray,
    items: np.ndarray,
    k: int,
    digits: int,
    scorer: Scorer,
    seen: list | None = None,
) -> pd.DataFrame:
    """The k best items of this block per user, without the user's ``seen`` items, and their places.

    Items are sorted by id, so a stable sort breaks ties by id.
    """
    out_users, out_items, out_scores, out_places = [], [], [], []
    step = max(1, CHUNK_CELLS // max(1, len(item_ids)))
    for start in range(0, len(user_ids), step):
        scores = scorer(users[start : start + step], items)
        ranked = -np.round(scores, digits)
        for row, owned in enumerate(seen[start : start + step] if seen is not None else ()):
            if owned is not None and len(owned):
                spots = np.minimum(np.searchsorted(item_ids, owned), len(item_ids) - 1)
                ranked[row, spots[item_ids[spots] == owned]] = np.inf
        if k < ranked.shape[1]:
            bound = np.partition(ranked, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(ranked), np.inf)
        for row in range(len(ranked)):
            near = np.flatnonzero((ranked[row] <= bound[row]) & np.isfinite(ranked[row]))
            best = near[np.argsort(ranked[row][near], kind="stable")[:k]]
            out_users.append(np.repeat(user_ids[start + row], len(best)))
            out_items.append(item_ids[best])
            out_scores.append(scores[row][best])
            out_places.append(best)
    return pd.DataFrame(
        {
            "user": np.concatenate(out_users),
            "item": np.concatenate(out_items),
            "score": np.concatenate(out_scores),
            "place": np.concatenate(out_places),
        }
    )


#: What a scorer can give at most, from users' lengths and the longest item's length; a
#: scorer without an entry goes through all blocks.
BOUNDS: dict[Scorer, Callable[[np.ndarray, float], np.ndarray]] = {
    dot_scores: lambda users, item: users * item,
    cosine_scores: lambda users, item: np.where((users > 0) & (item > 0), 1.0, 0.0),
}


def _screened(
    vectors: np.ndarray,
    item_ids: np.ndarray,
    items: np.ndarray,
    light: np.ndarray,
    k: int,
    digits: int,
    scorer: Scorer,
    seen: list,
    before: pd.DataFrame | None,
) -> pd.DataFrame:
    """The k best of each user's items ``before`` and of this block, by the user's place.

    ``light`` holds the items in single precision, divided by their lengths (for cosines) or
    by the greatest one (for dot products).
    """
    by_length = scorer is cosine_scores
    longest = 1.0 if by_length else float(np.linalg.norm(items, axis=1).max())
    lengths = np.linalg.norm(vectors, axis=1)
    usable = np.isfinite(lengths) & (lengths > 0) & np.isfinite(longest) & (longest > 0)
    scale = np.where(usable, lengths, 1.0)
    thin = np.where(usable[:, None], vectors / scale[:, None], 0.0).astype(np.float32)
    # What a score is divided by in the screen, and how far a screened score can be off.
    unit = np.where(usable, 1.0 if by_length else scale * longest, 1.0)
    off = 2.0 * (vectors.shape[1] + 8) * 2.0**-24
    slack = 2 * off + 2 * 10.0**-digits / unit
    owned = [None if x is None else np.sort(np.asarray(x)) for x in seen]
    out = []
    for start in range(0, len(vectors), SCREEN_USERS):
        rows = slice(start, min(start + SCREEN_USERS, len(vectors)))
        mine, base = vectors[rows], start
        held = None if before is None else before[(before["user"] >= rows.start) & (before["user"] < rows.stop)]
        at, size = 0, FIRST_ITEMS
        while at < len(item_ids):
            stop = min(at + size, len(item_ids))
            least = np.full(len(mine), -np.inf)
            if held is not None:
                ranks = held.groupby("user").cumcount().to_numpy()
                last = held[ranks == k - 1]
                least[last["user"].to_numpy() - base] = np.round(last["score"].to_numpy(), digits)
            some = np.flatnonzero(usable[rows] & np.isfinite(least))
            limit = (least / unit[rows] - slack[rows])[some].astype(np.float32)[:, None]
            lean = thin[rows][some]
            found = [] if held is None else [held]
            rest = np.ones(len(mine), dtype=bool)
            rest[some] = False
            for left in range(at, stop, SCREEN_ITEMS) if len(some) else ():
                right = min(left + SCREEN_ITEMS, stop)
                past = lean @ light[left:right].T >= limit
                hit, col = np.divmod(np.flatnonzero(past), right - left)
                crowded = np.bincount(hit, minlength=len(some)) > max(4 * k, (right - left) // CROWD)
                if crowded.any():
                    places = some[crowded]
                    lists = [seen[base + i] for i in places]
                    whole = _best_of_block(base + places, mine[places], item_ids[left:right], items[left:right], k, digits, scorer, lists)
                    found.append(_rescored(whole, left, base, mine, items, item_ids, scorer))
                    hit, col = hit[~crowded[hit]], col[~crowded[hit]]
                if len(hit):
                    found.append(_scored_pairs(some[hit], col + left, base, mine, items, item_ids, scorer, owned))
            if rest.any():
                places = np.flatnonzero(rest)
                lists = [seen[base + i] for i in places]
                whole = _best_of_block(base + places, mine[places], item_ids[at:stop], items[at:stop], k, digits, scorer, lists)
                found.append(_rescored(whole, at, base, mine, items, item_ids, scorer))
            held = _first_k(pd.concat(found, ignore_index=True), k, digits) if found else None
            at, size = stop, max(size, stop)
        if held is not None:
            out.append(held)
    return pd.concat(out, ignore_index=True)


def _rescored(found: pd.DataFrame, first: int, base: int, users: np.ndarray, items: np.ndarray, item_ids: np.ndarray, scorer: Scorer) -> pd.DataFrame:
    """The same pairs, scored one by one: a score does not depend on how items are cut into blocks."""
    rows = found["user"].to_numpy(dtype=np.int64) - base
    return _scored_pairs(rows, found["place"].to_numpy(dtype=np.int64) + first, base, users, items, item_ids, scorer, [])


def best_with_block(
    vectors: np.ndarray, item_ids: np.ndarray, items: np.ndarray, k: int, digits: int, scorer: Scorer, before: pd.DataFrame | None = None
) -> pd.DataFrame:
    """(user, item, score): the k best of each user's items ``before`` (what an earlier call gave)
    and of this block, by the user's place. Items are sorted by id."""
    light = _light(items, scorer)
    if light is not None:
        return _screened(vectors, item_ids, items, light, k, digits, scorer, [None] * len(vectors), before)
    found = _best_of_block(np.arange(len(vectors)), vectors, item_ids, items, k, digits, scorer).drop(columns="place")
    return _first_k(found if before is None else pd.concat([before, found], ignore_index=True), k, digits)


def _scored_pairs(
    rows: np.ndarray, columns: np.ndarray, base: int, users: np.ndarray, items: np.ndarray, item_ids: np.ndarray, scorer: Scorer, owned: list
) -> pd.DataFrame:
    """Scores of single pairs in double precision, without items the users own."""
    if any(x is not None for x in owned):
        ids, new = item_ids[columns], np.ones(len(rows), dtype=bool)
        # ``rows`` ascend.
        ends = np.flatnonzero(np.diff(rows, append=-1) != 0) + 1
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            mine = owned[base + rows[a]]
            if mine is not None and len(mine):
                spots = np.minimum(np.searchsorted(mine, ids[a:b]), len(mine) - 1)
                new[a:b] = mine[spots] != ids[a:b]
        rows, columns = rows[new], columns[new]
    scores = np.empty(len(rows))
    step = max(1, CHUNK_CELLS // max(1, users.shape[1]))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        a, b = users[rows[part]], items[columns[part]]
        scores[part] = np.einsum("ij,ij->i", a, b)
        if scorer is cosine_scores:
            lengths = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            scores[part] = np.divide(scores[part], lengths, out=np.zeros_like(lengths), where=lengths > 0)
    return pd.DataFrame({"user": base + rows, "item": item_ids[columns], "score": scores})


def _first_k(found: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """The k best rows of each user, ranked by the rounded score, ties by item."""
    users = found["user"].to_numpy(dtype=np.int64)
    items = found["item"].to_numpy()
    if items.dtype == object:
        items = pd.factorize(items, sort=True)[0]
    order = np.lexsort((items, -np.round(found["score"].to_numpy(dtype=np.float64), digits), users))
    ranked = found.iloc[order]
    users = users[order]
    place = np.arange(len(users)) - np.searchsorted(users, users)
    return ranked[place < k].reset_index(drop=True)


def _light(items: np.ndarray, scorer: Scorer) -> np.ndarray | None:
    """Items for the screen of ``_screened``; None for scorers and vectors without one."""
    if scorer not in (dot_scores, cosine_scores):
        return None
    lengths = np.linalg.norm(items, axis=1)
    if not np.isfinite(lengths).all():
        return None
    by = lengths if scorer is cosine_scores else np.full(len(items), lengths.max(initial=0.0))
    return np.divide(items, by[:, None], out=np.zeros_like(items), where=by[:, None] > 0).astype(np.float32)


def best_items(
    users: DataFrame,
    items: DataFrame,
    k: int = 10,
    scorer: Scorer = cosine_scores,
    digits: int = 6,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """(user, item, score, rank) from users(user, vector), one row a user, and items(item, vector).

    Ranked by the score rounded to ``digits`` places, ties by item. Pairs in
    ``seen(user, item)`` are left out. A user's seen items travel as one list per
    item block, so a list is never longer than a block. A block holds
    ``broadcast_bytes`` of vectors, about, or ``block_rows`` items if there are several.
    """
    spark = users.sparkSession
    item_type = items.schema["item"].dataType
    schema = T.StructType(
        [
            T.StructField("user", users.schema["user"].dataType),
            T.StructField("item", item_type),
            T.StructField("score", T.DoubleType()),
        ]
    )
    extent = items.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if not extent["n"]:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    blocks, longest = _blocks(items, extent["n"], extent["dim"], broadcast_bytes, block_rows)
    if seen is not None:
        seen = seen.select("user", F.col("item").cast(item_type).alias("item"))
        if len(longest) > 1:
            seen = materialize(seen.join(blocks.select("item", "block"), "item"), "seen")
    width = spark.sparkContext.defaultParallelism
    asked = users.select("user", as_doubles("vector").alias("vector"))
    nothing = [nothing_of(f"array<{item_type.simpleString()}>").alias("items"), nothing_of("array<double>").alias("scores")]
    asked = asked.select("user", "vector", *nothing)
    state = T.StructType(
        [
            T.StructField("user", users.schema["user"].dataType),
            T.StructField("vector", T.ArrayType(T.DoubleType())),
            T.StructField("items", T.ArrayType(item_type)),
            T.StructField("scores", T.ArrayType(T.DoubleType())),
            T.StructField("open", T.BooleanType()),
        ]
    )
    settled = None
    for number in range(len(longest)):
        mine = blocks if len(longest) == 1 else blocks.filter(F.col("block") == number)
        there = seen if seen is None or len(longest) == 1 else seen.filter(F.col("block") == number)
        # One block of items, of bounded size.
        ids, matrix = _collected(mine.select("item", "vector"))
        order = np.argsort(ids, kind="stable")
        shared = spark.sparkContext.broadcast((ids[order], matrix[order]))
        rest = max(longest[number + 1 :], default=None)
        given = _with_seen(asked, there)
        if number == 0 or there is not None:
            given = _dealt(given, width)
        passed = given.mapInPandas(_past_block(shared, k, digits, scorer, rest), state)
        if number < len(longest) - 1:
            passed = materialize(passed, "users-past-block")
            asked = passed.filter("open").select("user", "vector", "items", "scores")
            passed = passed.filter("NOT open")
        settled = passed if settled is None else settled.unionByName(passed)
        if number < len(longest) - 1 and asked.isEmpty():
            break
    best = F.posexplode(F.arrays_zip(F.col("items").alias("item"), F.col("scores").alias("score")))
    ranked = settled.select("user", best.alias("_p", "_b"))
    return ranked.select("user", F.col("_b.item").alias("item"), F.col("_b.score").alias("score"), (F.col("_p") + 1).alias("rank"))


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one block, without a Python object for each number."""
    table = rows.toArrow()
    ids = table.column("item").to_pandas().to_numpy()
    cells = table.column("vector").combine_chunks()
    if cells.null_count:
        return ids, _stack(pd.Series(cells.to_pylist()))
    return ids, cells.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _blocks(items: DataFrame, n: int, dim: int, block_bytes: int, block_rows: int | None) -> tuple[DataFrame, list[float]]:
    """(item, vector[, block]), the longest vectors in the first block; the greatest length of each block."""
    items = items.select("item", as_doubles("vector").alias("vector"))
    if n * dim * 8 <= block_bytes:
        return items, [0.0]
    count = -(-n // (block_rows or max(1, block_bytes // (dim * 8))))
    ordered = items.withColumn("_length", norm(F.col("vector"))).repartitionByRange(count, F.col("_length").desc(), F.col("item"))
    placed = materialize(ordered.withColumn("_part", F.spark_partition_id()), "item-blocks")
    # One row a block.
    parts = placed.groupBy("_part").agg(F.max("_length").alias("longest")).orderBy("_part").collect()
    numbers = {r["_part"]: i for i, r in enumerate(parts)}
    pairs = placed.sparkSession.createDataFrame(list(numbers.items()), "_part int, block int")
    named = placed.join(F.broadcast(pairs), "_part").select("item", "vector", "block")
    return named, [r["longest"] for r in parts]


def _with_seen(users: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Add the list ``seen`` of a user's items (of one item block), empty without any."""
    if seen is None:
        return users.withColumn("seen", nothing_of("array<long>"))
    lists = seen.groupBy("user").agg(F.collect_set("item").alias("seen"))
    none = nothing_of(lists.schema["seen"].dataType.simpleString())
    return users.join(lists, "user", "left").withColumn("seen", F.coalesce("seen", none))


def _dealt(users: DataFrame, width: int) -> DataFrame:
    """Users over ``width`` tasks: few bytes per user but much arithmetic, so every core is used.

    By number, because a repartition by the column is left out where users come from a join
    on it, whose tasks are merged by their bytes.
    """
    return users.repartitionById(width, F.pmod(F.xxhash64("user"), F.lit(width)).cast("int"))


def _past_block(shared, k: int, digits: int, scorer: Scorer, rest: float | None):
    """Users with the best of their items so far and of one block; ``rest`` is the greatest
    length of the items after it, None after the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_ids, matrix = shared.value
        light = _light(matrix, scorer)
        for batch in batches:
            if not len(batch):
                continue
            vectors = _stack(batch["vector"])
            places = np.arange(len(batch))
            before, owned = _so_far(batch), [x if len(x) else None for x in batch["seen"]]
            if light is not None:
                found = _screened(vectors, item_ids, matrix, light, k, digits, scorer, owned, before)
            else:
                found = _best_of_block(places, vectors, item_ids, matrix, k, digits, scorer, owned)
                if before is not None:
                    found = pd.concat([before, found], ignore_index=True)
            found["order"] = -np.round(found["score"].to_numpy(dtype=np.float64), digits)
            found = found.sort_values(["user", "order", "item"], kind="stable")
            found = found[found.groupby("user").cumcount() < k]
            ends = np.searchsorted(found["user"].to_numpy(dtype=np.int64), np.arange(len(batch) + 1))
            ids, scores = found["item"].to_numpy(), found["score"].to_numpy(dtype=np.float64)
            cut = lambda x: [x[a:b] for a, b in zip(ends, ends[1:], strict=False)]  # noqa: B023, E731
            full = np.diff(ends) >= k
            open_ = np.full(len(batch), rest is not None)
            if rest is not None and scorer in BOUNDS:
                most = BOUNDS[scorer](np.linalg.norm(vectors, axis=1), rest) * (1 + 1e-9) + 1e-12
                kth = np.full(len(batch), -np.inf)
                kth[full] = -found["order"].to_numpy()[ends[1:][full] - 1]
                # An equal score could still come with a smaller id.
                open_ = np.round(most, digits) >= kth
            yield pd.DataFrame({"user": batch["user"].array, "vector": batch["vector"].array, "items": cut(ids), "scores": cut(scores), "open": open_})

    return run


def _so_far(batch: pd.DataFrame) -> pd.DataFrame | None:
    """The best items that users come with, one row each, by the user's place."""
    sizes = [len(x) for x in batch["items"]]
    if not any(sizes):
        return None
    return pd.DataFrame(
        {"user": np.repeat(np.arange(len(batch)), sizes), "item": np.concatenate(batch["items"].to_numpy()), "score": np.concatenate(batch["scores"].to_numpy())}
    )
