"""Global ranks, integer ids, exact-size samples, splits and top-k.

None of these orders a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.hashing import below, draw
from gleaner.session import materialize

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def global_rank(df: DataFrame, order_by: list[str], rank: str = "rank") -> DataFrame:
    """Add a 0-based rank over all rows, ordered by ``order_by`` (unique together).

    Rows are range-partitioned and sorted; each row's position in its partition is
    written down, and partition offsets come from one row count per partition. The
    table is written first because range bounds are sampled and must not move
    between the count and the use.
    """
    keys = [F.col(c) for c in order_by]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = materialize(placed, "rank").withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition, so this window and the broadcast are small by construction.
    offsets = sizes.select(
        "_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start")
    )
    position = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_start") + position)
        .drop("_slot", "_part", "_start")
    )


def sorted_ids(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """(value, id): dense 0-based ids of the distinct non-null values, in sorted order."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return global_rank(values, [column], id_column)


def first_seen_ids(df: DataFrame, column: str, order_by: list[str], id_column: str) -> DataFrame:
    """(value, id): dense 0-based ids in order of first appearance by ``order_by``."""
    first = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(F.struct(*order_by)).alias("_first"))
        .select(column, *[F.col("_first")[c].alias(f"_k{i}") for i, c in enumerate(order_by)])
    )
    keys = [f"_k{i}" for i in range(len(order_by))] + [column]
    return global_rank(first, keys, id_column).select(column, id_column)


def encode(df: DataFrame, ids: DataFrame, column: str, id_column: str, missing: int = -1) -> DataFrame:
    """Attach the id of ``column``; a null value gets ``missing``."""
    return df.join(ids, column, "left").withColumn(
        id_column, F.coalesce(F.col(id_column), F.lit(missing).cast("long"))
    )


def decode(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Attach the original value of an integer id."""
    return df.join(ids, id_column, "left")


def exact_cutoffs(
    df: DataFrame, key: Column, shares: Mapping[str, float], seed: int = 42, prefix: int = 5
) -> dict[str, tuple[str, str] | None]:
    """For each step the (draw, key) of the last row in its ``int(share * n)`` sample.

    Each step ranks rows by its own draw. A histogram over the first ``prefix`` hex
    digits finds the one bucket holding the last row, and only that bucket's rows
    (about n / 16**prefix) are ordered. One (draw, key) pair per step reaches the
    driver. ``key`` must be unique.
    """
    steps = sorted(shares)
    spread = df.select(key.alias("_key")).select(
        "_key", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step")
    )
    spread = spread.withColumn("_draw", draw(seed, F.col("step"), F.col("_key")))
    share_of = F.create_map(*[x for s in steps for x in (F.lit(s), F.lit(float(shares[s])))])
    by_step = Window.partitionBy("step")
    histogram = (
        spread.groupBy("step", F.substring("_draw", 1, prefix).alias("_head"))
        .agg(F.count("*").alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(by_step.orderBy("_head")))
        .withColumn("_want", F.floor(F.sum("_rows").over(by_step) * share_of[F.col("step")]))
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_rows") < F.col("_want")))
        .select("step", "_head", (F.col("_want") - F.col("_upto") + F.col("_rows")).alias("_left"))
    )
    edges = histogram.collect()  # at most one row per step
    cuts: dict[str, tuple[str, str] | None] = {s: None for s in steps}
    if not edges:
        return cuts
    edge = F.lit(False)
    wanted = F.lit(None).cast("long")
    for row in edges:
        here = F.col("step") == F.lit(row["step"])
        edge = edge | (here & F.col("_draw").startswith(row["_head"]))
        wanted = F.when(here, F.lit(row["_left"])).otherwise(wanted)
    last = (
        spread.filter(edge)
        .withColumn("_pos", F.row_number().over(by_step.orderBy("_draw", "_key")))
        .filter(F.col("_pos") == wanted)
        .select("step", "_draw", "_key")
    )
    for row in last.collect():
        cuts[row["step"]] = (row["_draw"], row["_key"])
    return cuts


def in_sample(cut: tuple[str, str] | None, step: str, key: Column, seed: int = 42) -> Column:
    """Membership in the exact sample that ``cut`` describes."""
    if cut is None:
        return F.lit(False)
    digest = draw(seed, step, key)
    return (digest < F.lit(cut[0])) | ((digest == F.lit(cut[0])) & (key <= F.lit(cut[1])))


def exact_sample(df: DataFrame, key: Column, share: float, step: str = "sample", seed: int = 42) -> DataFrame:
    """``int(share * n)`` rows without replacement."""
    cut = exact_cutoffs(df, key, {step: share}, seed)[step]
    return df.filter(in_sample(cut, step, key, seed))


def fixed_sample(df: DataFrame, key: Column, size: int, seed: int = 42) -> DataFrame:
    """``min(size, n)`` rows: the smallest draws, taken with a bounded heap per task."""
    return (
        df.withColumn("_draw", draw(seed, "fixed", key))
        .withColumn("_key", key)
        .orderBy("_draw", "_key")
        .limit(size)
        .drop("_draw", "_key")
    )


def train_test(
    df: DataFrame, key: Column, test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split rows by their draw: repeatable under retries, sizes approximate."""
    is_test = below(draw(seed, "split", key), test_share)
    return df.filter(~is_test), df.filter(is_test)


def exact_train_test(
    df: DataFrame, key: Column, test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split with exactly ``int(test_share * n)`` test rows."""
    cut = exact_cutoffs(df, key, {"split": test_share}, seed)["split"]
    is_test = in_sample(cut, "split", key, seed)
    return df.filter(~is_test), df.filter(is_test)


def top_k(df: DataFrame, group: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1.

    The filter on the row number lets Spark keep only k rows per group in every
    task before the shuffle, so a hot group costs no more than others.
    """
    groups = [group] if isinstance(group, str) else group
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
