"""Order statistics by brackets against numpy, with brackets forced to be narrow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import quantiles

SHAPES = {
    "spread": lambda draw: draw.normal(0, 1e6, 40_000),
    "ties": lambda draw: np.repeat([1.0, 2.0, 2.5, 9.0], [15_000, 10_000, 3, 15_000]),
    "mixed": lambda draw: np.concatenate([np.full(20_000, 5.0), draw.random(20_000) * 10, np.full(9_000, -0.5)]),
    "two ends": lambda draw: np.concatenate([np.full(20_000, -1.0), draw.random(500), np.full(20_000, 2.0)]),
    "endless": lambda draw: np.concatenate([[math.inf] * 30, [-math.inf] * 9_000, draw.random(11_000)]),
    "one": lambda draw: np.array([3.0]),
    "equal": lambda draw: np.full(30_000, 7.0),
}


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(12)
    found = {}
    for name, make in SHAPES.items():
        values = make(draw)
        draw.shuffle(values)
        cells = [(float(v),) for v in values] + [(None,)] * 17
        found[name] = (values, spark.createDataFrame(cells, "x double").repartition(5))
    return found


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("limit", [5, 50_000])
def test_quantiles_of_many_shapes(tables, name, limit):
    values, df = tables[name]
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    stats = quantiles.column_stats(df, {"x": F.col("x")}, probabilities, limit)["x"]
    assert (stats.rows, stats.nulls) == (len(values), 17)
    ordered = np.sort(values)
    for p in probabilities:
        at = p * (len(values) - 1)
        low, share = int(at), at - int(at)
        expected = ordered[low] if share == 0 else ordered[low] * (1 - share) + ordered[low + 1] * share
        assert stats.quantiles[p] == expected


@pytest.mark.parametrize("name", [n for n in SHAPES if n != "endless"])
@pytest.mark.parametrize("limit", [5, 50_000])
def test_filled_column_from_the_same_search(tables, name, limit):
    values, df = tables[name]
    before, after = quantiles.stats_before_and_after_fill(df, {"x": F.col("x")}, [0.25, 0.5, 0.75], limit)["x"]
    median = float(np.median(values))
    assert before.quantiles[0.5] == pytest.approx(median, rel=1e-12)
    filled = df.select(F.coalesce("x", F.lit(before.quantiles[0.5])).alias("x"))
    again = quantiles.column_stats(filled, {"x": F.col("x")}, [0.25, 0.5, 0.75], limit)["x"]
    assert after.quantiles == again.quantiles
    assert (after.rows, after.nulls) == (len(values) + 17, 0)
    assert after.mean == pytest.approx(again.mean, rel=1e-9)


def test_several_columns_at_once(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), None, "x") for i in range(1000)], "a double, b double, c double, column string")
    stats = quantiles.column_stats(df, {c: F.col(c) for c in "abc"}, [0.5], 20)
    assert (stats["a"].quantiles[0.5], stats["b"].quantiles[0.5]) == (499.5, 1.0)
    assert (stats["c"].rows, stats["c"].nulls, stats["c"].quantiles, stats["c"].mean) == (0, 1000, {}, None)
    empty = quantiles.column_stats(df.limit(0), {"a": F.col("a")}, [0.5])["a"]
    assert (empty.rows, empty.nulls, empty.quantiles) == (0, 0, {})


def test_refuted_brackets_are_searched_beside(spark, monkeypatch):
    """Where a sketch proposes the wrong places the counts still lead to the right rank."""
    read, calls = quantiles._sketched, []

    def wrong(placed):
        calls.append(1)
        out = read(placed)
        return out.withColumn("grid", F.transform("grid", lambda x: x + 3_000)) if len(calls) == 1 else out

    monkeypatch.setattr(quantiles, "_sketched", wrong)
    df = spark.range(30_000).select(F.col("id").cast("double").alias("x"))
    stats = quantiles.column_stats(df, {"x": F.col("x")}, [0.25, 0.5], 500)["x"]
    assert stats.quantiles == {0.25: 7499.75, 0.5: 14999.5}
    assert len(calls) > 1


def test_no_pass_shuffles_the_column(spark):
    df = spark.range(200_000).select(F.col("id").cast("double").alias("x"))
    placed = quantiles._placed(df, {"x": F.col("x")}, {"x": [(1_000.0, 1_300.0)]})
    counted = quantiles._counted(placed).collect()
    assert len(counted) == 299 + 4
    assert sum(r["rows"] for r in counted) == 200_000
    assert quantiles._sketched(placed).count() == 5
