"""Learned partitions against all inner products."""

import numpy as np
import pytest

from gleaner.llm import learned_ann


def _table(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>").repartition(4)


def _recall(found, x, queries, k=20):
    """Share of the true neighbours found; every found score must be exact and in order."""
    hits = 0
    for q in queries:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        scores = x @ x[q]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - scores[r.vec_id]) < 1e-9 * max(1, abs(r.score)) and r.vec_id != q for r in mine)
        best = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[i], i))[:k]
        hits += len({r.vec_id for r in mine} & set(best))
    return hits / (k * len(queries))


def _clusters(n, dim=16, centres=40):
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(centres, dim))
    x = middle[draw.integers(0, centres, n)] + 0.15 * draw.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_two_levels_find_clusters_with_little_compared(spark):
    x = _clusters(6000)
    vectors = _table(spark, x)
    queries = vectors.filter("vec_id % 20 = 0")
    found = learned_ann.search(vectors, queries).collect()
    asked = list(range(0, 6000, 20))
    assert _recall(found, x.astype(float), asked) >= 0.9
    assert found[0].trial_recall >= learned_ann.TARGET

    rows, length = learned_ann.usable(vectors, "array<float>")
    parts = learned_ann.learn_parts(rows, 6000)
    assert length == 16 and parts.fine and parts.count > learned_ann.COARSE
    base = learned_ann.index(rows, parts)
    ids = queries.withColumnRenamed("vec_id", "query_id")
    probes, _ = learned_ann.probes_for(base, 6000, ids, parts, 20)
    size = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}
    lists = [r["parts"] for r in learned_ann.routed(ids, parts, probes, "query_id").collect()]
    compared = np.mean([sum(size.get(p, 0) for p in own) for own in lists])
    assert compared < 0.5 * 6000


def test_parts_are_learned_from_few_rows_on(spark):
    x = _clusters(500, dim=8, centres=10)
    vectors = _table(spark, x)
    rows, _ = learned_ann.usable(vectors, "array<float>")
    assert learned_ann.learn_parts(rows, 500).count == 23
    found = learned_ann.search(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    assert _recall(found, x.astype(float), list(range(0, 500, 20))) >= 0.9


def test_equal_vectors_and_lengths(spark, monkeypatch):
    """A third of all rows are equal, queries mostly have another length than the table,
    ids repeat and blocks are tiny."""
    for name, value in (("BLOCK", 50), ("ASKED", 8), ("CHUNK", 32), ("BUFFER", 500)):
        monkeypatch.setattr(learned_ann, name, value)
    x = 1e5 * _clusters(400, dim=8, centres=8)
    x[::3] = x[0]
    vectors = _table(spark, x, [(900, [1.0] * 5), (901, None), (902, [0.0] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8)])
    other = spark.createDataFrame([(1000 + i, [1.0] * 5) for i in range(60)], "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 20 = 0").union(vectors.filter("vec_id = 40")).union(other)
    found = learned_ann.search(vectors, queries, 30).collect()
    asked = list(range(0, 400, 20))
    assert {r.query_id for r in found} == set(asked)
    assert _recall(found, x.astype(float), asked, 30) >= 0.9
    same = [r.vec_id for r in sorted((r for r in found if r.query_id == 60), key=lambda r: r["rank"])]
    assert same == [i for i in range(0, 400, 3) if i != 60][:30]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    vectors = _table(spark, _clusters(3, dim=4, centres=1)[:n])
    assert learned_ann.search(vectors, vectors).count() == n * (n - 1)
    assert learned_ann.search(vectors, vectors.limit(0)).count() == 0
