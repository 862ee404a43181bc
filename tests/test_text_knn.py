"""Nearest texts over the inverted table against all dot products."""

import numpy as np
import pytest

from gleaner.operators import text_knn


def _vectors(draw, count, terms, common):
    """Sparse unit vectors; term 0 is in nearly all of them."""
    out = []
    for _ in range(count):
        held = {int(t) for t in draw.choice(terms, draw.integers(1, 8), replace=False)} | ({0} if draw.random() < common else set())
        w = {t: float(draw.random() ** 3 + 0.01) * (0.05 if t == 0 else 1.0) for t in held}
        length = sum(x * x for x in w.values()) ** 0.5
        out.append({t: x / length for t, x in w.items()})
    return out


def _long(rows, name, spark):
    cells = [(i, f"t{t}", x) for i, v in enumerate(rows) for t, x in v.items()]
    return spark.createDataFrame(cells, f"{name} long, term string, weight double")


@pytest.mark.parametrize(("k", "first"), [(1, 20), (5, 20), (5, 1), (300, 20)])
def test_equal_to_all_pairs(spark, monkeypatch, k, first):
    monkeypatch.setattr(text_knn, "FIRST_POSTINGS", first)
    draw = np.random.default_rng(k + first)
    asked, held = _vectors(draw, 40, 60, 0.9), _vectors(draw, 150, 60, 0.9)
    held += held[:20]
    asked.append({99: 1.0})
    found = {}
    rows = text_knn.nearest_by_terms(_long(asked, "user", spark), _long(held, "item", spark), k)
    for r in rows.orderBy("user", "rank").collect():
        found.setdefault(r["user"], []).append(r["item"])
    for u, a in enumerate(asked):
        scores = [round(sum(x * b.get(t, 0.0) for t, x in a.items()), 6) for b in held]
        best = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:k]
        assert found.get(u, []) == [i for _, i in best]


def test_weak_terms_bring_no_pairs(spark, monkeypatch):
    """A term that all texts share is not joined where stronger ones settle the neighbours."""
    rare = [{0: 0.01, 1 + i // 10: 1.0} for i in range(100)]
    asked = _long(rare[::10], "user", spark)
    joined = []
    keep = text_knn.skew_join

    def counted(left, right, *rest):
        joined.append(left.select("term").distinct().collect())
        return keep(left, right, *rest)

    monkeypatch.setattr(text_knn, "skew_join", counted)
    assert text_knn.nearest_by_terms(asked, _long(rare, "item", spark), 5).count() == 50
    assert "t0" not in {r["term"] for r in joined[0]}


def test_texts_without_neighbours_are_filled_up(spark):
    train = spark.createDataFrame([(i, f"word{i} word{i}", float(i)) for i in range(10, 30)], "id long, text string, rating double")
    test = spark.createDataFrame([(1, "word12", 3.0), (2, None, 4.0), (3, "nothing known", 4.0)], "id long, text string, rating double")
    got = {r["id"]: r["estimate"] for r in text_knn.neighbour_ratings(train, test, "id", "text", "rating", 3).collect()}
    assert got == {1: pytest.approx((12 + 10 + 11) / 3), 2: pytest.approx(11.0), 3: pytest.approx(11.0)}


def test_no_pair_becomes_a_row_of_a_join(spark, monkeypatch):
    """Groups and slices give the same neighbours, and a join makes no more rows than there are postings."""
    monkeypatch.setattr(text_knn, "GROUP", 7)
    monkeypatch.setattr(text_knn, "SLICE", 11)
    monkeypatch.setattr(text_knn, "ASKED", 3)
    draw = np.random.default_rng(5)
    asked, held = _vectors(draw, 30, 12, 1.0), _vectors(draw, 90, 12, 1.0)
    joined = []
    keep = text_knn.skew_join

    def counted(*args):
        out = keep(*args)
        joined.append(out.count())
        return out

    monkeypatch.setattr(text_knn, "skew_join", counted)
    found = {}
    for r in text_knn.nearest_by_terms(_long(asked, "user", spark), _long(held, "item", spark), 4).orderBy("user", "rank").collect():
        found.setdefault(r["user"], []).append(r["item"])
    for u, a in enumerate(asked):
        scores = [round(sum(x * b.get(t, 0.0) for t, x in a.items()), 6) for b in held]
        assert found[u] == [i for _, i in sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:4]]
    assert sum(joined) <= sum(len(v) for v in held)


def test_terms_that_come_twice_count_twice(spark):
    asked = _long([{1: 0.6, 2: 0.8}], "user", spark)
    held = _long([{1: 0.5}, {1: 0.3}, {2: 0.4}], "item", spark)
    twice = held.unionByName(held.filter("item = 1")).unionByName(held.filter("item = 1"))
    found = text_knn.nearest_by_terms(asked.unionByName(asked), twice, 3).orderBy("rank").collect()
    assert [(r["item"], round(r["score"], 6)) for r in found] == [(1, 1.08), (2, 0.64), (0, 0.6)]
