"""Best items by blocks: against brute force, and how often users are read."""

import numpy as np
import pytest

from gleaner.operators import scoring
from gleaner.operators.scoring import best_items, cosine_scores, dot_scores

KIND = "array<double>"


def _tables(spark, n_users=60, n_items=300, spread=2.0, seed=4):
    draw = np.random.default_rng(seed)
    users = draw.normal(size=(n_users, 5)).round(2)
    users[3] = 0
    # Lengths differ much, as those of popular and rare items do.
    items = draw.normal(size=(n_items, 5)) * np.exp(draw.normal(0, spread, (n_items, 1)))
    items[7] = 0
    items[20:25] = items[10]
    ids = draw.permutation(n_items) + 2**33
    u = spark.createDataFrame([(f"u{i:03d}", v.tolist()) for i, v in enumerate(users)], f"user string, vector {KIND}")
    i = spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(ids, items, strict=True)], f"item long, vector {KIND}")
    return u, i, users, dict(zip(ids.tolist(), items, strict=True))


def _expected(users, items, scorer, k, seen=()):
    ids = sorted(items)
    scores = scorer(users, np.stack([items[i] for i in ids]))
    out = []
    for n, row in enumerate(scores):
        user = f"u{n:03d}"
        best = sorted((-round(s, 6), i) for s, i in zip(row.tolist(), ids, strict=True) if (user, i) not in seen)[:k]
        out += [(user, i, rank) for rank, (_, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("scorer", [dot_scores, cosine_scores])
@pytest.mark.parametrize("blocks", [{}, {"broadcast_bytes": 0, "block_rows": 40}, {"broadcast_bytes": 0, "block_rows": 7}])
def test_blocks_equal_brute_force(spark, scorer, blocks):
    users, items, u, i = _tables(spark)
    found = best_items(users, items, 4, scorer, **blocks).collect()
    assert sorted((r["user"], r["item"], r["rank"]) for r in found) == _expected(u, i, scorer, 4)


@pytest.mark.parametrize("blocks", [{}, {"broadcast_bytes": 0, "block_rows": 40}])
def test_seen_items_are_left_out(spark, blocks):
    users, items, u, i = _tables(spark)
    best = _expected(u, i, dot_scores, 30)
    seen = {(a, b) for a, b, rank in best if rank % 3 or a == "u001"} | {("u002", x) for x in i}
    pairs = spark.createDataFrame(sorted(seen) + sorted(seen)[:5], "user string, item long")
    found = best_items(users, items, 4, dot_scores, seen=pairs, **blocks).collect()
    assert sorted((r["user"], r["item"], r["rank"]) for r in found) == _expected(u, i, dot_scores, 4, seen)
    assert "u002" not in {r["user"] for r in found}


def test_users_stop_when_no_later_block_can_win(spark, monkeypatch):
    users, items, _, _ = _tables(spark)
    written = []
    keep = scoring.materialize

    def counted(df, label):
        out = keep(df, label)
        if label == "users-past-block":
            written.append(out.count())
        return out

    monkeypatch.setattr(scoring, "materialize", counted)
    best_items(users, items, 4, dot_scores, broadcast_bytes=0, block_rows=10).count()
    # The user without length ties with every item to the end.
    assert written[-1] == 1
    assert written[0] == 60
    assert sum(written) < 60 * 12


def test_users_are_dealt_out_once(spark, monkeypatch):
    """However many blocks, a block reads users where they are."""
    users, items, _, _ = _tables(spark, spread=0.1)
    plans = []
    keep = scoring.materialize

    def noted(df, label):
        if label == "users-past-block":
            plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return keep(df, label)

    monkeypatch.setattr(scoring, "materialize", noted)
    best_items(users, items, 4, cosine_scores, broadcast_bytes=0, block_rows=60).count()
    assert plans[0] >= 1
    assert plans[1:] == [0] * len(plans[1:])
    assert len(plans) >= 3


def test_no_items(spark):
    users, items, _, _ = _tables(spark)
    assert best_items(users, items.limit(0), 3).count() == 0
    assert best_items(users.limit(0), items, 3, dot_scores, broadcast_bytes=0, block_rows=50).count() == 0


@pytest.mark.parametrize("scorer", [dot_scores, cosine_scores])
def test_screen_equals_ranking_every_item(scorer, monkeypatch):
    """Only items near the k-th best are scored in full, and none of the best is lost."""
    monkeypatch.setattr(scoring, "FIRST_ITEMS", 50)
    draw = np.random.default_rng(8)
    users = draw.normal(size=(40, 6))
    users[5], users[6, 0] = 0, np.nan
    items = draw.normal(size=(3000, 6)) * np.exp(draw.normal(0, 2, (3000, 1)))
    # Copies, and vectors that single precision cannot tell apart.
    items[1000:1500] = items[:500]
    items[2000:2500] = items[:500] * (1 + 1e-9)
    items[77] = 0
    ids = np.sort(draw.choice(10**12, 3000, replace=False))
    # One id with two vectors.
    ids[601] = ids[600]
    seen = [ids[draw.choice(3000, n, replace=False)] if n else None for n in draw.integers(0, 40, 40)]
    whole = scoring._best_of_block(np.arange(40), users, ids, items, 10, 6, scorer, seen)
    pairs = []
    keep = scoring._scored_pairs
    monkeypatch.setattr(scoring, "_scored_pairs", lambda rows, *rest: pairs.append(len(rows)) or keep(rows, *rest))
    found = scoring._screened(users, ids, items, scoring._light(items, scorer), 10, 6, scorer, seen, None)
    assert found["user"].tolist() == whole["user"].tolist()
    assert found["item"].tolist() == whole["item"].tolist()
    assert np.allclose(found["score"], whole["score"], rtol=0, atol=1e-12)
    assert 0 < sum(pairs) < 40 * 3000 / 4
