"""Distributed operators against brute force, with hot keys, small fronts and small blocks."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.hashing import row_key
from gleaner.operators import cleaning, content, evaluation, factor, features, ground_truth, neighbours, noise, quantiles, ranking, rater_groups
from gleaner.operators.ranker import RankerScores
from gleaner.operators.scoring import best_items, dot_scores
from gleaner.operators.sets import union_reached
from gleaner.operators.skew import hot_keys, skew_join
from gleaner.plans import views

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
SF_DIR = "/root/testdata/sf0.001"


def skewed_pairs(seed, users=60, items=40, rows=600):
    """One user and one item hold about a third of the rows each."""
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        u = 7 if rng.random() < 0.33 else rng.randrange(users)
        i = 3 if rng.random() < 0.33 else rng.randrange(items)
        out.append((u, i, float(rng.randint(1, 5))))
    return out


def test_global_rank_is_dense_and_sorted(spark):
    values = random.Random(1).sample(range(10**6), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    ranked = {r["v"]: r["rank"] for r in ranking.global_rank(df, ["v"]).collect()}
    assert ranked == {v: i for i, v in enumerate(sorted(values))}


@pytest.mark.parametrize("n", [0, 1, 9, 10, 997])
@pytest.mark.parametrize("prefix", [1, 5])
def test_exact_sample_size_and_members(spark, n, prefix):
    df = spark.range(n)
    key = row_key("id")
    cut = ranking.exact_cutoffs(df, key, {"s": 0.1, "t": 0.5}, prefix=prefix)
    import hashlib

    for step, share in (("s", 0.1), ("t", 0.5)):
        digest = {i: (hashlib.md5(f"42|{step}|{i}".encode()).hexdigest(), str(i)) for i in range(n)}
        expected = set(sorted(digest, key=digest.get)[: int(share * n)])
        found = {r["id"] for r in df.filter(ranking.in_sample(cut[step], step, key)).collect()}
        assert found == expected


@few
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([1.0, 2.0])), min_size=1, max_size=80))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    stats = quantiles.column_stats(df, {"x": F.col("x")}, [0.25, 0.5, 0.75])["x"]
    real = [v for v in values if v is not None]
    assert (stats.rows, stats.nulls) == (len(real), len(values) - len(real))
    for p, q in stats.quantiles.items():
        assert q == pytest.approx(float(np.quantile(real, p)), rel=1e-9, abs=1e-6)


@few
@given(st.lists(st.one_of(st.none(), st.floats(-1e4, 1e4)), min_size=2, max_size=60))
def test_capped_values_lie_within_the_whiskers(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = [r["x"] for r in cleaning.treat_outliers(df, ["x"]).collect()]
    real = [v for v in values if v is not None]
    assert sum(v is None for v in out) == len(values) - len(real)
    if len(real) >= 2:
        q1, q3 = np.quantile(real, [0.25, 0.75])
        reach = 1.5 * (q3 - q1)
        assert all(q1 - reach - 1e-6 <= v <= q3 + reach + 1e-6 for v in out if v is not None)


def test_hot_keys_are_dealt_over_pieces(spark):
    rows = [(7, i) for i in range(300)] + [(k, 0) for k in range(20)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = spark.createDataFrame([(k, k * 10) for k in range(20)], "k int, w int")
    hot = hot_keys(left, right, "k", slices=10, output=5)
    assert dict(hot).keys() == {7} and dict(hot)[7] > 1
    joined = skew_join(left, right, "k", ["v"], hot)
    assert sorted(map(tuple, joined.collect())) == sorted((k, v, k * 10) for k, v in rows)


def test_one_user_with_many_sparse_items_is_dealt_over_tasks(spark):
    many = [(1, i * 40_000) for i in range(5_000)] + [(2 + i // 3, i * 40_000) for i in range(15_000)]
    baskets = spark.createDataFrame(many, "user long, item long")
    hot = hot_keys(baskets, baskets, "user")
    assert [key for key, _ in hot] == [1] and hot[0][1] > 1
    right = baskets.withColumnRenamed("item", "other")
    joined = skew_join(baskets, right, "user", ["item"], hot).filter("user = 1")
    tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 5_000**2


def test_own_rating_takes_part_with_similarity_one(spark):
    rows = [(1, 10, 5.0), (2, 10, 1.0), (1, 11, 3.0), (2, 11, 3.0)]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    targets = spark.createDataFrame([(1, 10)], "user long, item long")
    like = (5 * 1 + 3 * 3) / math.sqrt((25 + 9) * (1 + 9))
    for front in (1, 1000):
        out = neighbours.predict(df, neighbours.rating_cells(df), targets, front=front).first()
        assert out["estimate"] == pytest.approx((5 + like) / (1 + like)) and round(out["estimate"], 2) == 3.27


@pytest.mark.parametrize("dense_from", [1, 3, 256])
@pytest.mark.parametrize("output", [5, 10**6])
def test_union_reached_matches_brute_force(spark, dense_from, output):
    pairs = sorted({(u, i * 9000) for u, i, _ in skewed_pairs(3)})
    by_user = {u: {i for v, i in pairs if v == u} for u, _ in pairs}
    expected = {}
    for u, i in pairs:
        expected.setdefault(i, set()).update(by_user[u])
    df = spark.createDataFrame(pairs, "user long, item long")
    reach = union_reached(
        df.select(F.col("item").alias("left"), "user"),
        df.withColumnRenamed("item", "member"),
        "left", "user", "member", dense_from=dense_from, slices=4, output=output,
    )
    found = {}
    rows = reach.pairs().collect()
    for r in rows:
        found.setdefault(r["left"], set()).add(r["member"])
    assert found == expected and len(rows) == sum(map(len, expected.values()))
    assert {r["left"]: r["members"] for r in reach.sizes().collect()} == {k: len(v) for k, v in expected.items()}
    asked = [(k, m) for k in list(expected)[:5] for m in range(0, 360_000, 9000)] + [(0, 1)]
    hits = reach.matching(spark.createDataFrame(asked, "left long, member long"))
    assert {tuple(r) for r in hits.collect()} == {(k, m) for k, m in asked if m in expected.get(k, ())}
    own = spark.createDataFrame([(k, k) for k in expected], "left long, member long")
    left_over = {tuple(r) for r in reach.minus(own).pairs().collect()}
    assert left_over == {(k, m) for k, s in expected.items() for m in s if m != k}


@pytest.mark.parametrize("dense_from", [2, 256])
def test_truth_is_symmetric_and_never_contains_itself(spark, dense_from):
    rows = skewed_pairs(5)
    df = spark.createDataFrame(rows, "user_id long, parent_asin long, rating double")
    pairs = ground_truth.baskets(df)
    co = ground_truth.co_item_sets(pairs, dense_from=dense_from).pairs()
    found = {tuple(r) for r in co.collect()}
    assert all(a != b and (b, a) in found for a, b in found)
    by_user = {u: {i for v, i, _ in rows if v == u} for u, _, _ in rows}
    assert found == {(a, b) for s in by_user.values() for a, b in itertools.permutations(s, 2)}
    reach = {u: {b for a, b in found if a in s} - s for u, s in by_user.items()}
    truth = ground_truth.user_truth_sets(pairs, co, dense_from=dense_from).pairs()
    assert {tuple(r) for r in truth.collect()} == {(u, i) for u, s in reach.items() for i in s}


def brute_similarities(rows):
    sums = {}
    for (u, i, r), (v, j, s) in itertools.product(rows, rows):
        if i == j and u != v:
            a = sums.setdefault((u, v), [0.0, 0.0, 0.0])
            a[0] += r * s
            a[1] += r * r
            a[2] += s * s
    return {pair: d / math.sqrt(a * b) for pair, (d, a, b) in sums.items()}


def brute_nearest(rows, k):
    sims = brute_similarities(rows)
    users = sorted({u for u, _, _ in rows})
    out = {}
    for u in users:
        order = sorted((v for v in users if v != u), key=lambda v: (-round(sims.get((u, v), 0.0), 6), v))
        out[u] = order[:k]
    return out


@pytest.mark.parametrize("front", [4, 12, 1000])
def test_nearest_matches_brute_force_for_any_front(spark, front):
    rows = skewed_pairs(11, users=50, items=60, rows=260) + [(100, 999, 3.0)]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    found = {}
    for r in neighbours.nearest(neighbours.rating_cells(df), 6, front).orderBy("user", "rank").collect():
        found.setdefault(r["user"], []).append(r["other"])
    assert found == brute_nearest(rows, 6)


@pytest.mark.parametrize("front", [4, 1000])
def test_predict_and_recommend_match_brute_force(spark, front):
    rows = skewed_pairs(12, users=30, items=25, rows=170)
    sims = brute_similarities(rows)
    mean = sum(r for _, _, r in rows) / len(rows)
    k = 5

    def estimate(u, i):
        like = {**sims, (u, u): 1.0}
        near = sorted(
            ((-round(like[u, v], 6), v, r, like[u, v]) for v, j, r in rows if j == i and like.get((u, v), 0) > 0)
        )[:k]
        raw = sum(s * r for _, _, r, s in near) / sum(s for *_, s in near) if near else mean
        return min(max(raw, 1.0), 5.0)

    df = spark.createDataFrame(rows, "user long, item long, rating double")
    cells = neighbours.rating_cells(df)
    targets = sorted({(u, i) for u, _, _ in rows for i in range(0, 25, 2)}) + [(500, 1), (1, 500)]
    out = neighbours.predict(df, cells, spark.createDataFrame(targets, "user long, item long"), k, front=front)
    assert {(r["user"], r["item"]): r["estimate"] for r in out.collect()} == pytest.approx(
        {t: estimate(*t) for t in targets}
    )
    near = brute_nearest(rows, k)
    items_of = {u: {i for v, i, _ in rows if v == u} for u in near}
    expected = {}
    for u, others in near.items():
        pool = set().union(*(items_of[v] for v in others))
        expected[u] = sorted(pool, key=lambda i: (-round(estimate(u, i), 6), i))[:3]
    found = {}
    for r in neighbours.recommend(df, k, 3, front=front).orderBy("user", "rank").collect():
        found.setdefault(r["user"], []).append(r["item"])
    assert found == expected


def test_few_raters_make_no_rows_of_pairs(spark, monkeypatch):
    """Users of one group or several; repeats of a rating count, the smallest first."""

    def no_pairs(*_):
        raise AssertionError("pairs of users as rows")

    monkeypatch.setattr(neighbours, "_shared_items", no_pairs)
    monkeypatch.setattr(neighbours, "pair_similarities", no_pairs)
    monkeypatch.setattr(rater_groups, "ENTRIES", 7)
    rows = skewed_pairs(13, users=30, items=25, rows=170)
    rows += [(u, i, 6 - r) for u, i, r in rows[:40]] + [(-7, 3, 2.0), (2**40, 3, 2.0), (-7, 4, 1.0)]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    cells = neighbours.rating_cells(df)
    near = {}
    for r in neighbours.nearest(cells, 6).orderBy("user", "rank").collect():
        near.setdefault(r["user"], []).append(r["other"])
    assert near == brute_nearest(rows, 6)
    sims = {**brute_similarities(rows), **{(u, u): 1.0 for u, _, _ in rows}}

    def estimate(u, i):
        held = sorted((-round(sims[u, v], 6), v, r, sims[u, v]) for v, j, r in rows if j == i and sims.get((u, v), 0) > 0)[:6]
        return sum(s * r for _, _, r, s in held) / sum(s for *_, s in held) if held else sum(r for *_, r in rows) / len(rows)

    targets = sorted({(u, i) for u, _, _ in rows for i in range(25)})
    out = neighbours.predict(df, cells, spark.createDataFrame(targets, "user long, item long"), 6).collect()
    assert {(r["user"], r["item"]): r["estimate"] for r in out} == pytest.approx({t: estimate(*t) for t in targets})
    best = {}
    for r in neighbours.recommend(df, 6, 3).orderBy("user", "rank").collect():
        best.setdefault(r["user"], []).append(r["item"])
    pool = {u: {i for v, i, _ in rows if v in others} for u, others in near.items()}
    assert best == {u: sorted(items, key=lambda i: (-round(estimate(u, i), 6), i))[:3] for u, items in pool.items()}


def test_ranking_metrics_from_containers_equal_those_from_rows(spark):
    rows = skewed_pairs(14, users=30, items=25, rows=170) + [(100, 70_000, 3.0), (101, 70_000, 3.0), (101, 140_000, 2.0)]
    df = spark.createDataFrame(rows, "user_id long, parent_asin long, rating double")
    pairs = ground_truth.baskets(df)
    train = df.select(F.col("user_id").alias("user")).filter("user <> 3")
    given = spark.createDataFrame([(u, i) for u in range(28) for i in range(10)] + [(100, 140_000), (101, 1)], "user long, item long")
    apart = ground_truth.user_truth_difference(pairs, ground_truth.co_item_containers(pairs))
    sets = ground_truth.user_truth_sets(pairs, ground_truth.co_item_sets(pairs).pairs()).pairs().toDF("user", "item")
    found = evaluation.ranking_f1_of_means(given, apart, train).first().asDict()
    assert found == pytest.approx(evaluation.ranking_f1_of_means(given, sets, train).first().asDict()) and found["hit_rate"] > 0


@pytest.mark.parametrize("scorer", ["cosine", "dot"])
def test_blocked_scoring_equals_broadcast_scoring(spark, scorer):
    rng = np.random.default_rng(0)
    kind = "array<double>"
    users = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], f"user long, vector {kind}")
    vectors = [(i, rng.normal(size=6).round(1).tolist()) for i in range(90)] + [(90, [0.0] * 6)]
    items = spark.createDataFrame(vectors, f"item long, vector {kind}")
    extra = {} if scorer == "cosine" else {"scorer": dot_scores}
    small = best_items(users, items, 5, **extra)
    large = best_items(users, items, 5, broadcast_bytes=0, block_rows=16, **extra)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_ranker_scores_match_the_fitted_network(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    rows = [(Vectors.dense(x), float(x.sum() > 0)) for x in rng.normal(size=(80, 5))]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = MultilayerPerceptronClassifier(layers=[5, 4, 3, 2], seed=1, maxIter=5).fit(df)
    scorer = RankerScores([5, 4, 3, 2], model.weights.toArray(), 2)
    for row in model.transform(df).limit(10).collect():
        x = row["features"].toArray()
        assert scorer(x[None, :2], x[None, 2:])[0, 0] == pytest.approx(row["probability"][1])


@pytest.mark.parametrize("blocks", [{}, {"broadcast_bytes": 0, "block_rows": 7}])
def test_unseen_recommendation_skips_train_items(spark, blocks):
    rows = skewed_pairs(21, users=25, items=40, rows=300)
    df = spark.createDataFrame(rows, "user int, item int, rating double")
    model = factor.fit_implicit(factor.confidence_cells(df), factors=4, iterations=3)
    users = {r["user"]: np.array(r["vector"]) for r in factor.factor_vectors(model, "user").collect()}
    items = {r["item"]: np.array(r["vector"]) for r in factor.factor_vectors(model, "item").collect()}
    seen = {(u, i) for u, i, _ in rows}
    expected = {}
    for u, v in users.items():
        left = [i for i in items if (u, i) not in seen]
        expected[u] = sorted(left, key=lambda i: (-round(float(v @ items[i]), 6), i))[:5]
    found = {}
    for r in factor.recommend_unseen(model, df, df, 5, **blocks).orderBy("user", "rank").collect():
        found.setdefault(r["user"], []).append(r["item"])
    assert found == {u: order for u, order in expected.items() if order}


def test_noise_touches_exact_row_counts(spark):
    n = 400
    df = spark.range(n).select(
        "id", F.lit(3.0).alias("rating"), F.lit("some words here").alias("text"), F.lit("a title").alias("title"),
        F.lit(1000).cast("long").alias("timestamp"), F.lit(2.0).alias("helpful_vote"),
    )
    shares = {**noise.REVIEW_SHARES, "duplicates": 0.0}
    out = noise.noise_reviews(df, row_key("id"), as_of_ms=5, shares=shares)
    assert out.count() == n
    assert out.filter("text = ''").count() >= int(0.1 * n)
    assert out.filter("timestamp <> 1000").count() == int(0.05 * n)
    assert {r["timestamp"] for r in out.filter("timestamp <> 1000").collect()} == {-1, 5 + noise.FUTURE_MS}
    assert out.filter("rating IN (0, 6)").count() == int(0.05 * n)
    assert out.filter("helpful_vote = -1").count() == int(0.05 * n)
    assert noise.noise_reviews(df, row_key("id"), 5).count() == n + int(0.05 * n)


def test_typos_swap_or_extend(spark):
    df = spark.createDataFrame([(0, "abcdef a  ghij", 1), (1, None, 1)], "id int, t string, n int")
    out = {r["id"]: r["o"] for r in df.select("id", text.typos("t", 1.0, 1, row_key("id")).alias("o")).collect()}
    first, second, third = out[0].split(" ")
    assert sorted(first) == list("abcdef") and first != "abcdef"
    assert second[0] == "a" and len(second) == 2
    assert sorted(third) == list("ghij") and third != "ghij"
    assert out[1] is None


def test_text_similarity_and_components(spark):
    texts = [(i, " ".join(random.Random(i).choices(["red", "blue", "green", "box", "car"], k=8))) for i in range(30)]
    df = spark.createDataFrame(texts, "id long, text string")
    model = features.TfIdf.fit(df, "text", 5)
    assert model.vocabulary == ["blue", "box", "car", "green", "red"]
    points = features.principal_components(model.transform(df, "text"), "vector").orderBy("id").toPandas()
    dense = np.array([r["vector"].toArray() for r in model.transform(df, "text").orderBy("id").collect()])
    centred = dense - dense.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(points[["pc1", "pc2"]].to_numpy()), np.abs(centred @ axes[:2].T), atol=1e-6)
    both = features.text_similarity(df.withColumn("again", F.col("text")), "text", "again", model)
    assert all(r["similarity"] == pytest.approx(1.0) for r in both.collect())


def test_text_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(0, "good game"), (1, "bad game here")], "id int, text string")
    for method in ("tfidf", "hashed"):
        for r in features.text_vectors(df, "text", method, 16).collect():
            assert np.linalg.norm(r["vector"]) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        features.text_vectors(df, "text", "other")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_stays_in_the_jvm_without_a_shuffle(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for c in (text.clean_plain("text"), text.clean_markup("text"), text.scrub_pii("text")):
        plan = _plan(docs.select("doc_id", c.alias("out")))
        assert "Python" not in plan and "Exchange" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_ids_and_samples_never_gather_a_table(spark):
    rows = views.interactions(spark, SF_DIR)
    assert "SinglePartition" not in _plan(ranking.exact_sample(rows, views.interaction_key(), 0.1))
    ids = ranking.sorted_ids(rows, "parent_asin", "id")
    # The only single-partition window runs over one row per partition.
    assert _plan(ids).count("SinglePartition") <= 1


def test_top_k_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = _plan(ranking.top_k(rows, "g", [F.col("id")], 2))
    assert plan.count("WindowGroupLimit") == 2


def test_profiles_average_repeats(spark):
    train = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 3, 0)], "user long, item long, label int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [9.0, 9.0])], "item long, vector array<double>")
    known = content.profiles(train, vectors)
    assert known.first()["vector"] == pytest.approx([2 / 3, 1.0])
    users = spark.createDataFrame([(1,), (2,)], "user long")
    everyone = {r["user"]: r["vector"] for r in content.profiles_or_zero(users, known, 2).collect()}
    assert everyone[2] == [0.0, 0.0]
