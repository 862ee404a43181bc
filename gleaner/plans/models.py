"""Queries: vectors, content and factor recommenders, the neural ranker, pooled metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleaner.functions.network import Network
from gleaner.functions.vectors import as_doubles, norm, unit
from gleaner.operators import content, evaluation, factor, features, neighbours, ranking, text_knn, word_vectors
from gleaner.operators.joint_ranker import JointRanker, network_scores
from gleaner.operators.ranker import NeuralRanker
from gleaner.plans import sql as S
from gleaner.plans import views as V
from gleaner.plans.registry import query
from gleaner.session import materialize

DIM = 64  # width of the given embeddings

# Every item takes the embedding of its number, counted round the embedding table.
_ITEM_VECTORS = """vecs AS (SELECT p_partkey AS i, e.embedding::DOUBLE[] AS vec FROM part
  JOIN embeddings e ON e.vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""
_LABELLED = f"""{S.INTERACTIONS},
  rows AS (SELECT user_id AS u, parent_asin AS i, rating, CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS label,
    {S.is_test()} AS test FROM interactions)"""
_PROFILES = """liked AS (SELECT u, vec FROM rows JOIN vecs USING (i) WHERE NOT test AND label = 1),
  dims AS (SELECT u, d, avg(vec[d]) AS x FROM liked, range(1, 65) t(d) GROUP BY u, d),
  known AS (SELECT u, list(x ORDER BY d) AS p FROM dims GROUP BY u),
  zero AS (SELECT list_transform(range(64), lambda x: 0.0::DOUBLE) AS z),
  profiles AS (SELECT u, coalesce(p, z) AS p FROM (SELECT DISTINCT u FROM rows WHERE test)
    LEFT JOIN known USING (u), zero)"""
_SCORE = "CASE WHEN list_dot_product(p, p) > 0 THEN list_cosine_similarity(p, vec) ELSE 0 END"
_CONTENT = f"""{_LABELLED}, {_ITEM_VECTORS}, {_PROFILES},
  scored AS (SELECT u, i, {_SCORE} AS score FROM profiles, vecs),
  top AS (SELECT u, i, score, row_number() OVER (PARTITION BY u ORDER BY round(score, 6) DESC, i) AS rank
    FROM scored QUALIFY rank <= 10)"""


def _item_vectors(spark, sf_dir):
    vectors = V.table(spark, sf_dir, "embeddings")
    n = vectors.count()
    parts = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), (F.col("p_partkey") % n).alias("vec_id")
    )
    return parts.join(vectors, "vec_id").select("item", as_doubles("embedding").alias("vector"))


def _labelled_split(spark, sf_dir):
    rows = V.interactions(spark, sf_dir).select(
        F.col("user_id").alias("user"),
        F.col("parent_asin").alias("item"),
        "rating",
        V.interaction_key().alias("row_key"),
    )
    return ranking.train_test(content.labelled(rows), F.col("row_key"))


@query(
    "unit_vectors",
    """SELECT vec_id, round(sqrt(list_dot_product(e, e)), 4) AS length,
      round(e[1] / sqrt(list_dot_product(e, e)), 4) AS first, 64 + len(e) AS joined
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def unit_vectors(spark, sf_dir):
    v = as_doubles("embedding")
    return V.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(norm(v), 4).alias("length"),
        F.round(unit(v)[0], 4).alias("first"),
        F.size(F.concat(v, unit(v))).cast("long").alias("joined"),
    )


@query(
    "profile_mean",
    """WITH d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL)
    SELECT label, i - 1 AS position, round(x, 4) AS value FROM d""",
)
def profile_mean(spark, sf_dir):
    vectors = V.table(spark, sf_dir, "embeddings").select("label", "embedding")
    means = content.mean_vectors(vectors, "label", "embedding")
    return means.select("label", F.posexplode("vector").alias("position", "value")).select(
        "label", F.col("position").cast("long").alias("position"), F.round("value", 4).alias("value")
    )


@query(
    "content_topk",
    f"""WITH {_CONTENT} SELECT u AS "user", i AS item, round(score, 4) AS score, rank FROM top""",
)
def content_topk(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    top = content.recommend(train, test, _item_vectors(spark, sf_dir), DIM)
    return top.select("user", "item", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "pair_scores",
    f"""WITH {_LABELLED.replace('rows AS (', 'rows AS MATERIALIZED (')},
    {_ITEM_VECTORS.replace('vecs AS (', 'vecs AS MATERIALIZED (')},
    {_PROFILES.replace('dims AS (', 'dims AS MATERIALIZED (').replace('profiles AS (', 'profiles AS MATERIALIZED (')},
    asked AS MATERIALIZED (SELECT u, i, label FROM rows WHERE test),
    with_item AS MATERIALIZED (SELECT asked.*, vec FROM asked JOIN vecs USING (i))
    SELECT u AS "user", i AS item, label, round({_SCORE}, 4) + 0.0::DOUBLE AS score FROM with_item JOIN profiles USING (u)""",
)
def pair_scores(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    vectors = _item_vectors(spark, sf_dir)
    scored = content.pair_scores(test.select("user", "item", "label"), content.profiles(train, vectors), vectors)
    return scored.select("user", "item", "label", (F.round("score", 4) + F.lit(0.0)).alias("score"))


_METRICS = ("precision", "recall", "f1", "hit_rate")


def _rounded(metrics, *names):
    return metrics.withColumns({c: F.round(c, 4) for c in names})


@query(
    "pooled_eval",
    f"""WITH {_CONTENT},
    t AS (SELECT u, i, label, {_SCORE} AS score FROM rows JOIN profiles USING (u) JOIN vecs USING (i) WHERE test),
    c AS (SELECT CAST(count(*) FILTER (score >= 0.5 AND label = 1) AS DOUBLE) AS tp,
      count(*) FILTER (score >= 0.5) AS guessed, sum(label) AS liked,
      sqrt(avg((label - score) * (label - score))) AS rmse, avg(abs(label - score)) AS mae FROM t),
    h AS (SELECT count(DISTINCT u) AS users, count(DISTINCT CASE WHEN (u, i) IN (SELECT u, i FROM top) AND label = 1
      THEN u END) AS hit FROM t),
    m AS (SELECT coalesce(tp / nullif(guessed, 0), 0) AS p, coalesce(tp / nullif(liked, 0), 0) AS r,
      rmse, mae, hit / users AS hr, users FROM c, h)
    SELECT round(p, 4) AS precision, round(r, 4) AS recall,
      round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, round(rmse, 4) AS rmse,
      round(mae, 4) AS mae, round(hr, 4) AS hit_rate, users FROM m""",
)
def pooled_eval(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    vectors = _item_vectors(spark, sf_dir)
    scored = content.pair_scores(test, content.profiles(train, vectors), vectors)
    top = content.recommend(train, test, vectors, DIM)
    return _rounded(evaluation.pooled(scored, top), *_METRICS, "rmse", "mae")


@query(
    "ranking_eval_als",
    f"""WITH {_CONTENT},
    wanted AS (SELECT DISTINCT u, i FROM rows WHERE test AND label = 1 AND u IN (SELECT u FROM rows WHERE NOT test)),
    per_user AS (SELECT w.u, w.n, g.n AS given, coalesce(h.n, 0) AS h
      FROM (SELECT u, count(*) AS n FROM wanted GROUP BY u) w
      JOIN (SELECT u, count(*) AS n FROM top GROUP BY u) g USING (u)
      LEFT JOIN (SELECT u, count(*) AS n FROM top JOIN wanted USING (u, i) GROUP BY u) h USING (u)),
    m AS (SELECT h / given AS p, h / n AS r, h FROM per_user)
    SELECT round(avg(p), 4) AS precision, round(avg(r), 4) AS recall,
      round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) AS f1,
      round(avg(CASE WHEN h > 0 THEN 1 ELSE 0 END), 4) AS hit_rate, count(*) AS users FROM m""",
)
def ranking_eval_als(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    top = content.recommend(train, test, _item_vectors(spark, sf_dir), DIM)
    return _rounded(evaluation.ranking_mean_f1(top, test.filter("label = 1"), train), *_METRICS)


@query("als_topk")
def als_topk(spark, sf_dir):
    rows = neighbours.usable_ratings(V.interactions(spark, sf_dir).withColumn("k", V.interaction_key()))
    model = factor.fit_implicit(factor.confidence_cells(rows))
    return factor.recommend_unseen(model, rows, rows)


@query("als_eval")
def als_eval(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    relevant = test.filter("label = 1")
    model = factor.fit_implicit(factor.confidence_cells(train))
    top = factor.recommend_unseen(model, relevant, train)
    return evaluation.ranking_mean_f1(top, relevant, train)


def _described(spark, sf_dir):
    """Items with the text of the document of their number, counted round the documents."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    parts = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), (F.col("p_partkey") % n).alias("doc_id")
    )
    return parts.join(docs, "doc_id").select("item", "text")


@query("neural_rank")
def neural_rank(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    texts = features.text_vectors(_described(spark, sf_dir), "text", "hashed").select("item", "vector")
    ranker = NeuralRanker.fit(train, materialize(texts, "texts"))
    return ranker.recommend(test)


@query("neural_eval")
def neural_eval(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    ranker = NeuralRanker.fit(train)
    return evaluation.pooled(ranker.score(test), ranker.recommend(test))


@query("joint_rank")
def joint_rank(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    return JointRanker.fit(train).recommend(test)


@query("joint_eval")
def joint_eval(spark, sf_dir):
    train, test = _labelled_split(spark, sf_dir)
    ranker = JointRanker.fit(train)
    return evaluation.pooled(ranker.score(test), ranker.recommend(test))


# A small network with weights by rule, for comparing the forward pass.
_FIXED_LAYERS = [2 * DIM, 8, 4, 1]
_FIXED_WEIGHTS = [((k * 37) % 101 - 50) / 200 for k in range(Network.size(_FIXED_LAYERS))]


def _forward_sql() -> str:
    """The network layer by layer; the last one without rectification."""
    steps, at, source = [], 0, "SELECT u, i, list_concat(uv, iv) AS x FROM pairs"
    for n, (a, b) in enumerate(zip(_FIXED_LAYERS, _FIXED_LAYERS[1:])):
        rows = [_FIXED_WEIGHTS[at + j * a : at + (j + 1) * a] for j in range(b)]
        shift = _FIXED_WEIGHTS[at + a * b : at + a * b + b]
        at += a * b + b
        cells = [f"list_dot_product(x, {r}::DOUBLE[]) + ({s})" for r, s in zip(rows, shift)]
        if b > 1:
            cells = [f"greatest({c}, 0)" for c in cells]
        steps.append(f"layer{n} AS ({source})")
        source = f"SELECT u, i, [{', '.join(cells)}] AS x FROM layer{n}"
    return ", ".join(steps) + f""", last AS ({source})
    SELECT u AS "user", i AS item, round(1 / (1 + exp(-x[1])), 4) AS score FROM last"""


@query(
    "network_forward",
    f"""WITH {S.INTERACTIONS}, vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT count(*) FROM embeddings) AS n
      FROM embeddings),
    pairs AS (SELECT u, i, a.v AS uv, b.v AS iv
      FROM (SELECT DISTINCT user_id AS u, parent_asin AS i FROM interactions)
      JOIN vecs a ON a.vec_id = u % a.n JOIN vecs b ON b.vec_id = i % b.n),
    {_forward_sql()}""",
)
def network_forward(spark, sf_dir):
    """Every user and item that meet, through the ranker's network with fixed weights."""
    rows = V.interactions(spark, sf_dir)
    vectors = V.table(spark, sf_dir, "embeddings")
    n = vectors.count()

    def table(column, side):
        ids = rows.select(F.col(column).alias(side)).distinct().withColumn("vec_id", F.col(side) % n)
        return ids.join(vectors, "vec_id").select(side, as_doubles("embedding").alias("vector"))

    pairs = rows.select(F.col("user_id").alias("user"), F.col("parent_asin").alias("item")).distinct()
    network = Network(_FIXED_LAYERS, np.array(_FIXED_WEIGHTS))
    scored = network_scores(pairs, table("user_id", "user"), table("parent_asin", "item"), network)
    return scored.withColumn("score", F.round("score", 4))


@query("raw_vs_cleaned")
def raw_vs_cleaned(spark, sf_dir):
    from gleaner.functions.text import clean_markup
    from gleaner.operators.diagnostics import variants

    train, test = _labelled_split(spark, sf_dir)
    described = _described(spark, sf_dir)
    texts = {
        "raw": described,
        "cleaned": described.withColumn("text", clean_markup("text")),
    }
    results = {}
    for name, df in texts.items():
        vectors = materialize(features.text_vectors(df, "text").select("item", "vector"), name)
        scored = content.pair_scores(test, content.profiles(train, vectors), vectors)
        top = content.recommend(train, test, vectors, vectors.select(F.max(F.size("vector"))).first()[0])
        results[name] = evaluation.pooled(scored, top)
    return variants(**results)


@query("text_vectors")
def text_vectors(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return features.text_vectors(docs, "text", "hashed").select("doc_id", "vector")


_TERM_LIST = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@query(
    "word_ppmi",
    f"""WITH t AS (SELECT row_number() OVER () AS d, {_TERM_LIST} AS w FROM documents),
    p AS (SELECT d, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
    often AS (SELECT word FROM p GROUP BY word HAVING count(*) >= {word_vectors.LEAST}),
    near AS (SELECT a.word, b.word AS context, count(*) AS n FROM p a JOIN p b
      ON a.d = b.d AND a.i <> b.i AND abs(a.i - b.i) <= {word_vectors.WINDOW} GROUP BY ALL),
    kept AS (SELECT * FROM near WHERE word IN (SELECT word FROM often) AND context IN (SELECT word FROM often)),
    sums AS (SELECT word, sum(n) AS s FROM kept GROUP BY word)
    SELECT word, context, round(weight, 4) AS weight FROM (
      SELECT k.word, context, ln(n * (SELECT sum(s) FROM sums) / (a.s::DOUBLE * b.s)) AS weight
      FROM kept k JOIN sums a ON a.word = k.word JOIN sums b ON b.word = context) WHERE weight > 0""",
)
def word_ppmi(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    counts = word_vectors.co_occurrences(docs, "text", least=word_vectors.LEAST)
    weights = word_vectors.ppmi(materialize(counts, "co-occurrences"))
    return weights.withColumn("weight", F.round("weight", 4))


@query("learned_text_vectors")
def learned_text_vectors(spark, sf_dir):
    return word_vectors.learned_text_vectors(V.table(spark, sf_dir, "documents"), "doc_id", "text")


_TFIDF = """counts AS (SELECT doc_id, term, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM docs) GROUP BY ALL),
  vocab AS (SELECT term, sum(n) AS total, count(*) AS holders FROM counts GROUP BY term
    ORDER BY total DESC, term LIMIT 500),
  raw AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM docs)) / (1 + holders)) + 1) AS w
    FROM counts JOIN vocab USING (term)),
  weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


@query(
    "tfidf",
    f"""WITH docs AS (SELECT doc_id, text FROM documents), {_TFIDF}
    SELECT doc_id, term, round(w, 4) AS weight FROM weights""",
)
def tfidf(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = features.TfIdf.fit(docs, "text", 500)
    return model.weights(docs, "text", ["doc_id"]).withColumn("weight", F.round("weight", 4))


@query(
    "text_similarity",
    f"""WITH docs AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), {_TFIDF},
    pairs AS (SELECT a.conv_id, a.turn, a.conv_id * 1000 + a.turn AS x, b.conv_id * 1000 + b.turn AS y
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, round(coalesce(sum(a.w * b.w), 0), 4) AS similarity
    FROM pairs LEFT JOIN weights a ON a.doc_id = x LEFT JOIN weights b ON b.doc_id = y AND b.term = a.term
    GROUP BY conv_id, turn""",
)
def text_similarity(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    model = features.TfIdf.fit(turns, "text", 500)
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = turns.join(after, ["conv_id", "turn"])
    scored = features.text_similarity(pairs, "text", "reply", model)
    return scored.select("conv_id", "turn", F.round("similarity", 4).alias("similarity"))


_TEXT_KNN = f"""rated AS (SELECT doc_id, text, CAST(quality * 4 + 1 AS DOUBLE) AS rating,
      {S.is_test('CAST(doc_id AS VARCHAR)')} AS test FROM documents JOIN labels USING (doc_id)),
    docs AS (SELECT doc_id, text FROM rated WHERE NOT test), {_TFIDF.replace('LIMIT 500', 'LIMIT 1000')},
    asked AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id,
        unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM rated WHERE test) GROUP BY ALL),
    q0 AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM docs)) / (1 + holders)) + 1) AS w
      FROM asked JOIN vocab USING (term)),
    q AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM q0),
    dots AS (SELECT q.doc_id AS u, b.doc_id AS i, sum(q.w * b.w) AS s FROM q JOIN weights b USING (term) GROUP BY ALL),
    near AS (SELECT a.doc_id AS u, b.doc_id AS i, b.rating FROM rated a JOIN rated b ON a.test AND NOT b.test
      LEFT JOIN dots ON u = a.doc_id AND i = b.doc_id
      QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY round(coalesce(s, 0), 6) DESC, b.doc_id) <= 5)"""


@query(
    "text_knn",
    f"""WITH {_TEXT_KNN}
    SELECT u AS doc_id, r.rating, round(avg(near.rating), 4) AS estimate
    FROM near JOIN rated r ON r.doc_id = u GROUP BY ALL""",
)
def text_knn_estimates(spark, sf_dir):
    return _text_knn(spark, sf_dir).withColumn("estimate", F.round("estimate", 4))


def _text_knn(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = V.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 4 + 1).cast("double").alias("rating"))
    train, test = ranking.train_test(docs.join(labels, "doc_id"), F.col("doc_id").cast("string"))
    return text_knn.neighbour_ratings(train, test, "doc_id", "text", "rating")


@query(
    "text_knn_mse",
    f"""WITH {_TEXT_KNN}, guess AS (SELECT u, avg(rating) AS estimate FROM near GROUP BY u)
    SELECT round(avg((rating - estimate) * (rating - estimate)), 4) AS mse
    FROM guess JOIN rated ON doc_id = u""",
)
def text_knn_mse(spark, sf_dir):
    errors = text_knn.mean_squared_error(_text_knn(spark, sf_dir), "rating")
    return errors.select(F.round("mse", 4).alias("mse"))
