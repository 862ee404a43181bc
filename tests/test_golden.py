"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.functions import numeric, text, vectors
from gleaner.operators import cleaning, content, diagnostics, evaluation, factor, ground_truth, ingest


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("out")).first()["out"]


def column(df, name="x", order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def numbers(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"id int, x {kind}")


def test_median_fill(spark):
    out = cleaning.fill_missing(numbers(spark, ["1", None, "3", "x"]), ["x"], [])
    assert column(out) == [1.0, 2.0, 3.0, 2.0]


def test_text_fill(spark):
    out = cleaning.fill_missing(numbers(spark, ["a", None, "nan"]), [], ["x"])
    assert column(out) == ["a", "[Missing Value]", "[Missing Value]"]


def test_wholly_null_column_stays_null(spark):
    assert column(cleaning.fill_missing(numbers(spark, [None, None]), ["x"], [])) == [None, None]


def test_absent_columns_are_skipped(spark):
    out = cleaning.fill_missing(numbers(spark, ["1"]), ["missing"], ["gone"])
    assert out.columns == ["id", "x"]


@pytest.mark.parametrize(
    "method, last", [("whisker", 9.25), ("median", 2.5), ("mean", 4.0), ("something else", 10.0)]
)
def test_outliers(spark, method, last):
    out = cleaning.treat_outliers(numbers(spark, [1.0, 2.0, 3.0, 10.0], "double"), ["x"], method)
    assert column(out) == [1.0, 2.0, 3.0, last]


def test_outlier_count_and_total(spark):
    counted = cleaning.outlier_counts(numbers(spark, [1.0, 2.0, 3.0, 10.0], "double"), ["x"])
    assert {r["column"]: r["outliers"] for r in counted.collect()} == {"x": 1, "total": 1}


def test_outliers_need_two_values(spark):
    out = cleaning.treat_outliers(numbers(spark, [5.0, None], "double"), ["x"])
    assert column(out) == [5.0, None]


def test_impute_then_cap_equals_the_two_steps(spark):
    df = numbers(spark, [1.0, None, 3.0, 2.0, 100.0, None, -50.0, 2.5], "double")
    two = cleaning.treat_outliers(cleaning.fill_missing(df, ["x"], []), ["x"])
    assert column(cleaning.fill_and_cap(df, ("x",), [])) == column(two)


@pytest.mark.parametrize("lemmatise, expected", [(False, "dont buy games"), (True, "dont buy game")])
def test_plain_normaliser(spark, lemmatise, expected):
    assert one(spark, text.clean_plain("t", lemmatise), t="Don't  buy 2 games!!") == expected


def test_plain_normaliser_null_and_splits(spark):
    assert one(spark, text.clean_plain("t"), t=None) == ""
    assert one(spark, text.clean_plain("t", False), t="I cannot “wait”, gonna go") == "“ wait ” gon na go"


def test_plain_normaliser_keeps_repeats_and_is_idempotent(spark):
    first = one(spark, text.clean_plain("t", False), t="good GOOD game, 3 games")
    assert first == "good good game games"
    assert one(spark, text.clean_plain("t", False), t=first) == first


def test_markup_normaliser(spark):
    assert one(spark, text.clean_markup("t"), t="<b>Great</b> game, 10/10") == "great game"
    assert one(spark, text.clean_markup("t"), t=None) == ""


@pytest.mark.parametrize(
    "word, lemma",
    [("boxes", "box"), ("stories", "story"), ("classes", "class"), ("women", "woman"), ("children", "child"),
     ("glass", "glass"), ("bus", "bus"), ("watches", "watch"), ("men", "men"), ("axis", "axis")],
)
def test_lemmas(spark, word, lemma):
    assert one(spark, text.singular(F.col("t")), t=word) == lemma


def test_own_lexicon_comes_first(spark):
    assert one(spark, text.singular(F.col("t"), {"boxes": "crate"}), t="boxes") == "crate"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("mail a.b@x.com or (555) 123-4567", "mail [REDACTED] or ([REDACTED]"),
        ("123-45-6789", "[REDACTED]"),
        ("4111111111111111", "[REDACTED]"),
        ("0345339681", "[REDACTED]"),
        ("123456789012", "123456789012"),
        (None, None),
    ],
)
def test_redaction(spark, raw, expected):
    assert one(spark, text.scrub_pii("t"), t=raw) == expected


def test_layout_guess():
    assert schema.guess_layout(["title", "images", "parent_asin"]) == "review"
    assert schema.guess_layout(["price", "store", "title"]) == "meta"
    assert schema.guess_layout(["Price", "STORE"]) == "review"


def test_header_mapping(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`User-ID` int, ratng int, other int")
    assert schema.map_headers(df, "review").columns == ["user_id", "rating", "other"]
    assert schema.map_headers(df, "review", {"other": "text"}).columns == ["User-ID", "ratng", "text"]
    with pytest.raises(ValueError):
        schema.map_headers(df, "review", {"other": "text", "ratng": "text"})


def test_required_columns(spark):
    with pytest.raises(ValueError, match="parent_asin"):
        ground_truth.baskets(spark.createDataFrame([("u",)], "user_id string"))


def test_pseudonyms(spark):
    df = spark.createDataFrame(list(enumerate(["b", "a", None, "b"])), "id int, user_id string")
    assert column(ingest.sanitise(df), "user_id") == [1, 0, -1, 1]


@pytest.mark.parametrize(
    "raw, number",
    [("1", 1.0), (" 2.5 ", 2.5), ("1e3", 1000.0), ("1.0d", None), ("nan", None), ("x", None), ("", None), (None, None)],
)
def test_numbers(spark, raw, number):
    assert one(spark, numeric.to_number("t"), t=raw) == number


def test_labels_and_confidence(spark):
    df = spark.createDataFrame([(0, 4.0), (1, 3.9), (2, None)], "id int, rating double")
    assert column(content.labelled(df), "label") == [1, 0, 0]
    ratings = spark.createDataFrame(
        [(1, 1, 5.0), (1, 2, -1.0), (1, 3, 5.0), (1, 3, 4.0)], "user int, item int, rating double"
    )
    assert column(factor.confidence_cells(ratings), "confidence", "item") == [201.0, 0.0, 362.0]
    assert column(factor.binary_cells(ratings), "value", "item") == [1.0, 1.0, 2.0]


BASKETS = [("A", "x"), ("A", "y"), ("B", "y"), ("B", "z"), ("C", "w"), ("A", "x"), (None, "x"), ("A", None)]


def test_co_purchases_and_user_truth(spark):
    reviews = spark.createDataFrame(BASKETS, "user_id string, parent_asin string")
    truth = ground_truth.co_purchases(reviews)
    rows = {(r["item"], r["co_item"]) for r in truth.collect()}
    assert rows == {("x", "y"), ("y", "x"), ("y", "z"), ("z", "y"), ("w", None)}
    users = ground_truth.user_truth(reviews, truth)
    assert {tuple(r) for r in users.collect()} == {("A", "z"), ("B", "x")}


def test_truth_restriction_keeps_emptied_items(spark):
    truth = spark.createDataFrame([("x", "y"), ("w", None)], "item string, co_item string")
    reviews = spark.createDataFrame([("u", "x"), ("u", "q"), ("u", "w")], "user_id string, parent_asin string")
    kept, narrowed = ground_truth.restrict_to_truth(truth, reviews)
    assert {r["parent_asin"] for r in kept.collect()} == {"x", "w"}
    assert {tuple(r) for r in narrowed.collect()} == {("x", "y"), ("w", None)}


def _ranking_case(spark):
    recommended = [("u1", i) for i in range(10)] + [("u2", i) for i in range(10)]
    relevant = [("u1", 0), ("u1", 1), ("u1", 50), ("u1", 51), ("u2", 3), ("u3", 1)]
    kind = "user string, item int"
    return (
        spark.createDataFrame(recommended, kind),
        spark.createDataFrame(relevant, kind),
        spark.createDataFrame([("u1", 7), ("u2", 7)], kind),
    )


def test_ranking_metrics(spark):
    recommended, relevant, train = _ranking_case(spark)
    mean_f1 = evaluation.ranking_mean_f1(recommended, relevant, train).first()
    assert [round(mean_f1[c], 4) for c in ("precision", "recall", "f1", "hit_rate")] == [0.15, 0.75, 0.2338, 1.0]
    of_means = evaluation.ranking_f1_of_means(recommended, relevant, train).first()
    assert [round(of_means[c], 4) for c in ("precision", "recall", "f1", "hit_rate")] == [0.15, 0.75, 0.25, 1.0]
    assert mean_f1["users"] == of_means["users"] == 2


def test_ranking_metrics_without_users(spark):
    recommended, relevant, _ = _ranking_case(spark)
    nobody = spark.createDataFrame([], "user string, item int")
    assert tuple(evaluation.ranking_mean_f1(recommended, relevant, nobody).first()) == (0, 0, 0, 0, 0)
    assert tuple(evaluation.ranking_f1_of_means(recommended, relevant, nobody).first()) == (0, 0, 0, 0, 0)


def test_pooled_metrics(spark):
    rows = spark.createDataFrame(
        [("a", 1, 1, 0.9), ("a", 2, 0, 0.6), ("b", 1, 1, 0.1)], "user string, item int, label int, score double"
    )
    top = spark.createDataFrame([("a", 1), ("b", 9)], "user string, item int")
    m = evaluation.pooled(rows, top).first()
    assert (m["precision"], m["recall"], m["f1"], m["hit_rate"], m["users"]) == (0.5, 0.5, 0.5, 0.5, 2)


def test_histograms(spark):
    df = numbers(spark, [0.0, 1.0, 2.0, 3.0, 4.0, None], "double")
    assert column(diagnostics.histogram(df, F.col("x"), 2), "rows", "bin") == [2, 3]
    same = numbers(spark, [7.0, 7.0], "double")
    assert column(diagnostics.histogram(same, F.col("x"), 3), "rows", "bin") == [0, 2, 0]


def test_cosine_with_a_zero_vector(spark):
    row = spark.sql("SELECT array(0D, 0D) AS a, array(1D, 2D) AS b")
    assert row.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == 0.0
    assert row.select(vectors.unit(F.col("a")).alias("c")).first()["c"] == [0.0, 0.0]


def test_text_precedence(spark):
    df = spark.createDataFrame(
        [(0, "t", "d"), (1, "", "d"), (2, None, "d"), (3, "[Missing Value]", "d"), (4, None, None)],
        "id int, text string, description string",
    )
    assert column(content.with_text(df), "combined_text") == ["t", "d", "d", "d"]
    kept = content.with_text(df, keep_placeholder=True)
    assert column(kept, "combined_text") == ["t", "d", "d", "[Missing Value]"]


def test_null_items_meet_in_the_review_join(spark):
    reviews = spark.createDataFrame([(1, None), (2, "a")], "id int, parent_asin string")
    meta = spark.createDataFrame([(None, "n"), ("a", "p"), ("a", "q")], "parent_asin string, description string")
    joined = content.review_meta(reviews, meta)
    assert sorted((r["id"], r["description"]) for r in joined.collect()) == [(1, "n"), (2, "p"), (2, "q")]


def test_missing_meta_text(spark):
    meta = spark.createDataFrame([("Red Games", None), (None, None)], "title string, description string")
    reviews = spark.createDataFrame([("a", None)], "title string, text string")
    cleaned_reviews, cleaned = cleaning.denoise(reviews, meta)
    assert {r["combined_cleaned_text"] for r in cleaned.collect()} == {"red game", ""}
    assert {r["description_cleaned"] for r in cleaned.collect()} == {"[Missing Value]"}
    assert cleaned_reviews.first()["text_cleaned"] == ""
