"""Lemmas by a lexicon table: pairs written by hand."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import cleaning, lemmas
from test_golden import one
from gleaner.functions import text

NOUNS = """movie cookie series species headache wolf news lens box church bush class bus glass story boy man woman
waltz fox brush ash knife leaf roof quiz gas game tie zombie cliff""".split()
LISTED = {"knives": "knife", "leaves": "leaf", "mice": "mouse", "children": "child", "geese": "goose", "feet": "foot"}
PAIRS = {
    "movies": "movie",
    "cookies": "cookie",
    "series": "series",
    "species": "species",
    "headaches": "headache",
    "wolves": "wolf",
    "news": "news",
    "lens": "lens",
    "always": "always",
    "boxes": "box",
    "churches": "church",
    "bushes": "bush",
    "classes": "class",
    "glass": "glass",
    "bus": "bus",
    "buses": "bus",
    "stories": "story",
    "boys": "boy",
    "women": "woman",
    "men": "man",
    "waltzes": "waltz",
    "knives": "knife",
    "leaves": "leaf",
    "roofs": "roof",
    "cliffs": "cliff",
    "mice": "mouse",
    "children": "child",
    "ties": "tie",
    "unknowns": "unknowns",
    "les": "les",
    "games": "game",
}


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(w, None) for w in NOUNS] + list(LISTED.items()) + [("Boy", None), (None, None), ("", None)]
    return spark.createDataFrame(rows, "word string, lemma string")


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_pairs(spark, lexicon, limit, monkeypatch):
    monkeypatch.setattr(lemmas, "BLOCK", 3)
    texts = [(i, w, f"the {w} and {w}", "kept") for i, w in enumerate(PAIRS)] + [(99, None, "", None)]
    df = spark.createDataFrame(texts, "id int, word string, text string, lemma string").repartition(3)
    out = {r["id"]: r for r in lemmas.lemmatise(df, ["word", "text"], lemmas.lemma_table(lexicon), limit).collect()}
    for i, (word, lemma) in enumerate(PAIRS.items()):
        assert (out[i]["word"], out[i]["text"], out[i]["lemma"]) == (lemma, f"the {lemma} and {lemma}", "kept")
    assert (out[99]["word"], out[99]["text"], out[99]["lemma"]) == (None, "", None)


def test_a_noun_competes_with_its_own_stem(spark):
    words = spark.createDataFrame([("lens",), ("len",), ("glasses",), ("glass",)], "word string")
    table = {r["form"]: r["lemma"] for r in lemmas.lemma_table(words).collect()}
    assert table["lens"] == "len"
    assert table["glasses"] == "glass"
    assert "glass" not in table


def test_table_of_words_that_occur(spark, lexicon):
    words = spark.createDataFrame([("movies",), ("always",), ("boys",)], "word string")
    assert {r["form"] for r in lemmas.lemma_table(lexicon, words).collect()} == {"movies", "boys"}


def test_attested_words(spark):
    df = spark.createDataFrame([("a b  a", "c"), (None, "b"), ("", None)], "x string, y string")
    assert {r["word"] for r in lemmas.attested(df, "x", "y").collect()} == {"a", "b", "c"}


def test_cleaning_with_a_lexicon_table(spark, lexicon):
    reviews = spark.createDataFrame([("Movies!", "The wolves always read stories"), (None, None)], "title string, text string")
    meta = spark.createDataFrame([("Cookies", None)], "title string, description string")
    cleaned, described = cleaning.clean_texts(reviews, meta, lexicon=lexicon)
    assert [r["combined_cleaned_text"] for r in cleaned.collect()] == ["movie wolf always read story", ""]
    row = described.first()
    assert (row["title_cleaned"], row["description_cleaned"], row["combined_cleaned_text"]) == ("cookie", None, "cookie")


@pytest.mark.parametrize("word", ["movies", "cookies", "series", "species", "headaches", "wolves", "news", "lens", "always"])
def test_rules_alone_know_the_common_exceptions(spark, word):
    assert one(spark, text.singular(F.col("t")), t=word) == PAIRS[word]


def test_words_are_not_gathered(spark, lexicon):
    """Up to the bound the texts are not shuffled."""
    df = spark.range(10).select(F.lit("movies").alias("t"))
    plan = lemmas.lemmatise(df, ["t"], lemmas.lemma_table(lexicon))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
