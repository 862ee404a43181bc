"""Texts cut once where fits scan them again, and lines that stay where they were read."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import diagnostics, features
from gleaner.operators import word_vectors as W
from gleaner.sources import split_csv


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_cleaning_sets_apart_what_the_tokeniser_does(spark):
    rows = [(" I cannot«wait»,　gonna\u0085go ٣3 éwanna ",), ("cannot cannots gotta\tGIMME",), (None,), (" ",)]
    df = spark.createDataFrame(rows, "t string")
    found = [r["o"] for r in df.select(text.clean_plain("t", False).alias("o")).collect()]
    assert found == ["« wait » gon na go éwanna", "cannots got ta gim", "", ""]
    # One pattern deletes punctuation and digits.
    assert "translate(" not in _plan(df.select(text.clean_plain("t", False)))


def test_scatter_cuts_texts_into_terms_once(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices(["red", "blue", "green", "box"], k=6))) for i in range(20)]
    docs = spark.createDataFrame([*rows, (20, None), (21, "")], "doc_id long, text string")
    cut = []
    monkeypatch.setattr(diagnostics, "terms", lambda c: cut.append(c) or features.terms(c))
    points = diagnostics.scatter_points(docs, docs.filter("doc_id < 5"), "text", "doc_id", max_terms=3)
    assert len(cut) == 1 and "regexp_extract_all" not in _plan(points)
    assert points.groupBy("variant").count().orderBy("variant").collect() == [("baseline", 21), ("filtered", 5)]


def test_idf_counts_every_text(spark):
    df = spark.createDataFrame([("aa aa bb",), ("bb",), ("",), (None,)], "t string")
    model = features.TfIdf.fit(df, "t", 2)
    assert model.vocabulary == ["aa", "bb"]
    assert model.idf == pytest.approx([1.9162907318741551, 1.5108256237659907])
    assert features.TfIdf.fit(df.limit(0), "t", 2) == features.TfIdf([], [])


def test_pairs_are_counted_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 7)
    monkeypatch.setattr(W, "PAIRED", 20)
    texts = [" ".join(random.Random(i).choices(["aa", "bb", "cc", "dé", "éé"], k=random.Random(i).randint(0, 40))) for i in range(30)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1)
    expected: dict = {}
    for words in map(str.split, texts):
        for i, a in enumerate(words):
            for j in range(max(0, i - 3), min(len(words), i + 4)):
                if i != j:
                    expected[a, words[j]] = expected.get((a, words[j]), 0) + 1
    counts = W.co_occurrences(df, "t", window=3)
    assert {(r["word"], r["context"]): r["n"] for r in counts.collect()} == expected
    assert "MapInArrow" in _plan(counts)
    weights = {(r["word"], r["context"]): r["weight"] for r in W.ppmi(counts).collect()}
    assert weights and all(weights[b, a] == w for (a, b), w in weights.items())


def test_lines_are_not_shuffled_to_their_splits(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    spark.createDataFrame([("x", 'two\nlines "quoted"'), ("y", "one")], "a string, b string").write.option("escape", '"').option("header", True).csv(path)
    found = split_csv.records(spark, path)
    assert found.count() == 3 + found.select("path").distinct().count() - 1
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert found.filter(F.col("value").contains("two\nlines")).count() == 1
