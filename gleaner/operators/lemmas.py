"""Noun lemmas from a lexicon table.

A word is reduced to a shorter one only where the lexicon holds that one; words without
an entry stay as they are. From the lexicon's nouns the forms that the detachment rules
lead back to them are formed once, so the table of forms is at most ``len(RULES)`` times
the lexicon, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize

# Endings of plural nouns and what takes their place, in order.
RULES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]
#: Forms that are sent to every task at most; a larger table is joined.
BROADCAST_FORMS = 2_000_000
#: Words of a text that are put together in one go when a table is joined.
BLOCK = 10_000


def attested(df: DataFrame, *columns: str) -> DataFrame:
    """(word): the distinct space-separated words of some text columns, a lexicon of the corpus itself."""
    words = F.concat(*[F.split(F.coalesce(F.col(c), F.lit("")), " ") for c in columns])
    return df.select(F.explode(F.array_distinct(words)).alias("word")).filter("word <> ''").distinct()


def lemma_table(lexicon: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(form, lemma) for every form whose lemma is another word.

    ``lexicon`` has the nouns as ``word``; a row with a ``lemma`` is an irregular form, not
    a noun. Of several lemmas the shortest counts, then that of the earlier rule; a form
    that is a noun itself competes as its own lemma, and irregular forms follow no rule.
    ``words`` (word) restricts the table to forms that occur.
    """
    entries = lexicon.select(F.lower("word").alias("word"), *([F.lower("lemma").alias("lemma")] if "lemma" in lexicon.columns else []))
    entries = entries.filter("word <> ''")
    regular = entries.filter("lemma IS NULL") if "lemma" in entries.columns else entries
    nouns = regular.select("word").distinct()
    word = F.col("word")
    forms: list[Column] = [F.struct(word.alias("form"), F.lit(0).alias("order"), F.lit(0).alias("irregular"))]
    for order, (ending, short) in enumerate(RULES, 1):
        form = F.concat(F.substring(word, F.lit(1), F.length(word) - len(short)), F.lit(ending))
        fits = word.endswith(short) & (F.length(word) >= len(short)) if short else F.lit(True)
        forms.append(F.when(fits, F.struct(form.alias("form"), F.lit(order).alias("order"), F.lit(0).alias("irregular"))))
    found = nouns.select(F.explode(F.array_compact(F.array(*forms))).alias("f"), word.alias("lemma"))
    found = found.select("f.form", "f.order", "f.irregular", "lemma")
    if "lemma" in entries.columns:
        listed = entries.filter("lemma IS NOT NULL").select(word.alias("form"), F.lit(0).alias("order"), F.lit(1).alias("irregular"), "lemma")
        found = found.unionByName(listed)
    if words is not None:
        found = found.join(words.select(F.col("word").alias("form")).distinct(), "form", "left_semi")
    rank = F.struct(F.length("lemma").alias("size"), F.col("order"), F.col("lemma"))
    direct = F.col("order") == 0  # the noun itself, or a listed lemma
    best = found.groupBy("form").agg(
        F.max("irregular").alias("irregular"), F.min(F.when(direct, rank)).alias("direct"), F.min(rank).alias("any")
    )
    lemma = F.when(F.col("irregular") == 1, F.col("direct.lemma")).otherwise(F.col("any.lemma"))
    return best.select("form", lemma.alias("lemma")).filter("form <> lemma")


def lemmatise(df: DataFrame, columns: list[str], table: DataFrame, limit: int = BROADCAST_FORMS) -> DataFrame:
    """Every space-separated word of the columns replaced by its lemma; nulls stay null.

    ``table`` is what ``lemma_table`` gives. Up to ``limit`` forms go to every task as one
    dictionary and the texts stay where they are; with more, words are joined with the
    table and put together again.
    """
    if not columns:
        return df
    table = materialize(table, "lemmas")
    if table.count() <= limit:
        return _by_dictionary(df, columns, table)
    return _by_join(df, columns, table)


def _by_dictionary(df: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
    pairs = table.toArrow()
    lemma = dict(zip(pairs.column("form").to_pylist(), pairs.column("lemma").to_pylist(), strict=True))
    shared = df.sparkSession.sparkContext.broadcast(lemma)

    def replaced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = shared.value.get
        for series in texts:
            yield series.map(lambda t: " ".join([get(w, w) for w in t.split(" ")]) if isinstance(t, str) else None)

    replace = F.pandas_udf(replaced, "string")
    return df.withColumns({c: replace(F.col(c)) for c in columns})


def _by_join(df: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
    # Written once, so that a row keeps its number.
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    cells = rows.select(
        "_row", F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.split(c, " ").alias("_w")) for i, c in enumerate(columns)]))
    ).filter("_w IS NOT NULL")
    starts = F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / BLOCK).cast("int"))
    blocks = cells.select(
        "_row", "_c", F.posexplode(F.transform(starts, lambda i: F.slice("_w", i * BLOCK + 1, F.lit(BLOCK)))).alias("_b", "_w")
    )
    words = blocks.select("_row", "_c", "_b", F.posexplode("_w").alias("_p", "form"))
    named = words.join(table, "form", "left").select("_row", "_c", "_b", "_p", F.coalesce("lemma", "form").alias("word"))
    listed = F.array_sort(F.collect_list(F.struct("_p", "word")))["word"]
    parts = named.groupBy("_row", "_c", "_b").agg(F.array_join(listed, " ").alias("text"))
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("_b", "text")))["text"], " ")
    texts = parts.groupBy("_row", "_c").agg(whole.alias("text"))
    wide = texts.groupBy("_row").agg(*[F.max(F.when(F.col("_c") == i, F.col("text"))).alias(f"_t{i}") for i in range(len(columns))])
    out = rows.join(wide, "_row", "left")
    return out.select(*[F.col(f"_t{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns])
