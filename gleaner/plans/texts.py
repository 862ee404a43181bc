"""Queries: the numbers behind the comparison charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import diagnostics as D
from gleaner.plans import sql as S
from gleaner.plans import views as V
from gleaner.plans.registry import query

# A small polarity lexicon over words of the given texts.
POLARITY = {
    "the": 0.1372917,
    "and": 0.2118341,
    "of": -0.1130573,
    "to": 0.3174629,
    "in": -0.2231857,
    "is": 0.5090771,
    "for": 0.4016233,
    "with": 0.6072819,
    "on": -0.3071947,
    "was": -0.5038129,
    "by": 0.0531761,
    "this": -0.7012983,
    "le": 0.2517439,
    "de": -0.2573671,
    "und": 0.3530917,
    "que": -0.1514387,
}


def _documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def _cleaned(spark, sf_dir):
    return _documents(spark, sf_dir).withColumn("text", X.clean_plain("text", lemmatise=False))


_TEXT = "text"
_CLEANED = f"cleaned AS (SELECT doc_id, {S.clean_plain('text')} AS text FROM documents)"


@query(
    "variant_counts",
    """SELECT 'baseline' AS variant, count(*) AS rows FROM documents
    UNION ALL SELECT 'filtered', count(*) FROM documents JOIN labels USING (doc_id)""",
)
def variant_counts(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    kept = docs.join(V.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return D.variant_counts(baseline=docs, filtered=kept)


def _histogram_sql(values: str, bins: int) -> str:
    """``values`` selects one column x."""
    return f"""v AS ({values}), e AS (SELECT min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM v),
    b AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
      FROM v, e WHERE x IS NOT NULL GROUP BY 1)
    SELECT CAST(f.bin AS BIGINT) AS bin, round(lo + f.bin * (hi - lo) / {bins}, 4) AS low,
      round(lo + (f.bin + 1) * (hi - lo) / {bins}, 4) AS high, coalesce(n, 0) AS rows
    FROM range({bins}) f(bin) LEFT JOIN b ON b.bin = f.bin, e"""


def _edges(histogram):
    return histogram.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(
    "length_histogram",
    f"WITH {_histogram_sql(f'SELECT len({S.words(_TEXT)}) AS x FROM documents', 30)}",
)
def length_histogram(spark, sf_dir):
    return _edges(D.length_histogram(_documents(spark, sf_dir), "text"))


@query(
    "rating_histogram",
    f"WITH {S.INTERACTIONS}, {_histogram_sql('SELECT rating AS x FROM interactions', 20)}",
)
def rating_histogram(spark, sf_dir):
    return _edges(D.rating_histogram(V.interactions(spark, sf_dir)))


@query(
    "word_counts",
    f"""SELECT doc_id, len({S.words('text')}) AS words FROM documents""",
)
def word_counts(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", X.word_count("text").cast("long").alias("words"))


@query(
    "top_words",
    f"""WITH {_CLEANED},
    raw_words AS (SELECT unnest({S.words('text')}) AS word FROM documents),
    clean_words AS (SELECT unnest({S.words('text')}) AS word FROM cleaned)
    SELECT 'raw' AS variant, * FROM (SELECT word, count(*) AS n FROM raw_words GROUP BY word ORDER BY n DESC, word LIMIT 10)
    UNION ALL
    SELECT 'cleaned', * FROM (SELECT word, count(*) AS n FROM clean_words GROUP BY word ORDER BY n DESC, word LIMIT 10)""",
)
def top_words(spark, sf_dir):
    return D.variants(
        raw=D.top_words(_documents(spark, sf_dir), "text"), cleaned=D.top_words(_cleaned(spark, sf_dir), "text")
    )


@query(
    "word_weights",
    f"""WITH {_CLEANED}, w AS (SELECT word, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS word FROM cleaned)
      GROUP BY word)
    SELECT word, round(n / (SELECT max(n) FROM w), 4) AS weight FROM w""",
)
def word_weights(spark, sf_dir):
    return D.word_weights(_cleaned(spark, sf_dir), "text").withColumn("weight", F.round("weight", 4))


_LEXICON = "lexicon(word, polarity) AS (VALUES " + ", ".join(
    f"('{w}', {p}::DOUBLE)" for w, p in POLARITY.items()
) + ")"
_SCORED = """words AS (SELECT doc_id, unnest(regexp_split_to_array(
      regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+')) AS word FROM SOURCE),
  hits AS (SELECT doc_id, avg(polarity) AS p FROM words JOIN lexicon USING (word) GROUP BY doc_id),
  scored AS (SELECT doc_id, coalesce(p, 0) AS polarity FROM SOURCE LEFT JOIN hits USING (doc_id))"""


def _lexicon(spark):
    return spark.createDataFrame(list(POLARITY.items()), "word string, polarity double")


@query(
    "sentiment",
    f"""WITH {_LEXICON}, {_SCORED.replace('SOURCE', 'documents')}
    SELECT doc_id, round(polarity, 4) + 0.0::DOUBLE AS polarity FROM scored""",
)
def sentiment(spark, sf_dir):
    scored = D.sentiment(_documents(spark, sf_dir), "text", "doc_id", _lexicon(spark))
    return scored.withColumn("polarity", F.round("polarity", 4) + F.lit(0.0))


@query(
    "sentiment_histogram",
    f"""WITH {_LEXICON}, given AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
    {_SCORED.replace('SOURCE', 'given')}, {_histogram_sql('SELECT polarity AS x FROM scored', 20)}""",
)
def sentiment_histogram(spark, sf_dir):
    return _edges(D.sentiment_histogram(_documents(spark, sf_dir), "text", "doc_id", _lexicon(spark)))


@query("pca_points")
def pca_points(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return D.scatter_points(docs, _cleaned(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
