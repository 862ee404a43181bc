"""Queries: canonical layout, redaction, noise, text cleaning, imputation, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.hashing import row_key
from gleaner.functions.numeric import to_number
from gleaner.operators import cleaning as C
from gleaner.operators import ingest, lemmas, noise, ranking
from gleaner.plans import sql as S
from gleaner.plans import views as V
from gleaner.plans.registry import query
from gleaner.session import materialize
from gleaner.sources.readers import null_tokens

AS_OF_MS = 1_704_067_200_000  # 2024-01-01


def _bounds(column: str, source: str) -> str:
    return (
        f"SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3, "
        f"median({column}) AS mid, avg({column}) AS mean FROM {source}"
    )


@query(
    "impute_median",
    f"""WITH {S.GAPPY}
    SELECT event_id, user_id, coalesce(event_type, '[Missing Value]') AS event_type,
           round(coalesce(value, (SELECT median(value) FROM gappy)), 4) AS value
    FROM gappy""",
)
def impute_median(spark, sf_dir):
    filled = C.fill_missing(V.gappy_events(spark, sf_dir), ["value"], ["event_type"])
    return filled.withColumn("value", F.round("value", 4))


@query(
    "null_counts",
    f"""WITH {S.GAPPY}
    SELECT 'value' AS "column", count(*) FILTER (value IS NULL) AS nulls_before,
           count(*) FILTER (value IS NULL) AS nulls_after FROM gappy
    UNION ALL
    SELECT 'event_type', count(*) FILTER (event_type IS NULL), count(*) FILTER (event_type IS NULL)
    FROM gappy""",
)
def null_counts(spark, sf_dir):
    return C.null_counts(V.gappy_events(spark, sf_dir), ["value"], ["event_type"])


def _cap_sql(treated: str) -> str:
    return f"""WITH {S.GAPPY}, s AS ({_bounds('value', 'gappy')}),
    b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, mid, mean FROM s)
    SELECT event_id, user_id, event_type, round({treated}, 4) AS value FROM gappy, b"""


def _cap(spark, sf_dir, method):
    treated = C.treat_outliers(V.gappy_events(spark, sf_dir), ["value"], method)
    return treated.withColumn("value", F.round("value", 4))


@query(
    "cap_iqr_whisker",
    _cap_sql("CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END"),
)
def cap_iqr_whisker(spark, sf_dir):
    return _cap(spark, sf_dir, "whisker")


@query("cap_iqr_median", _cap_sql("CASE WHEN value < lo OR value > hi THEN mid ELSE value END"))
def cap_iqr_median(spark, sf_dir):
    return _cap(spark, sf_dir, "median")


@query("cap_iqr_mean", _cap_sql("CASE WHEN value < lo OR value > hi THEN mean ELSE value END"))
def cap_iqr_mean(spark, sf_dir):
    return _cap(spark, sf_dir, "mean")


def _count_outliers(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) FILTER (
      {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM {source}, ({_bounds(column, source)})"""


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "outlier_counts",
    f"""WITH c AS ({' UNION ALL '.join(_count_outliers(c, 'lineitem') for c in _LINE_NUMBERS)}
      UNION ALL {_count_outliers('value', 'events')})
    SELECT "column", outliers FROM c
    UNION ALL SELECT 'total', CAST(sum(outliers) AS BIGINT) FROM c WHERE "column" <> 'value'
    UNION ALL SELECT 'total', CAST(sum(outliers) AS BIGINT) FROM c WHERE "column" = 'value'""",
)
def outlier_counts(spark, sf_dir):
    lines = C.outlier_counts(V.table(spark, sf_dir, "lineitem"), _LINE_NUMBERS)
    return lines.unionByName(C.outlier_counts(V.table(spark, sf_dir, "events"), ["value"]))


@query(
    "canonicalise",
    """SELECT p_type AS main_category, p_name AS title, CAST(NULL AS DOUBLE) AS average_rating,
      CAST(p_size AS DOUBLE) AS rating_number, CAST(NULL AS VARCHAR) AS features,
      CAST(NULL AS VARCHAR) AS description, p_retailprice AS price, CAST(NULL AS VARCHAR) AS images,
      CAST(NULL AS VARCHAR) AS videos, p_brand AS store, CAST(NULL AS VARCHAR) AS categories,
      CAST(NULL AS VARCHAR) AS details, CAST(p_partkey AS VARCHAR) AS parent_asin,
      CAST(NULL AS VARCHAR) AS bought_together
    FROM part""",
)
def canonicalise(spark, sf_dir):
    vendor = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("parentAsin"),
        F.col("p_name").alias("Title"),
        F.col("p_type").alias("main-category"),
        F.col("p_brand").alias("Store"),
        F.col("p_retailprice").cast("string").alias("PRICE"),
        F.col("p_size").alias("rating_numbr"),
        F.lit(1).alias("warehouse"),
    )
    return ingest.canonicalise(vendor, "meta")


@query(
    "numeric_coerce",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'N/A' WHEN event_id % 13 = 0 THEN '1.0d'
        WHEN event_id % 17 = 0 THEN 'nan' WHEN event_id % 19 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS raw
      FROM events)
    SELECT event_id, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL
      ELSE round(TRY_CAST(raw AS DOUBLE), 4) END AS value FROM t""",
)
def numeric_coerce(spark, sf_dir):
    n = F.col("event_id")
    raw = (
        F.when(n % 11 == 0, "N/A")
        .when(n % 13 == 0, "1.0d")
        .when(n % 17 == 0, "nan")
        .when(n % 19 == 0, "")
        .otherwise(F.col("value").cast("string"))
    )
    texts = null_tokens(V.table(spark, sf_dir, "events").select("event_id", raw.alias("raw")))
    return texts.select("event_id", F.round(to_number("raw"), 4).alias("value"))


@query("scrub_pii", f"SELECT doc_id, {S.scrub('text')} AS text FROM documents")
def scrub_pii(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", X.scrub_pii("text").alias("text"))


@query(
    "pseudonymise_user",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS u
      FROM orders)
    SELECT o_orderkey, CASE WHEN u IS NULL THEN -1
      ELSE dense_rank() OVER (ORDER BY u NULLS LAST) - 1 END AS user_id FROM t""",
)
def pseudonymise_user(spark, sf_dir):
    named = V.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("user_id")
    )
    return ingest.pseudonymise(named)


@query(
    "sanitise",
    f"""WITH {S.REVIEWS}, named AS (SELECT *, CAST(user_id AS VARCHAR) AS u FROM reviews)
    SELECT review_id, {S.scrub('title')} AS title, {S.scrub('text')} AS text,
      CASE WHEN u IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY u NULLS LAST) - 1 END AS user_id
    FROM named""",
)
def sanitise(spark, sf_dir):
    named = V.reviews(spark, sf_dir).select(
        "review_id", "title", "text", F.col("user_id").cast("string").alias("user_id")
    )
    return ingest.sanitise(named)


_KEY_SQL = ", ".join(V.INTERACTION_KEY)


@query(
    "first_seen_ids",
    f"""WITH {S.INTERACTIONS},
    first AS (SELECT parent_asin, min(ROW({_KEY_SQL})) AS k, count(*) AS n FROM interactions GROUP BY ALL)
    SELECT parent_asin, row_number() OVER (ORDER BY k, parent_asin) - 1 AS item_id, n AS rows FROM first""",
)
def first_seen_ids(spark, sf_dir):
    rows = V.interactions(spark, sf_dir)
    ids = ranking.first_seen_ids(rows, "parent_asin", V.INTERACTION_KEY, "item_id")
    by_id = ranking.encode(rows, ids, "parent_asin", "item_id").groupBy("item_id").agg(F.count("*").alias("rows"))
    return ranking.decode(by_id, ids, "item_id")


@query(
    "sorted_ids",
    f"""WITH {S.INTERACTIONS}
    SELECT CAST(parent_asin AS VARCHAR) AS parent_asin,
      row_number() OVER (ORDER BY CAST(parent_asin AS VARCHAR)) - 1 AS item_id
    FROM (SELECT DISTINCT parent_asin FROM interactions)""",
)
def sorted_ids(spark, sf_dir):
    names = V.interactions(spark, sf_dir).select(F.col("parent_asin").cast("string").alias("parent_asin"))
    return ranking.sorted_ids(names, "parent_asin", "item_id")


@query("clean_text_plain", f"SELECT doc_id, {S.clean_plain('text')} AS cleaned FROM documents")
def clean_text_plain(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.clean_plain("text", lemmatise=False).alias("cleaned"))


@query("clean_text_markup", f"SELECT page_id, {S.clean_markup('html')} AS cleaned FROM pages")
def clean_text_markup(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return pages.select("page_id", X.clean_markup("html", lemmatise=False).alias("cleaned"))


@query(
    "lemmatise",
    f"""WITH c AS (SELECT doc_id, string_split({S.clean_plain('text')}, ' ') AS w FROM documents)
    SELECT doc_id, coalesce(array_to_string(list_transform(w, lambda x: {S.lemma('x')}), ' '), '') AS cleaned
    FROM c""",
)
def lemmatise(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.clean_plain("text").alias("cleaned"))


@query(
    "lemmatise_lexicon",
    f"""WITH c AS (SELECT doc_id, {S.clean_plain('text')} AS t FROM documents),
    lex AS (SELECT DISTINCT unnest(string_split(t, ' ')) AS w FROM c),
    forms AS (
      SELECT w AS form, w AS lemma, 0 AS o FROM lex
      UNION ALL SELECT w || 's', w, 1 FROM lex
      UNION ALL SELECT w || 'es', w, 2 FROM lex WHERE w LIKE '%s'
      UNION ALL SELECT left(w, length(w) - 1) || 'ves', w, 3 FROM lex WHERE w LIKE '%f'
      UNION ALL SELECT w || 'es', w, 4 FROM lex WHERE w LIKE '%x'
      UNION ALL SELECT w || 'es', w, 5 FROM lex WHERE w LIKE '%z'
      UNION ALL SELECT w || 'es', w, 6 FROM lex WHERE w LIKE '%ch'
      UNION ALL SELECT w || 'es', w, 7 FROM lex WHERE w LIKE '%sh'
      UNION ALL SELECT left(w, length(w) - 3) || 'men', w, 8 FROM lex WHERE w LIKE '%man'
      UNION ALL SELECT left(w, length(w) - 1) || 'ies', w, 9 FROM lex WHERE w LIKE '%y'),
    named AS (SELECT form, lemma FROM forms WHERE lemma <> '' AND form IN (SELECT w FROM lex)
      QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(lemma), o, lemma) = 1),
    words AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w,
        unnest(range(len(string_split(t, ' ')))) AS p FROM c)
    SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY p) AS cleaned
    FROM words LEFT JOIN named ON form = w GROUP BY doc_id""",
)
def lemmatise_lexicon(spark, sf_dir):
    """Lemmas settled by the words that the documents themselves attest."""
    docs = V.table(spark, sf_dir, "documents")
    cleaned = materialize(docs.select("doc_id", X.clean_plain("text", lemmatise=False).alias("cleaned")), "cleaned")
    words = materialize(lemmas.attested(cleaned, "cleaned"), "words")
    return lemmas.lemmatise(cleaned, ["cleaned"], lemmas.lemma_table(words, words))


def _combined_sql(parts: list[str]) -> str:
    return S.squash(f"concat_ws(' ', {', '.join(parts)})")


@query(
    "clean_reviews",
    f"""WITH {S.REVIEWS}, c AS (SELECT review_id, {S.clean_plain('title')} AS title_cleaned,
      {S.clean_plain('text')} AS text_cleaned FROM reviews)
    SELECT *, {_combined_sql(['title_cleaned', 'text_cleaned'])} AS combined_cleaned_text FROM c""",
)
def clean_reviews(spark, sf_dir):
    cleaned, _ = C.clean_texts(V.reviews(spark, sf_dir), V.meta(spark, sf_dir), lemmatise=False)
    return cleaned.select("review_id", "title_cleaned", "text_cleaned", "combined_cleaned_text")


_META_TEXT = ["main_category", "title", "description", "categories", "store"]


@query(
    "clean_meta",
    f"""WITH {S.META}, c AS (SELECT parent_asin,
      {', '.join(f'CASE WHEN {c} IS NOT NULL THEN {S.clean_plain(c)} END AS {c}_cleaned' for c in _META_TEXT)}
      FROM meta)
    SELECT *, {_combined_sql([f'{c}_cleaned' for c in _META_TEXT])} AS combined_cleaned_text FROM c""",
)
def clean_meta(spark, sf_dir):
    _, cleaned = C.clean_texts(V.reviews(spark, sf_dir), V.meta(spark, sf_dir), lemmatise=False)
    return cleaned.select("parent_asin", *[f"{c}_cleaned" for c in _META_TEXT], "combined_cleaned_text")


@query(
    "clean_combined_fallback",
    f"""SELECT conv_id, turn, text AS combined_text, {S.squash(S.clean_plain('text'))} AS combined_cleaned_text
    FROM conversations""",
)
def clean_combined_fallback(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("combined_text"))
    return C.clean_text_columns(rows, C.REVIEW_TEXT, lemmatise=False)


def noisy_reviews_sql() -> str:
    key = "CAST(review_id AS VARCHAR)"
    flags = ", ".join(f"{S.drawn(42, s, key, p)} AS hit_{s}" for s, p in noise.REVIEW_SHARES.items())
    blanked = "(CASE WHEN hit_text THEN '' ELSE text END)"
    return f"""WITH {S.REVIEWS}, f AS (SELECT *, {key} AS k, {flags} FROM reviews),
    n AS (SELECT review_id,
      CASE WHEN hit_rating_range THEN CASE WHEN {S.heads(42, 'rating_range', 'k')} THEN 0.0::DOUBLE ELSE 6.0::DOUBLE END
           WHEN hit_rating_null THEN NULL ELSE rating END AS rating,
      CASE WHEN hit_typos THEN {S.typo('title', noise.REVIEW_TYPO_RATE, 43, 'k')} ELSE title END AS title,
      CASE WHEN hit_typos THEN {S.typo(blanked, noise.REVIEW_TYPO_RATE, 42, 'k')} ELSE {blanked} END AS text,
      parent_asin, user_id,
      CASE WHEN hit_timestamp THEN CASE WHEN {S.heads(42, 'timestamp', 'k')} THEN -1
           ELSE {AS_OF_MS + noise.FUTURE_MS} END ELSE "timestamp" END AS "timestamp",
      CASE WHEN hit_helpful_vote THEN -1.0::DOUBLE ELSE helpful_vote END AS helpful_vote,
      hit_duplicates FROM f)
    SELECT * EXCLUDE (hit_duplicates) FROM n
    UNION ALL SELECT * EXCLUDE (hit_duplicates) FROM n WHERE hit_duplicates"""


@query("noise_reviews", noisy_reviews_sql())
def noise_reviews(spark, sf_dir):
    return noise.noise_reviews(V.reviews(spark, sf_dir), row_key("review_id"), AS_OF_MS)


def _noisy_meta_sql() -> str:
    key = "CAST(parent_asin AS VARCHAR)"
    flags = ", ".join(f"{S.drawn(42, s, key, p)} AS hit_{s}" for s, p in noise.META_SHARES.items())
    return f"""WITH {S.META}, f AS (SELECT *, {key} AS k, {flags} FROM meta),
    n AS (SELECT parent_asin, CASE WHEN hit_title THEN '' ELSE title END AS title,
      CASE WHEN hit_category_typos THEN {S.typo('main_category', noise.CATEGORY_TYPO_RATE, 42, 'k')}
           ELSE main_category END AS main_category, store,
      CASE WHEN hit_price THEN CASE WHEN {S.heads(42, 'price', 'k')} THEN -1.0::DOUBLE ELSE 1000000.0::DOUBLE END
           ELSE price END AS price,
      rating_number, CASE WHEN NOT hit_average_rating THEN average_rating END AS average_rating,
      CASE WHEN NOT hit_description THEN description END AS description, hit_duplicates FROM f)
    SELECT * EXCLUDE (hit_duplicates) FROM n
    UNION ALL SELECT * EXCLUDE (hit_duplicates) FROM n WHERE hit_duplicates"""


@query("noise_meta", _noisy_meta_sql())
def noise_meta(spark, sf_dir):
    return noise.noise_meta(V.meta(spark, sf_dir).drop("categories"), row_key("parent_asin"))


@query(
    "noise_typos",
    f"""SELECT doc_id, {S.typo('text', 0.5, 7, 'CAST(doc_id AS VARCHAR)')} AS text FROM documents""",
)
def noise_typos(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.typos("text", 0.5, 7, row_key("doc_id")).alias("text"))


@query(
    "exact_sample",
    f"""WITH {S.INTERACTIONS}, s AS (SELECT user_id, parent_asin, rating, row_key,
      {S.drawn(42, 'sample', 'row_key', 0.05)} AS hit FROM interactions)
    SELECT user_id, parent_asin, rating, row_key FROM s WHERE hit""",
)
def exact_sample(spark, sf_dir):
    rows = V.interactions(spark, sf_dir).withColumn("row_key", V.interaction_key())
    sampled = ranking.exact_sample(rows, F.col("row_key"), 0.05)
    return sampled.select("user_id", "parent_asin", "rating", "row_key")


@query(
    "fixed_sample",
    f"""SELECT doc_id, lang FROM documents
    ORDER BY {S.draw(42, 'fixed', 'CAST(doc_id AS VARCHAR)')}, CAST(doc_id AS VARCHAR) LIMIT 500""",
)
def fixed_sample(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ranking.fixed_sample(docs, row_key("doc_id"), 500)


def _filled_and_capped(column: str, source: str) -> tuple[str, str]:
    """CTEs computing a column's median and then its bounds, and the final expression."""
    filled = f"coalesce({column}, (SELECT median({column}) FROM {source}))"
    ctes = f"""b_{column} AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
      SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM (SELECT {filled} AS v FROM {source})))"""
    final = (
        f"round(least(greatest({filled}, (SELECT lo FROM b_{column})), (SELECT hi FROM b_{column})), 4) "
        f"AS {column}"
    )
    return ctes, final


def _denoise_reviews_sql() -> str:
    ctes, finals = zip(*[_filled_and_capped(c, "c") for c in C.REVIEW_NUMERIC])
    texts = ["title", "text", "title_cleaned", "text_cleaned", "combined_cleaned_text"]
    filled = ", ".join(
        f"CASE WHEN {t} IS NULL OR {t} = 'nan' THEN '[Missing Value]' ELSE {t} END AS {t}" for t in texts
    )
    return f"""WITH {S.REVIEWS},
    a AS (SELECT *, {S.clean_plain('title')} AS title_cleaned, {S.clean_plain('text')} AS text_cleaned
          FROM reviews),
    c AS (SELECT *, {_combined_sql(['title_cleaned', 'text_cleaned'])} AS combined_cleaned_text FROM a),
    {', '.join(ctes)}
    SELECT review_id, parent_asin, user_id, "timestamp", {', '.join(finals)}, {filled} FROM c"""


@query("denoise_reviews", _denoise_reviews_sql())
def denoise_reviews(spark, sf_dir):
    cleaned, _ = C.denoise(V.reviews(spark, sf_dir), V.meta(spark, sf_dir), lemmatise=False)
    return cleaned.withColumns({c: F.round(c, 4) for c in C.REVIEW_NUMERIC})


def _denoise_meta_sql() -> str:
    ctes, finals = zip(*[_filled_and_capped(c, "c") for c in C.META_NUMERIC])
    texts = [t for c in _META_TEXT for t in ((f"{c}_cleaned",) if c == "categories" else (c, f"{c}_cleaned"))]
    texts.append("combined_cleaned_text")
    filled = ", ".join(
        f"CASE WHEN {t} IS NULL OR {t} = 'nan' THEN '[Missing Value]' ELSE {t} END AS {t}" for t in texts
    )
    cleaned = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {S.clean_plain(c)} END AS {c}_cleaned" for c in _META_TEXT
    )
    return f"""WITH {S.META}, a AS (SELECT *, {cleaned} FROM meta),
    c AS (SELECT *, {_combined_sql([f'{c}_cleaned' for c in _META_TEXT])} AS combined_cleaned_text FROM a),
    {', '.join(ctes)}
    SELECT parent_asin, {', '.join(finals)}, {filled} FROM c"""


@query("denoise_meta", _denoise_meta_sql())
def denoise_meta(spark, sf_dir):
    _, cleaned = C.denoise(V.reviews(spark, sf_dir), V.meta(spark, sf_dir), lemmatise=False)
    return cleaned.drop("categories").withColumns({c: F.round(c, 4) for c in C.META_NUMERIC})
