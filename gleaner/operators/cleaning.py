"""Missing values, outliers, text columns, and the three in sequence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numeric import clamp, numbers_of, outside
from gleaner.functions.text import as_text, clean_plain, combine
from gleaner.operators.lemmas import lemma_table
from gleaner.operators.lemmas import lemmatise as lemmatise_columns
from gleaner.operators.quantiles import ColumnStats, column_stats, stats_before_and_after_fill
from gleaner.schema import KEY_COLUMNS, string_columns

# The placeholder, the missing-text word and the whisker factor.
PLACEHOLDER = "[Missing Value]"
MISSING_WORD = "nan"
WHISKER = 1.5

# The columns each step works on.
REVIEW_NUMERIC = ("rating", "helpful_vote")
META_NUMERIC = ("average_rating", "rating_number", "price")
REVIEW_TEXT = ("title", "text")
META_TEXT = ("main_category", "title", "features", "description", "categories", "details", "store")


def _present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def null_counts(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """(column, nulls_before, nulls_after): before and after coercion, one scan."""
    numeric, text = _present(df, numeric), _present(df, text)
    numbers = numbers_of(df, numeric)
    after = {**{c: v.isNull() for c, v in numbers.items()}, **{c: _missing_text(F.col(c)) for c in text}}
    counted = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"b_{c}") for c in after],
        *[F.count_if(flag).alias(f"a_{c}") for c, flag in after.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"b_{c}").alias("nulls_before"),
                F.col(f"a_{c}").alias("nulls_after"),
            )
            for c in after
        ]
    )
    return counted.select(F.inline(rows))


def _missing_text(c: Column) -> Column:
    return c.isNull() | (c == F.lit(MISSING_WORD))


def _fill_text(df: DataFrame, text: list[str], placeholder: str) -> dict[str, Column]:
    out = {}
    for name in text:
        c = F.col(name).cast("string")
        out[name] = F.when(_missing_text(c), F.lit(placeholder)).otherwise(c)
    return out


def _fill_number(value: Column, stats: ColumnStats) -> Column:
    median = stats.quantiles.get(0.5)
    return value if median is None or not stats.nulls else F.coalesce(value, F.lit(median))


def fill_missing(
    df: DataFrame, numeric: list[str], text: list[str], placeholder: str = PLACEHOLDER
) -> DataFrame:
    """Numbers get their column's exact median, text gets the placeholder.

    Absent columns are skipped; a column with no value at all stays null. A name in
    both lists is treated as numeric.
    """
    numeric = _present(df, numeric)
    text = [c for c in _present(df, text) if c not in numeric]
    values = numbers_of(df, numeric)
    stats = column_stats(df, values, [0.5]) if numeric else {}
    filled = {c: _fill_number(values[c], stats[c]) for c in numeric}
    return df.withColumns({**filled, **_fill_text(df, text, placeholder)})


def whiskers(stats: ColumnStats) -> tuple[float, float] | None:
    """The outlier bounds, or None with fewer than two values."""
    if stats.rows < 2:
        return None
    q1, q3 = stats.quantiles[0.25], stats.quantiles[0.75]
    reach = WHISKER * (q3 - q1)
    return q1 - reach, q3 + reach


def _treat(value: Column, stats: ColumnStats, method: str) -> Column:
    bounds = whiskers(stats)
    if bounds is None:
        return value
    low, high = bounds
    if method == "whisker":
        return clamp(value, low, high)
    if method in ("median", "mean"):
        stand_in = stats.quantiles[0.5] if method == "median" else stats.mean
        return F.when(outside(value, low, high), F.lit(stand_in)).otherwise(value)
    return value  # an unknown method changes nothing; the outliers still count


def treat_outliers(df: DataFrame, numeric: list[str], method: str = "whisker") -> DataFrame:
    """Cap outliers at the whiskers, or replace them by the median or the mean."""
    values = numbers_of(df, numeric)
    if not values:
        return df
    stats = column_stats(df, values, [0.25, 0.5, 0.75])
    return df.withColumns({c: _treat(v, stats[c], method) for c, v in values.items()})


def outlier_counts(df: DataFrame, numeric: list[str]) -> DataFrame:
    """(column, outliers), and the total under the name ``total``, in one more pass."""
    values = numbers_of(df, numeric)
    stats = column_stats(df, values, [0.25, 0.75])
    bounds = {c: whiskers(stats[c]) for c in values}
    beyond = {c: outside(v, *bounds[c]) if bounds[c] else F.lit(False) for c, v in values.items()}
    counted = df.agg(*[F.count_if(flag).alias(c) for c, flag in beyond.items()])
    total = sum((F.col(c) for c in values), F.lit(0).cast("long"))
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in values]
    return counted.select(F.inline(F.array(*rows, F.struct(F.lit("total").alias("column"), total.alias("outliers")))))


def clean_text_columns(
    df: DataFrame,
    columns: tuple[str, ...],
    lemmatise: bool = True,
    lexicon: Mapping[str, str] | DataFrame | None = None,
) -> DataFrame:
    """Add ``<column>_cleaned`` for each column present, and their combination.

    With none of the columns present an existing ``combined_text`` is cleaned
    instead. A lexicon table (see ``lemmas.lemma_table``) settles every lemma; with a
    mapping, or none, the plural rules guess what it does not list.
    """
    by_table = lemmatise and isinstance(lexicon, DataFrame)
    by_rules, listed = lemmatise and not by_table, None if by_table else lexicon
    here = _present(df, columns)
    names = here or _present(df, ["combined_text"])
    if not names:
        return df
    cleaned = {f"{c}_cleaned": clean_plain(as_text(c, df.schema[c].dataType), by_rules, listed) for c in names}
    out = df.withColumns(cleaned)
    if by_table:
        out = lemmatise_columns(out, list(cleaned), lemma_table(lexicon))
    out = out.withColumn("combined_cleaned_text", combine([F.col(c) for c in cleaned]))
    return out if here else out.drop(*cleaned)


def clean_texts(
    reviews: DataFrame, meta: DataFrame, lemmatise: bool = True, lexicon: Mapping[str, str] | DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clean the review columns and the metadata columns.

    Missing metadata text adds nothing to the combination, and its own cleaned
    column is left null so that the next step fills in the placeholder.
    """
    cleaned_meta = clean_text_columns(meta, META_TEXT, lemmatise, lexicon)
    blanks = {
        f"{c}_cleaned": F.when(F.col(c).isNotNull(), F.col(f"{c}_cleaned")) for c in _present(meta, META_TEXT)
    }
    return (
        clean_text_columns(reviews, REVIEW_TEXT, lemmatise, lexicon),
        cleaned_meta.withColumns(blanks) if blanks else cleaned_meta,
    )


def fill_and_cap(
    df: DataFrame, numeric: tuple[str, ...], text: list[str], method: str = "whisker"
) -> DataFrame:
    """Impute, then treat outliers of the imputed values.

    The quartiles depend on the imputed median, but the order statistics of the imputed
    column are those of the column itself, moved by the nulls, so one search gives both.
    """
    values = numbers_of(df, numeric)
    out = _fill_text(df, [c for c in text if c not in values], PLACEHOLDER)
    stats = stats_before_and_after_fill(df, values, [0.25, 0.5, 0.75]) if values else {}
    for c, v in values.items():
        before, after = stats[c]
        out[c] = _treat(_fill_number(v, before), after, method)
    return df.withColumns(out) if out else df


def denoise(
    reviews: DataFrame,
    meta: DataFrame,
    lemmatise: bool = True,
    lexicon: Mapping[str, str] | DataFrame | None = None,
    fill_keys: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Text cleaning, then missing values, then outliers, for both tables.

    Key columns keep their nulls unless ``fill_keys``.
    """
    reviews, meta = clean_texts(reviews, meta, lemmatise, lexicon)
    skip = () if fill_keys else KEY_COLUMNS
    return (
        fill_and_cap(reviews, REVIEW_NUMERIC, string_columns(reviews, skip)),
        fill_and_cap(meta, META_NUMERIC, string_columns(meta, skip)),
    )
