"""Controlled corruption of review and metadata tables.

Each step corrupts exactly ``int(share * n)`` rows, drawn independently of the
other steps. All samples of a table come from one histogram pass, and the
corruption itself is one projection that emits duplicated rows twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.hashing import coin
from gleaner.functions.text import typos
from gleaner.operators.ranking import exact_cutoffs, in_sample

# The share of rows each step touches, the typo rates per word, and
# the bad values written.
META_SHARES = {
    "title": 0.10,
    "description": 0.10,
    "average_rating": 0.05,
    "category_typos": 0.05,
    "price": 0.05,
    "duplicates": 0.05,
}
REVIEW_SHARES = {
    "rating_null": 0.10,
    "text": 0.10,
    "typos": 0.10,
    "timestamp": 0.05,
    "rating_range": 0.05,
    "helpful_vote": 0.05,
    "duplicates": 0.05,
}
CATEGORY_TYPO_RATE = 0.5
REVIEW_TYPO_RATE = 0.1
BAD_PRICES = (-1.0, 1000000.0)
BAD_RATINGS = (0.0, 6.0)
BAD_VOTE = -1
BAD_TIMESTAMP = -1
FUTURE_MS = 10000000000


def _corrupt(df: DataFrame, changes: Mapping[str, Column], twice: Column) -> DataFrame:
    """Apply the changes and emit the duplicated rows a second time, in one scan."""
    copies = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select(
        *[changes.get(c, F.col(c)).alias(c) for c in df.columns], F.explode(copies).alias("_copy")
    ).drop("_copy")


def noise_meta(df: DataFrame, key: Column, seed: int = 42, shares: Mapping[str, float] = META_SHARES) -> DataFrame:
    """Blank titles, null descriptions and ratings, category typos, absurd prices,
    and duplicated rows (copied after the corruption)."""
    cuts = exact_cutoffs(df, key, shares, seed)
    hit = {step: in_sample(cuts[step], step, key, seed) for step in shares}
    c = {name: F.col(name) for name in df.columns}
    changes: dict[str, Column] = {}
    if "title" in c:
        changes["title"] = F.when(hit["title"], F.lit("")).otherwise(c["title"])
    if "description" in c:
        changes["description"] = F.when(~hit["description"], c["description"])
    if "average_rating" in c:
        changes["average_rating"] = F.when(~hit["average_rating"], c["average_rating"])
    if "main_category" in c:
        changes["main_category"] = F.when(
            hit["category_typos"], typos(F.when(hit["category_typos"], c["main_category"]), CATEGORY_TYPO_RATE, seed, key)
        ).otherwise(c["main_category"])
    if "price" in c:
        bad = F.when(coin(seed, "price", key), F.lit(BAD_PRICES[0])).otherwise(F.lit(BAD_PRICES[1]))
        changes["price"] = F.when(hit["price"], bad).otherwise(c["price"])
    return _corrupt(df, changes, hit["duplicates"])


def noise_reviews(
    df: DataFrame,
    key: Column,
    as_of_ms: int,
    seed: int = 42,
    shares: Mapping[str, float] = REVIEW_SHARES,
) -> DataFrame:
    """Null and out-of-range ratings, blank text, typos, impossible timestamps and
    votes, and duplicated rows. An out-of-range rating may overwrite a null."""
    cuts = exact_cutoffs(df, key, shares, seed)
    hit = {step: in_sample(cuts[step], step, key, seed) for step in shares}
    changes: dict[str, Column] = {}
    if "rating" in df.columns:
        nulled = F.when(~hit["rating_null"], F.col("rating"))
        bad = F.when(coin(seed, "rating_range", key), F.lit(BAD_RATINGS[0])).otherwise(F.lit(BAD_RATINGS[1]))
        changes["rating"] = F.when(hit["rating_range"], bad).otherwise(nulled)
    if "text" in df.columns:
        blanked = F.when(hit["text"], F.lit("")).otherwise(F.col("text"))
        changes["text"] = F.when(
            hit["typos"], typos(F.when(hit["typos"], blanked), REVIEW_TYPO_RATE, seed, key)
        ).otherwise(blanked)
    if "title" in df.columns:
        changes["title"] = F.when(
            hit["typos"], typos(F.when(hit["typos"], F.col("title")), REVIEW_TYPO_RATE, seed + 1, key)
        ).otherwise(F.col("title"))
    if "timestamp" in df.columns:
        bad = F.when(coin(seed, "timestamp", key), F.lit(BAD_TIMESTAMP).cast("long")).otherwise(
            F.lit(as_of_ms + FUTURE_MS)
        )
        changes["timestamp"] = F.when(hit["timestamp"], bad).otherwise(F.col("timestamp"))
    if "helpful_vote" in df.columns:
        kind = df.schema["helpful_vote"].dataType
        changes["helpful_vote"] = F.when(hit["helpful_vote"], F.lit(BAD_VOTE).cast(kind)).otherwise(
            F.col("helpful_vote")
        )
    return _corrupt(df, changes, hit["duplicates"])
