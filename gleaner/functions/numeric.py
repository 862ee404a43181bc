"""Number coercion, confidence weights, labels and outlier expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))$"


def to_number(column: Column | str, data_type: T.DataType | None = None) -> Column:
    """Double, with anything unreadable (and NaN) as null.

    The pattern keeps out the type suffixes (``1.0d``) that a JVM cast accepts. A
    column known to be numeric is spared the way through text.
    """
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(data_type, T.NumericType):
        number = c.cast("double")
    else:
        text = F.trim(c.cast("string"))
        number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def numbers_of(df: DataFrame, columns: Iterable[str]) -> dict[str, Column]:
    """Coercion of each of the columns that ``df`` has."""
    return {c: to_number(c, df.schema[c].dataType) for c in columns if c in df.columns}


def positive_label(rating: Column | str, threshold: float = 4.0) -> Column:
    """1 for a rating at or above ``threshold``, else 0; a null rating is 0."""
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.coalesce((r >= F.lit(threshold)).cast("int"), F.lit(0))


def confidence(rating: Column | str, alpha: float = 40.0) -> Column:
    """Implicit-feedback confidence ``1 + alpha * rating``, never below 0."""
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.greatest(F.lit(1.0) + F.lit(float(alpha)) * r, F.lit(0.0))


def outside(value: Column, low: float, high: float) -> Column:
    """True strictly beyond the bounds; a null value is not outside."""
    return F.coalesce((value < F.lit(low)) | (value > F.lit(high)), F.lit(False))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value limited to the bounds, null kept null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
