"""Turning a raw extract into a canonical, redacted table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import scrub_pii
from gleaner.operators.ranking import encode, sorted_ids
from gleaner.schema import KEY_COLUMNS, conform, guess_layout, map_headers, string_columns
from gleaner.sources.readers import list_files, read_file
from gleaner.sources.writers import ingested_name, write_csv


def canonicalise(
    df: DataFrame, layout: str | None = None, mapping: Mapping[str, str] | None = None
) -> DataFrame:
    """Guess the layout unless given, map the headers, and conform the columns."""
    layout = layout or guess_layout(df.columns)
    return conform(map_headers(df, layout, mapping), layout)


def pseudonymise(df: DataFrame, column: str = "user_id") -> DataFrame:
    """Replace a user name by its dense id in sorted order; null becomes -1."""
    ids = sorted_ids(df, column, "_code")
    order = df.columns
    coded = encode(df, ids, column, "_code")
    return coded.drop(column).withColumnRenamed("_code", column).select(*order)


def sanitise(df: DataFrame, redact_keys: bool = False) -> DataFrame:
    """Redact personal data in every text column and pseudonymise users.

    Ids are given from the original names, and key columns are left unredacted:
    a ten-digit product id would otherwise be taken for a phone number.
    """
    skip = ("user_id",) if redact_keys else KEY_COLUMNS
    clean = df.withColumns({c: scrub_pii(c) for c in string_columns(df, skip)})
    return pseudonymise(clean) if "user_id" in df.columns else clean


def ingest_file(
    spark: SparkSession,
    path: str,
    layout: str | None = None,
    out_dir: str | None = None,
    mapping: Mapping[str, str] | None = None,
) -> str:
    """Read, canonicalise, sanitise and write one file; returns the output path."""
    parent = out_dir or path.rsplit("/", 1)[0]
    target = f"{parent.rstrip('/')}/{ingested_name(path)}"
    write_csv(sanitise(canonicalise(read_file(spark, path), layout, mapping)), target)
    return target


def ingest_directory(
    spark: SparkSession, directory: str, layout: str | None = None, out_dir: str | None = None
) -> list[str]:
    """Ingest every supported file of a folder."""
    return [ingest_file(spark, p, layout, out_dir or directory) for p in list_files(spark, directory)]
