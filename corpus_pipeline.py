"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), decides over all documents its predecessor kept
and returns a DataFrame; all but the last keep the columns of ``documents``. ``run``
writes each stage's rows to the shared scratch folder and reads them for the next.

The stages handle odd rows as their operators say. Rows with equal ids count as one
document where documents are linked, and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import line_crf, near_dup, packing, pseudonyms, suffix_dedup
from gleaner.llm.session_tools import documents, labels, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain takes for good."""
    scored = line_crf.quality(docs, labels(spark, sf_dir), carried=tuple(COLUMNS[1:]))
    return scored.filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarities of 0.8 or more: that of the smallest id."""
    gone = near_dup.near_duplicates(docs, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that begin earlier."""
    cut = suffix_dedup.deduplicate(docs, ("lang", "source"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal values, by the session's key."""
    key = spark.conf.get("spark.gleaner.pseudonym.key", "given tables")
    moved = pseudonyms.pseudonymise(docs.select(*COLUMNS), key)
    return moved.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("best-fit packing", packed),
]

#: No stage can be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    rows = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = materialize(rows, f"stage-{name.replace(' ', '-')}")
    return rows
