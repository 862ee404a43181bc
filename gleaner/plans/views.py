"""The given tables seen as reviews, metadata, interactions and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.hashing import row_key
from gleaner.sources.readers import read_parquet

INTERACTION_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


# Tables whose rows carry the work: long texts, or the fact table.
HEAVY = ("documents", "pages", "conversations", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", spread=name in HEAVY)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: its customer, part and a 1-5 rating from the quantity."""
    lines = table(spark, sf_dir, "lineitem").select(*INTERACTION_KEY)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("parent_asin"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        *INTERACTION_KEY,
    )


def interaction_key() -> Column:
    """One string per interaction, spelled the same by every engine."""
    return row_key(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("long"),
        F.round(F.col("l_extendedprice") * 100).cast("long"),
    )


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document. Documents without a label have no rating; the event
    of the same number gives the user and the time."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "user_id", "ts")
    return (
        docs.join(labels, "doc_id", "left")
        .join(events, "doc_id", "left")
        .select(
            F.col("doc_id").alias("review_id"),
            (F.col("quality") * 4 + 1).cast("double").alias("rating"),
            F.col("source").alias("title"),
            "text",
            (F.col("n_chars") % 200).alias("parent_asin"),
            "user_id",
            epoch_ms("ts").alias("timestamp"),
            F.col("n_chars").cast("double").alias("helpful_vote"),
        )
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per part. The document of the same number is its description, so
    later parts have none."""
    parts = table(spark, sf_dir, "part")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    return parts.join(docs, "p_partkey", "left").select(
        F.col("p_partkey").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("main_category"),
        F.col("p_brand").alias("store"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").cast("double").alias("rating_number"),
        (F.col("p_size") / 10).alias("average_rating"),
        F.col("text").alias("description"),
        F.array("p_type", "p_brand").alias("categories"),
    )


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every tenth value and every seventh type missing."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"),
    )
