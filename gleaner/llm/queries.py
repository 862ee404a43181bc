"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import (
    bpe_tree,
    learned_ann,
    line_crf,
    near_dup,
    packing,
    piece_bpe,
    pseudonyms,
    ranked_search,
    repetition,
    revisits,
    suffix_dedup,
    token_links,
    toxicity,
)
from gleaner.llm.session_tools import documents, held_out_share, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@_query
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.coverage(documents(spark, sf_dir))


@_query
def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode(documents(spark, sf_dir))


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@_query
def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), percent=85)


@_query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, sf_dir)).drop("text")


@_query
def op4_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = held_out_share("doc_id", 5)
    scored = toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir), usable=share != 0)
    return scored.select("doc_id", (share == 0).alias("held_out"), "score", "predicted", "evidence")


@_query
def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = held_out_share("doc_id", 3)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = line_crf.quality(docs, labels(spark, sf_dir), usable=share != 1)
    return scored.select("doc_id", (share == 1).alias("held_out"), "score", "predicted")


@_query
def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.gleaner.pseudonym.key", "given tables")
    return pseudonyms.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key)


@_query
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return learned_ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


@_query
def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve(revisits.crawl_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))


SQL["op2_revisits"] = revisits.ORACLE


@_query
def op11_piece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(documents(spark, sf_dir))


@_query
def op12_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL["op12_k2_treap_search"] = ranked_search.ORACLE


@_query
def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.alignment(documents(spark, sf_dir))
