"""Queries: tables written by the sinks and read back by the sources, and filters on noisy rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions.hashing import row_key
from gleaner.operators import content, ingest, neighbours, noise
from gleaner.operators import ground_truth as G
from gleaner.plans import sql as S
from gleaner.plans import views as V
from gleaner.plans.cleaning import AS_OF_MS, noisy_reviews_sql
from gleaner.plans.registry import query
from gleaner.schema import guess_layout
from gleaner.session import scratch_dir
from gleaner.sources import readers, writers


def _place(spark, name: str) -> str:
    """A new path for a table on its way through a sink and a source."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"


@query(
    "csv_stage",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CAST(n_chars AS VARCHAR) AS n_chars,
      CASE WHEN text NOT IN ('', 'nan', 'NA', 'null', 'None') THEN md5(text) END AS text_md5 FROM documents""",
)
def csv_stage(spark, sf_dir):
    """Documents through the CSV sink and the source that finds the first readable path."""
    path = _place(spark, "documents_ingested.csv")
    writers.write_csv(V.table(spark, sf_dir, "documents"), path)
    _, read = readers.read_first(spark, [f"{path}.gone.csv", path])
    kept = readers.read_columns(read, ["doc_id", "source", "n_chars", "text"])
    return kept.select("doc_id", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "json_stage",
    """SELECT conv_id, turn, role, md5(text) AS text_md5, 'lines' AS form FROM conversations
    UNION ALL SELECT conv_id, turn, role, md5(text), 'array' FROM conversations""",
)
def json_stage(spark, sf_dir):
    """Conversations as JSON lines, and as files of one JSON array each."""
    turns = V.table(spark, sf_dir, "conversations")
    schema = turns.schema
    lines, arrays = _place(spark, "turns.jsonl"), _place(spark, "turns.json")
    turns.write.json(lines)
    # Some conversations an array, one array a file.
    records = F.to_json(F.collect_list(F.struct(*turns.columns)))
    some = turns.groupBy(F.floor(F.col("conv_id") / 50)).agg(records.alias("value")).select("value")
    some.write.option("maxRecordsPerFile", 1).text(arrays)
    whole = readers.read_json_lines(spark, lines, schema).withColumn("form", F.lit("lines"))
    parts = readers.read_json(spark, arrays, schema)
    both = whole.unionByName(parts.withColumn("form", F.lit("array")))
    return both.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "form")


@query(
    "truth_stage",
    f"""WITH {S.INTERACTIONS}, baskets AS (SELECT DISTINCT user_id, parent_asin FROM interactions),
    truth AS (SELECT DISTINCT a.parent_asin AS item, b.parent_asin AS co_item
      FROM baskets a JOIN baskets b ON a.user_id = b.user_id AND a.parent_asin <> b.parent_asin)
    SELECT CAST(i.item AS VARCHAR) AS item, count(co_item) AS members,
      coalesce(CAST(sum(co_item) AS BIGINT), 0) AS id_sum
    FROM (SELECT DISTINCT parent_asin AS item FROM baskets) i LEFT JOIN truth t ON t.item = i.item GROUP BY i.item""",
)
def truth_stage(spark, sf_dir):
    """Co-purchase truth through the sink of JSON maps and back."""
    path = _place(spark, "truth")
    writers.write_truth(G.co_purchase_sets(V.interactions(spark, sf_dir)), path, line_items=500, compression="gzip")
    read = readers.read_truth(spark, path)
    return read.groupBy("item").agg(
        F.count("co_item").alias("members"), F.coalesce(F.sum(F.col("co_item").cast("long")), F.lit(0)).alias("id_sum")
    )


@query(
    "ingest_stage",
    f"""WITH {S.REVIEWS}, named AS (SELECT *, CAST(user_id AS VARCHAR) AS u FROM reviews)
    SELECT 'review' AS layout, rating, md5({S.scrub('title')}) AS title_md5, md5({S.scrub('text')}) AS text_md5,
      CAST(parent_asin AS VARCHAR) AS parent_asin, "timestamp",
      CASE WHEN u IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY u NULLS LAST) - 1 END AS user_id
    FROM named""",
)
def ingest_stage(spark, sf_dir):
    """A vendor's review file, its layout guessed from foreign headers, through ingest and back."""
    vendor = V.reviews(spark, sf_dir).select(
        F.col("rating").alias("Rating"), "title", "text", F.col("parent_asin").alias("parent-asin"), "user_id", F.col("timestamp").alias("TimeStamp")
    )
    path = _place(spark, "vendor.csv")
    writers.write_csv(vendor, path)
    target = ingest.ingest_file(spark, path, out_dir=path.rsplit("/", 1)[0])
    read = readers.read_file(spark, target)
    return read.select(
        F.lit(guess_layout(vendor.columns)).alias("layout"),
        F.col("rating").cast("double").alias("rating"),
        F.md5("title").alias("title_md5"),
        F.md5("text").alias("text_md5"),
        "parent_asin",
        F.col("timestamp").cast("long").alias("timestamp"),
        F.col("user_id").cast("long").alias("user_id"),
    )


@query(
    "noisy_ratings",
    f"""SELECT user_id AS "user", parent_asin AS item, rating FROM ({noisy_reviews_sql()})
    WHERE user_id IS NOT NULL AND parent_asin IS NOT NULL AND rating > 0""",
)
def noisy_ratings(spark, sf_dir):
    """Ratings that survive missing keys, missing ratings and ratings out of range."""
    noisy = noise.noise_reviews(V.reviews(spark, sf_dir), row_key("review_id"), AS_OF_MS)
    return neighbours.usable_ratings(noisy)


@query(
    "noisy_texts",
    f"""WITH described AS (SELECT p_partkey AS parent_asin, CASE WHEN p_partkey % 3 = 0 THEN text END AS description
      FROM part LEFT JOIN documents ON doc_id = p_partkey),
    j AS (SELECT review_id, coalesce(nullif(n.text, ''), nullif(description, ''), '') AS combined_text
      FROM ({noisy_reviews_sql()}) n LEFT JOIN described d ON n.parent_asin = d.parent_asin)
    SELECT review_id, md5(combined_text) AS text_md5 FROM j WHERE combined_text <> ''""",
)
def noisy_texts(spark, sf_dir):
    """Reviews left when blanked texts without a description are dropped."""
    noisy = noise.noise_reviews(V.reviews(spark, sf_dir), row_key("review_id"), AS_OF_MS)
    described = V.meta(spark, sf_dir).select(
        "parent_asin", F.when(F.col("parent_asin") % 3 == 0, F.col("description")).alias("description")
    )
    kept = content.with_text(content.review_meta(noisy, described))
    return kept.select("review_id", F.md5("combined_text").alias("text_md5"))
