"""Rows on their way to Python: no null lists, and users over every core."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import joint_ranker, neighbours, rater_groups, scoring


def _null_lists(df):
    lists = [f.name for f in df.schema.fields if f.dataType.simpleString().startswith("array")]
    return [c for c in lists if df.filter(F.col(c).isNull()).count()]


def test_no_list_of_rater_groups_is_null(spark):
    rows = [(1, 1, 4.0), (2, 1, 5.0), (1, 2, 3.0), (1, 2, 2.0), (3, 2, 1.0)]
    cells = neighbours.rating_cells(spark.createDataFrame(rows, "user long, item long, rating double"))
    assert _null_lists(rater_groups._to_raters(cells, 2)) == []
    links = spark.createDataFrame([(0, [1], [2])], "group int, ask array<long>, users array<long>")
    assert _null_lists(rater_groups._rows(links, rater_groups.LINKS)) == []


def test_no_list_of_seen_items_is_null(spark):
    users = spark.createDataFrame([(1,), (2,)], "user long")
    seen = spark.createDataFrame([(1, 7)], "user long, item long")
    assert _null_lists(scoring._with_seen(users, None)) == []
    found = scoring._with_seen(users, seen)
    assert _null_lists(found) == []
    assert {r["user"]: r["seen"] for r in found.collect()} == {1: [7], 2: []}


@pytest.mark.parametrize("texts", [False, True])
def test_no_list_of_the_joint_ranker_is_null(spark, monkeypatch, texts):
    inner = joint_ranker._trainer

    def checked(*arguments):
        run = inner(*arguments)

        def watched(batches):
            def whole():
                for batch in batches:
                    batch = batch if isinstance(batch, pa.RecordBatch) else pa.RecordBatch.from_pandas(batch)
                    assert not [c for c in ("vector", "mean", "square", "text") if batch.column(c).null_count]
                    yield batch

            return run(whole())

        return watched

    monkeypatch.setattr(joint_ranker, "_trainer", checked)
    train = spark.range(60).selectExpr("id % 7 AS user", "id % 11 AS item", "CAST(id % 2 AS INT) AS label")
    described = spark.createDataFrame([(n, [1.0, n / 10]) for n in range(9)], "item long, vector array<double>") if texts else None
    ranker = joint_ranker.JointRanker.fit(train, described, embedding=4, hidden=[4], passes=1)
    assert ranker.users.count() == 7 and ranker.items.count() == 11
    assert {r["n"] for r in ranker.items.select(F.size("vector").alias("n")).collect()} == {6 if texts else 4}


def test_users_from_a_join_go_to_every_core(spark):
    """A join on the user, in as many partitions as there are cores, is no reason to use fewer."""
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(cores))
    try:
        vectors = spark.range(200).selectExpr("id AS user", "array(double(id), 1.0) AS vector")
        users = vectors.hint("merge").join(spark.range(150).withColumnRenamed("id", "user"), "user")
        items = spark.range(5).selectExpr("id AS item", "array(double(id), 2.0) AS vector")
        found = scoring.best_items(users, items, 2)
        assert found.rdd.getNumPartitions() == cores
        assert found.count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
