"""Readers and writers, round trips in a temporary folder."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.operators import ground_truth, ingest
from gleaner.schema import REVIEW_SCHEMA
from gleaner.sources import readers, split_csv, writers


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.csv").write_text('user_id,title,rating\nu1,"two\nlines, ""quoted""",4\nu2,,N/A\n')
    (tmp_path / "a.csv").write_text("user_id,title,rating\nu0,nan,2\n")
    (tmp_path / "c.json").write_text(json.dumps([{"user_id": "u3", "rating": 5}, {"user_id": "u4", "text": "t"}]))
    (tmp_path / "d.jsonl").write_text('{"user_id": "u5", "rating": 1}\n{"user_id": "u6"}\n')
    (tmp_path / "notes.txt").write_text("skip me")
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "e.csv").write_text("user_id\nu9\n")
    return str(tmp_path)


def test_csv_quotes_line_breaks_and_null_tokens(spark, folder):
    rows = {r["user_id"]: (r["title"], r["rating"]) for r in readers.read_csv(spark, f"{folder}/b.csv").collect()}
    assert rows == {"u1": ('two\nlines, "quoted"', "4"), "u2": (None, None)}


def test_directory_order_and_union(spark, folder):
    names = [p.rsplit("/", 1)[-1] for p in readers.list_files(spark, folder)]
    assert names == ["a.csv", "b.csv", "c.json", "d.jsonl"]
    table = readers.read_directory(spark, folder)
    assert {r["user_id"] for r in table.collect()} == {f"u{i}" for i in range(7)}
    assert {r["source_file"] for r in table.collect()} == set(names)
    split = readers.read_directory(spark, folder, split=True)
    assert sorted(map(str, split.collect())) == sorted(map(str, table.collect()))


def test_unsupported_and_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_file(spark, "x.xml")
    with pytest.raises(FileNotFoundError):
        readers.list_files(spark, str(tmp_path))


def test_column_selection_requires_columns(spark, folder):
    df = readers.read_csv(spark, f"{folder}/a.csv")
    assert readers.read_columns(df, ["rating"]).columns == ["rating"]
    with pytest.raises(ValueError):
        readers.read_columns(df, ["rating", "text"])


def test_first_readable_path(spark, folder):
    path, df = readers.read_first(spark, [f"{folder}/gone.csv", f"{folder}/a.csv"])
    assert path.endswith("a.csv") and df.count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, [f"{folder}/gone.csv"])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q', ["x", "y"]), (None, "", [])], "s string, t string, l array<string>")
    writers.write_csv(df, str(tmp_path / "out"))
    back = {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()}
    assert back == {("a,b", 'q"q', '["x","y"]'), (None, None, "[]")}


def test_stage_round_trip_keeps_types_and_empty_text(spark, tmp_path):
    df = spark.createDataFrame([(1.5, ""), (None, "t")], "rating double, text string")
    writers.write_stage(df, str(tmp_path / "stage"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "stage")).collect()} == {(1.5, ""), (None, "t")}


@pytest.mark.parametrize("line_items", [1, 2, 1000])
def test_truth_round_trip_over_several_lines(spark, tmp_path, line_items):
    rows = [("a", f"c{i}") for i in range(9)] + [("b", "a"), ("w", None)]
    truth = spark.createDataFrame(rows, "item string, co_item string")
    path = str(tmp_path / f"truth{line_items}")
    writers.write_truth(truth, path, line_items)
    back = readers.read_truth(spark, path)
    assert {(r["item"], r["co_item"]) for r in back.filter("co_item IS NOT NULL").collect()} == set(rows[:-1])
    assert {r["item"] for r in back.collect()} == {"a", "b", "w"}
    for line in spark.read.text(path).collect():
        assert len(json.loads(line["value"])) == 1


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_truth_sets_are_written_like_their_rows(spark, tmp_path, compression):
    bought = [(u, i) for u in range(3) for i in range(u, 9)] + [(7, 70_000), (8, 70_001), (8, 0), (None, 5), (9, None)]
    reviews = spark.createDataFrame(bought, "user_id long, parent_asin long")
    path = str(tmp_path / "sets")
    writers.write_truth(ground_truth.co_purchase_sets(reviews), path, 3, compression)
    rows = [tuple(r) for r in readers.read_truth(spark, path).collect()]
    expected = {tuple(None if x is None else str(x) for x in r) for r in ground_truth.co_purchases(reviews).collect()}
    assert len(rows) == len(set(rows)) and set(rows) == expected
    for line in spark.read.text(path).collect():
        ((_, members),) = json.loads(line["value"]).items()
        assert len(members) <= 3


def test_whole_document_truth(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"a": ["b", "c"], "w": []}, indent=2))
    back = readers.read_truth(spark, str(tmp_path / "t.json"), whole_document=True)
    assert {tuple(r) for r in back.collect()} == {("a", "b"), ("a", "c"), ("w", None)}


def test_ingest_writes_canonical_files(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(
        "User ID,rating,text,asin,extra\nzed,5,call 555-123-4567,0345339681,x\namy,bad,fine,B1,y\n"
    )
    written = ingest.ingest_directory(spark, str(tmp_path), layout="review", out_dir=str(tmp_path / "out"))
    assert [w.rsplit("/", 1)[-1] for w in written] == ["raw_ingested.csv"]
    back = readers.read_csv(spark, written[0])
    assert back.columns == REVIEW_SCHEMA.names
    rows = {r["user_id"]: r for r in back.collect()}
    assert rows["1"]["text"] == "call [REDACTED]" and rows["1"]["asin"] == "0345339681"
    assert rows["0"]["rating"] is None and rows["1"]["rating"] == "5.0"


def test_scratch_folder_comes_from_the_session(spark):
    from gleaner.session import materialize, scratch_dir

    assert scratch_dir(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    kept = materialize(spark.range(3).select(F.col("id")), "test")
    assert kept.count() == 3 and scratch_dir(spark) in kept.inputFiles()[0]


def test_endings_in_any_case_and_few_scans(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.{'CSV' if i % 2 else 'csv'}").write_text(f"user_id,rating\nu{i},{i}\n")
    for i in range(5):
        (tmp_path / f"g{i}.Csv").write_text(f"rating,title,user_id\n{i},t{i},v{i}\n")
        (tmp_path / f"h{i}.JSONL").write_text(f'{{"user_id": "w{i}"}}\n')
    table = readers.read_directory(spark, str(tmp_path))
    rows = {r["user_id"]: (r["rating"], r["title"], r["source_file"]) for r in table.collect()}
    assert len(rows) == 40
    assert rows["u7"] == ("7", None, "f7.CSV")
    assert rows["v2"] == ("2", "t2", "g2.Csv")
    assert rows["w4"] == (None, None, "h4.JSONL")
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3


def test_spaces_around_values_survive(spark, tmp_path):
    path = str(tmp_path / "spaces.csv")
    writers.write_csv(spark.createDataFrame([(" a ", "\tb\n")], "s string, t string"), path)
    assert tuple(readers.read_csv(spark, path).first()) == (" a ", "\tb\n")


@pytest.mark.parametrize("split_bytes", [64, 1000, 10**8])
def test_csv_with_line_breaks_is_read_in_splits(spark, tmp_path, split_bytes):
    draw = random.Random(split_bytes)
    fields = ["", "plain", '5" nail', '"a,b"', '"two\nlines, ""q"""', '"x\r\ny"', '"\n\n\n"', '" ""\n"', "\u00e9 \U0001f600", '"c" d']
    for f, end in enumerate(["\n", "\r\n"]):
        text = f'"id",title,"te""xt",n{end}'
        for i in range(60):
            text += f"{f}_{i},{draw.choice(fields)},{draw.choice(fields)},{i}{end}" + (end if draw.random() < 0.1 else "")
        (tmp_path / f"f{f}.csv").write_bytes(text.encode())
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path))
    settings = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": 0}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        if split_bytes < 1000:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        found = split_csv.read(spark, str(tmp_path), whole.schema)
        assert found.columns == ["id", "title", 'te"xt', "n"]
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_csv_of_a_header_or_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,title\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).collect() == []
    (tmp_path / "b.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).collect() == []


def test_csv_with_a_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,text\n1.5,"a\nb"\nbad,c\n2')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), StructType.fromDDL("n double, text string"))
    assert {tuple(r) for r in rows.collect()} == {(1.5, "a\nb"), (None, "c"), (2.0, None)}
