"""Reading CSV, JSON and JSON-lines extracts, directories and truth maps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.schema import require_columns
from gleaner.sources import split_csv

# The texts read as missing, and the supported file endings in scan order.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
EXTENSIONS = (".csv", ".json", ".jsonl", ".ndjson")


def null_tokens(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Missing-value texts become null in every string column."""
    listed = list(tokens)
    return df.select(
        *[
            F.when(~F.col(f.name).isin(listed), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multi_line: bool = True,
    empty_as_null: bool = True,
    split: bool = True,
    path_column: str | None = None,
) -> DataFrame:
    """CSV with a header. Without a schema every column is read as text.

    Quoted fields may hold line breaks; a file is read by many tasks all the same, in three
    scans (``split_csv``). ``split=False`` reads each file by one task in one scan, for many
    small files; files known to have no such breaks are split in one: ``multi_line=False``.
    ``path_column`` adds the file a row comes from.
    """
    reader = spark.read.options(header=True, **split_csv.OPTIONS)
    if multi_line and split:
        # Only the header of one file is read for the names.
        layout = schema or reader.option("multiLine", True).csv(path).schema
        df = split_csv.read(spark, path, layout, path_column)
    else:
        reader = reader.option("multiLine", multi_line)
        df = (reader.schema(schema) if schema is not None else reader).csv(path)
        if path_column:
            df = df.withColumn(path_column, F.input_file_name())
    return null_tokens(df, [t for t in NULL_TOKENS if t or empty_as_null])


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """A file holding one JSON array of records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """One JSON record per line; large files are split over tasks."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Pick the reader from the file ending."""
    name = path.lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, schema)
    if name.endswith(".json"):
        return read_json(spark, path, schema)
    if name.endswith((".jsonl", ".ndjson")):
        return read_json_lines(spark, path, schema)
    raise ValueError(f"unsupported file type: {path}")


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Supported files directly inside ``directory``, by ending and then by name.

    Endings are compared without case. Only file metadata is read.
    """
    anyhow = ["".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in EXTENSIONS]
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(anyhow) + "}").load(directory)
    paths = sorted(row["path"] for row in listed.select("path").collect())
    found = [p for ext in EXTENSIONS for p in paths if p.lower().endswith(ext)]
    if not found:
        raise FileNotFoundError(f"no supported files in {directory}")
    return found


def _first_line(spark: SparkSession, path: str) -> str:
    """The header of a CSV file; a few kilobytes are read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def read_directory(
    spark: SparkSession, directory: str, source_column: str | None = "source_file", split: bool = False
) -> DataFrame:
    """All supported files of a folder as one table; absent columns are null.

    CSV files of one header are one read, JSON files of one ending are one read, so the
    plan has as many scans as there are layouts. ``split`` is for folders of large CSV files
    (``read_csv``); it takes more scans a layout.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for path in list_files(spark, directory):
        ext = next(e for e in EXTENSIONS if path.lower().endswith(e))
        header = _first_line(spark, path) if ext == ".csv" else ""
        groups.setdefault((ext, header), []).append(path)
    readers = {".json": read_json, ".jsonl": read_json_lines, ".ndjson": read_json_lines}
    out = None
    for (ext, _), paths in groups.items():
        if ext == ".csv":
            part = read_csv(spark, paths, split=split, path_column=source_column)
        else:
            part = readers[ext](spark, paths)
            if source_column:
                part = part.withColumn(source_column, F.input_file_name())
        if source_column:
            part = part.withColumn(source_column, F.element_at(F.split(source_column, "/"), -1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_parquet(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table.

    A task reads whole row groups, so a small file is read by one task and all that
    follows stays in it. ``spread`` deals the rows of a table with fewer splits than
    cores over the cores; a table large enough to fill them is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:  # plan metadata only, no rows read
        return df.repartition(cores)
    return df


def read_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only these columns; a missing one is an error."""
    return require_columns(df, columns).select(*columns)


def read_first(spark: SparkSession, paths: Iterable[str]) -> tuple[str, DataFrame]:
    """The first readable path of an ordered list, with its table."""
    tried = list(paths)
    for path in tried:
        try:
            if path.endswith(".parquet"):
                return path, spark.read.parquet(path)
            return path, read_file(spark, path)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these could be read: {tried}")


def read_truth(spark: SparkSession, path: str, whole_document: bool = False) -> DataFrame:
    """The (item, co_item) table of a JSON object item -> [co-item].

    The native form has one object per line, and an item may continue over several
    lines. ``whole_document`` reads one object spread over a whole file. An item
    without co-items gives one row with a null ``co_item``.
    """
    text = spark.read.text(path, wholetext=whole_document)
    entries = text.select(
        F.explode(F.from_json("value", "map<string,array<string>>")).alias("item", "co_items")
    )
    return entries.select("item", F.explode_outer("co_items").alias("co_item"))
