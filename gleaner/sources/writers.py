"""Stage outputs: CSV with a header, Parquet between stages, truth maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators import containers


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested values are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    writer = flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    # Spark would trim values otherwise.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_stage(df: DataFrame, path: str) -> None:
    """Hand-over between stages: Parquet keeps types, nulls and splits."""
    df.write.mode("overwrite").parquet(path)


def ingested_name(path: str) -> str:
    """``<stem>_ingested.csv`` for an input file."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{stem}_ingested.csv"


def write_truth(truth: DataFrame | containers.Sets, path: str, line_items: int = 10_000, compression: str | None = None) -> None:
    """One ``{"item": [co-item, ...]}`` object per line.

    A long list continues on further lines of the same item, about ``line_items``
    per line, so no task gathers an unbounded list. Sets of integers are written from
    their containers, where those are.
    """
    if isinstance(truth, containers.Sets):
        _truth_lines(truth, line_items).write.mode("overwrite").text(path, compression=compression)
        return
    sizes = truth.groupBy("item").agg(F.count("co_item").alias("_n"))
    lines = F.ceil((F.col("_n") + 1) / F.lit(line_items))
    parts = (
        truth.join(sizes, "item")
        .withColumn("_line", F.pmod(F.xxhash64("co_item"), lines))
        .groupBy("item", "_line")
        .agg(F.sort_array(F.collect_list(F.col("co_item").cast("string"))).alias("_co"))
    )
    line = F.to_json(F.map_from_arrays(F.array(F.col("item").cast("string")), F.array("_co")))
    parts.select(line.alias("value")).write.mode("overwrite").text(path, compression=compression)


def _truth_lines(truth: containers.Sets, line_items: int) -> DataFrame:
    """The lines (value) of integer sets, at most ``line_items`` members each, and one for each empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("key", "bucket", "data")), strict=True):
                names = np.char.add(np.char.add('"', (containers.places_of(data) + bucket * containers.WIDTH).astype("U20")), '"')
                parts = [names[at : at + line_items] for at in range(0, len(names), line_items)]
                lines = ['{"%d":[%s]}' % (key, ",".join(part.tolist())) for part in parts]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    held = truth.sets.select("key", "bucket", "data").mapInArrow(run, "value string")
    empty = truth.keys.join(truth.sets.select("key").distinct(), "key", "left_anti")
    return held.unionByName(empty.select(F.concat(F.lit('{"'), F.col("key").cast("string"), F.lit('":[]}')).alias("value")))
