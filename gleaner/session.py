"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app: str = "gleaner", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on.

    Extra settings are passed as keywords with ``_`` for ``.``-separated names
    given as a dict, e.g. ``build_session(**{"spark.sql.shuffle.partitions": "64"})``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, one subfolder per application.

    A cluster names it in ``spark.checkpoint.dir``; it must be shared storage so
    that losing an executor loses nothing. Only a local master may fall back to a
    folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _LOCAL_SCRATCH.get(context.applicationId)
        if root is None:
            root = tempfile.mkdtemp(prefix="gleaner-scratch-")
            _LOCAL_SCRATCH[context.applicationId] = root
    return os.path.join(root, f"gleaner-{context.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return it read back.

    This cuts lineage where a result is used more than once or must not change
    between uses (sampled range bounds, for example), and it survives executor
    loss because the rows are on shared storage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root not in folder:
            raise ValueError(f"{folder} is no intermediate table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
