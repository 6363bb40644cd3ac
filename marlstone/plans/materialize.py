"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return shared_folder.own


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df as a table, and its rows, counted as they are written."""
    rows = Observation()
    return materialized(df.observe(rows, F.count(F.lit(1)).alias("n"))), rows.get["n"]


def materialized(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator:
    """Tables that are made inside are deleted at the end, but for those that are handed to what it gives.

    What is kept must not be read from the others any more: hand on tables, not plans over them.
    """
    kept = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.table_path)
        return df

    _made.append([])
    try:
        yield keep
    finally:
        made = _made.pop()
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif _made:
                _made[-1].append(path)
