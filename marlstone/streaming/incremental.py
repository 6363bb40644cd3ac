"""Indexing as files arrive: a file source, and each batch replacing its files' chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import plain_path, wanted

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """path, mtime, content of files as they appear below root."""
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    path = plain_path(F.col("path"))
    return raw.where(wanted(path, root)).select(path.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def index_stream(project, checkpoint: str, available_now: bool = True, files: DataFrame | None = None) -> StreamingQuery:
    """Indexes what arrives below the project's root, or files, a stream of path, mtime, content.

    The checkpoint keeps what has been taken. A batch that is repeated after a failure replaces the same files again.
    """

    def replace(batch: DataFrame, _: int) -> None:
        project.store.read("file_meta")
        project._replace(batch, None)

    files = arriving_files(project.spark, project.root) if files is None else files
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(replace)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
