"""Incremental indexing: which files changed, and keyed replacement of their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import embed_text
from ..functions.vectors import local_embedding, local_sign


def changed_files(files: DataFrame, meta: DataFrame) -> DataFrame:
    """files (path, mtime, ...) that meta does not have with that mtime."""
    return files.join(meta.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti").select(files.columns)


def last_by_key(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Of rows with one key, the last; as max_by, so that equal keys are merged before they are shuffled."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns]), order).alias("x")).select("x.*")


def with_unique_ids(rows: DataFrame, path: str = "file_path", base: str = "id", order: str = "ordinal") -> DataFrame:
    """Repeated ids in a file get __2, __3 ... in order."""
    n = F.row_number().over(Window.partitionBy(path, base).orderBy(order))
    return rows.withColumn("_n", n).withColumn(base, F.when(F.col("_n") > 1, F.concat(base, F.lit("__"), F.col("_n").cast("string"))).otherwise(F.col(base))).drop("_n")


def replaced(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "file_path") -> DataFrame:
    """old without the rows of changed (key), and new; equal columns."""
    return old.join(changed.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def pruned(rows: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """rows of files (path) that still exist."""
    return rows.join(files.select(F.col("path").alias(key)).distinct(), key, "left_semi").select(rows.columns)


def stats(chunks: DataFrame, memories: DataFrame, meta: DataFrame, edges: DataFrame, checkpoints: DataFrame, log: DataFrame, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """name, n: one row for each count. known has rows with n whose sum takes the place of a count."""
    count = lambda name, df, cond: df.agg(F.lit(name).alias("name"), (F.count_if(cond) if cond is not None else F.count("*")).alias("n"))
    summed = lambda name: known[name].agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    one = lambda name, df, cond=None: summed(name) if name in (known or {}) else count(name, df, cond)
    parts = [one("chunks", chunks), one("memories", memories), one("stale", memories, F.col("stale")), one("files", meta), one("edges", edges), one("checkpoints", checkpoints), one("expands", log, F.col("action") == "expand")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk_rows(changed: DataFrame, now: int, start: int) -> DataFrame:
    """The rows of the chunks of changed (path, content): embedded, numbered from start, the last of equal ids.

    Chunks are shuffled once, to be numbered, and a second time only if an id is repeated; embeddings are made after that.
    """
    from .chunking import chunk_files

    text = embed_text(F.col("name"), F.col("kind"), F.col("content"))
    cut = chunk_files(changed.select("path", "content"))
    made = cut.orderBy("file_path", "ordinal").withColumn("seq", F.monotonically_increasing_id() + start).drop("ordinal")
    if not cut.groupBy("id").count().where("count > 1").isEmpty():
        made = last_by_key(made, "id")
    return made.withColumn("embedding", local_embedding(text)).withColumn("sign", local_sign(text)).withColumn("updated_at", F.lit(now).cast("long"))


def file_rows(changed: DataFrame, git_times: DataFrame | None = None) -> DataFrame:
    """path, mtime, git_updated_at of changed (path, mtime)."""
    seen = changed.select("path", "mtime")
    return seen.join(git_times.select("path", "git_updated_at"), "path", "left") if git_times is not None else seen.withColumn("git_updated_at", F.lit(None).cast("long"))
