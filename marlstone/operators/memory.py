"""Notes and checkpoints: save, recall, list, delete, audit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EmbeddingBackend

LEAST_SIMILARITY = 0.4
CHUNK_LIMIT = 500


def newest_first(memories: DataFrame) -> DataFrame:
    return memories.orderBy(F.desc("created_at"), "seq")


def recall(memories: DataFrame, backend: EmbeddingBackend, top_k: int = 5) -> DataFrame:
    """The top_k embedded memories with score; stale ones too. Ties: newest first, then seq."""
    return memories.where(backend.embedded()).withColumn("score", backend.similarity()).orderBy(F.desc("score"), F.desc("created_at"), "seq").limit(top_k)


def touched(memories: DataFrame, returned: DataFrame, now: int) -> DataFrame:
    """memories with last_seen_at set to now for those returned (id)."""
    hit = returned.select("id").distinct().withColumn("_hit", F.lit(True))
    return memories.join(F.broadcast(hit), "id", "left").withColumn("last_seen_at", F.when(F.col("_hit"), F.lit(now).cast("long")).otherwise(F.col("last_seen_at"))).drop("_hit")  # top_k rows


def deleted(memories: DataFrame, memory_id: str) -> DataFrame:
    return memories.where(F.col("id") != memory_id)


def best_similarity(memories: DataFrame, chunks: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """id, best: the similarity of each memory that is embedded and not stale to the likest of the first chunks, 0 at least.

    At most limit vectors are fetched and shared; a batch of memories is compared with them as one product of matrices.
    """
    rows = chunks.where(F.col("embedding").isNotNull()).orderBy("seq").limit(limit).select("embedding").collect()
    by_length = {}
    for r in rows:
        v = np.array(r["embedding"], float)
        if len(v) and (norm := np.linalg.norm(v)):
            by_length.setdefault(len(v), []).append(v / norm)
    shared = memories.sparkSession.sparkContext.broadcast({k: np.stack(v).T for k, v in by_length.items()})

    @F.arrow_udf("double")
    def best(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for n, few in shared.value.items():
            at = np.flatnonzero(lengths == n)
            if len(at):
                own = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                norms = np.linalg.norm(own, axis=1)
                out[at] = np.maximum(0, (own @ few).max(axis=1) / np.where(norms == 0, 1, norms))
        return pa.array(out)

    own = memories.where(F.col("embedding").isNotNull() & ~F.coalesce("stale", F.lit(False)))
    own = own.select("id", F.explode(F.array("embedding")).alias("embedding"))  # keeps lambdas that make vectors out of the call to Python
    return own.select("id", best("embedding").alias("best"))


def audit(memories: DataFrame, chunks: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """id, best, marked: what a memory is likest to, and whether it becomes stale."""
    return best_similarity(memories, chunks, limit=limit).withColumn("marked", F.col("best") < LEAST_SIMILARITY)


def after_audit(memories: DataFrame, audited: DataFrame) -> DataFrame:
    marks = audited.select("id", "marked")
    return memories.join(marks, "id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("marked", F.lit(False))).drop("marked")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The last saved checkpoint, or no row."""
    return checkpoints.agg(F.max_by(F.struct("*"), "seq").alias("x")).where("x is not null").select("x.*")


def checkpoint_list(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy(F.desc("seq")).select("id", "summary", "created_at")


def newest_best() -> Column:
    """A recalled memory as a struct that sorts as recall does."""
    return F.struct((-F.col("score")).alias("worse"), (-F.col("created_at")).alias("older"), "seq", "content", "tags", F.coalesce("stale", F.lit(False)).alias("stale"), "score")


def lines_of(m: Column) -> Column:
    """The line that shows a recalled memory."""
    stale, tags = F.when(m["stale"], " *[stale]*").otherwise(""), F.when(F.size(m["tags"]) > 0, F.concat(F.lit(" *("), F.array_join(m["tags"], ", "), F.lit(")*"))).otherwise("")
    return F.concat(F.lit("- ["), F.format_string("%.2f", m["score"]), F.lit("] "), m["content"], stale, tags)


def recall_report(recalled: DataFrame) -> DataFrame:
    """One row: text that lists the recalled memories; they are few."""
    rows = recalled.agg(F.array_sort(F.collect_list(newest_best())).alias("x"))
    text = F.concat(F.lit("**Relevant memories:**\n"), F.array_join(F.transform("x", lines_of), "\n"))
    return rows.select(F.when(F.size("x") > 0, text).otherwise("No relevant memories found.").alias("text"))


def audit_report(audited: DataFrame) -> DataFrame:
    """One row: text that says how many memories were audited and marked."""
    n = audited.agg(F.count("*").alias("n"), F.count_if("marked").alias("m"))
    end = F.when(F.col("m") > 0, F.concat(F.lit("Marked "), F.col("m").cast("string"), F.lit(" as stale."))).otherwise("All look current.")
    return n.select(F.concat(F.lit("Audited "), F.col("n").cast("string"), F.lit(" memories. "), end).alias("text"))


def checkpoint_report(latest: DataFrame) -> DataFrame:
    """One row or none: text that shows a checkpoint; times are UTC."""
    when = F.expr("date_format(timestampadd(SECOND, created_at, timestamp_ntz'1970-01-01 00:00:00'), 'M/d/yyyy, h:mm:ss a')")
    tasks = F.when(F.size("open_tasks") > 0, F.concat(F.lit("\n\n**Open tasks:**\n"), F.array_join(F.transform("open_tasks", lambda t: F.concat(F.lit("- "), t)), "\n"))).otherwise("")
    return latest.select(F.concat(F.lit("**Last checkpoint** ("), when, F.lit(")\n\n"), F.col("summary"), tasks).alias("text"))


def new_memory(spark, own: str, content: str, tags: list[str], now: int, seq: int) -> DataFrame:
    from ..functions.vectors import local_embedding

    tags = F.array(*map(F.lit, tags)).cast("array<string>")
    row = spark.range(1).select(F.lit(own).alias("id"), F.lit(content).alias("content"), tags.alias("tags"), F.lit(False).alias("stale"), F.lit(now).cast("long").alias("created_at"), F.lit(None).cast("long").alias("last_seen_at"), F.lit(seq).cast("long").alias("seq"))
    return row.withColumn("embedding", local_embedding(F.col("content")))


def new_checkpoint(spark, own: str, summary: str, open_tasks: list[str], now: int, seq: int) -> DataFrame:
    tasks = F.array(*map(F.lit, open_tasks)).cast("array<string>")
    return spark.range(1).select(F.lit(own).alias("id"), F.lit(summary).alias("summary"), tasks.alias("open_tasks"), F.lit(now).cast("long").alias("created_at"), F.lit(seq).cast("long").alias("seq"))
