"""Hybrid retrieval: similarity, graph proximity, recency and feedback; then BM25 over the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EmbeddingBackend, LocalBackend
from .feedback import boost, expand_counts
from .graph import distances
from .rerank import rerank

MOST_AGE = 365 * 24 * 3600
SEMANTIC, STRUCTURAL, TEMPORAL = 0.65, 0.20, 0.15


def temporal_score(updated_at: Column, now: int) -> Column:
    """1 now, 0 a year ago or if unknown (null or 0); more than 1 in the future."""
    age = F.when(F.coalesce(updated_at, F.lit(0)) == 0, F.lit(MOST_AGE)).otherwise(F.lit(now) - updated_at)
    return F.greatest(F.lit(0.0), 1 - age / F.lit(MOST_AGE))


def structural_score(distance: Column) -> Column:
    return F.when(distance == 0, 1.0).when(distance == 1, 0.8).when(distance == 2, 0.6).when(distance == 3, 0.4).otherwise(0.0)


def scored_chunks(chunks: DataFrame, query: str, now: int, meta: DataFrame | None = None, log: DataFrame | None = None, edges: DataFrame | None = None, context_file: str | None = None, backend: EmbeddingBackend | None = None) -> DataFrame:
    """Embedded chunks (id, file_path, name, content, seq, ...) with score.

    meta (path, git_updated_at), log and the distances from context_file are joined once each. Chunks are
    scanned with the columns that they come with; what is joined has one row a key.
    """
    backend = backend or LocalBackend(query)
    out = chunks.where(backend.embedded())
    if meta is not None:
        out = out.join(meta.select(F.col("path").alias("file_path"), "git_updated_at"), "file_path", "left")
    else:
        out = out.withColumn("git_updated_at", F.lit(None).cast("long"))
    structural = F.lit(0.5)
    if context_file:
        near = distances(edges, context_file).select(F.col("file").alias("file_path"), F.col("distance").alias("_distance"))
        out = out.join(near, "file_path", "left")
        structural = structural_score(F.coalesce("_distance", F.lit(99)))
    if log is not None:
        out = out.join(expand_counts(log).select(F.col("chunk_id").alias("id"), F.col("n").alias("_n")), "id", "left")
    else:
        out = out.withColumn("_n", F.lit(0))
    base = backend.similarity() * SEMANTIC + structural * STRUCTURAL + temporal_score(F.col("git_updated_at"), now) * TEMPORAL
    return out.withColumn("score", F.least(F.lit(1.0), base + boost(F.col("_n")))).drop("_n", "_distance", "git_updated_at")


def top_candidates(scored: DataFrame, k: int) -> DataFrame:
    """The k best with rank; ties by seq."""
    return scored.orderBy(F.desc("score"), "seq").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq")))


def search_context(chunks: DataFrame, query: str, now: int, top_k: int = 10, **signals) -> DataFrame:
    """The top_k chunks for query with score and rank: the best 3 * top_k by signals, re-ranked by BM25."""
    return rerank(top_candidates(scored_chunks(chunks, query, now, **signals), 3 * top_k), query, top_k)
