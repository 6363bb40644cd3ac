"""Feedback: a log of what was expanded, and the boost that it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BOOST, BOOST_EACH = 0.15, 0.02


def expand_counts(log: DataFrame) -> DataFrame:
    """chunk_id, n."""
    return log.where(F.col("action") == "expand").groupBy("chunk_id").agg(F.count("*").alias("n"))


def boost(n: Column) -> Column:
    return F.least(F.lit(MOST_BOOST), F.coalesce(n, F.lit(0)) * F.lit(BOOST_EACH))


def chunk_boosts(log: DataFrame) -> DataFrame:
    """chunk_id, boost, of chunks that have been expanded."""
    return expand_counts(log).select("chunk_id", boost(F.col("n")).alias("boost"))


def expand_event(spark, query_hash: str, chunk_id: str, ts: int) -> DataFrame:
    return spark.range(1).select(F.lit(query_hash).alias("query_hash"), F.lit(chunk_id).alias("chunk_id"), F.lit("expand").alias("action"), F.lit(ts).cast("long").alias("ts"))


def returned_events(spark, query_hash: str, chunk_ids: list[str], ts: int) -> DataFrame:
    ids = F.array(*[F.lit(x) for x in chunk_ids]).cast("array<string>")
    return spark.range(1).select(F.lit(query_hash).alias("query_hash"), F.explode(ids).alias("chunk_id"), F.lit("returned").alias("action"), F.lit(ts).cast("long").alias("ts"))


def expand_report(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """One row or none: text with the whole chunk and where it is."""
    own = chunks.where(F.col("id") == chunk_id)
    return own.select(F.concat(F.lit("**"), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("**\n```\n"), F.col("content"), F.lit("\n```")).alias("text"))
