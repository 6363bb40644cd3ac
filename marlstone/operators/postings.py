"""An inverted index of chunks: how often a term stands in a chunk, and BM25 scores that read only the terms of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from .rerank import term_weight


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The terms of a query in order, repeats included."""
    return spark.range(1).select(bm25_tokens(F.lit(query)).alias("t")).first()["t"]


def with_lengths(chunks: DataFrame) -> DataFrame:
    """chunks (name, content) with tokens, the number of terms of the content, and length, that of name and content."""
    return chunks.withColumn("tokens", F.size(bm25_tokens(F.col("content")))).withColumn("length", F.size(bm25_tokens(F.col("name"))) + F.col("tokens"))


def postings(chunks: DataFrame, *keys: str) -> DataFrame:
    """keys, term, frequency of chunks (keys, name, content), whose keys differ; no shuffle, as all terms of a chunk stand in its row.

    Terms are sorted, and counted as runs. They and the places where runs start are generated columns, so that lambdas read them and don't compute them again.
    """
    cut = chunks.select(*keys, F.explode(F.array(F.sort_array(F.concat(bm25_tokens(F.col("name")), bm25_tokens(F.col("content")))))).alias("terms"))
    starts = F.filter(F.transform("terms", lambda t, i: F.when((i == 0) | (t != F.get("terms", i - 1)), i)), lambda i: i.isNotNull())
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("terms"))
    run = lambda i, k: F.struct(F.get("terms", i).alias("term"), (end(k) - i).cast("long").alias("frequency"))
    return cut.withColumn("starts", F.explode(F.array(starts))).select(*keys, F.inline(F.transform("starts", run)))


def bm25_scores(terms: DataFrame, lengths: DataFrame, query: str, key: str = "id") -> DataFrame:
    """key, bm25 of all chunks of lengths (key, tokens, length), from postings (key, term, frequency); no text is read.

    Equal to rerank.bm25_scores of the chunks. Only postings of the query's terms are read; chunks without any of them score 0.
    """
    words = query_terms(lengths.sparkSession, query)
    average = lengths.agg(F.avg("tokens").alias("x")).scalar()
    hits = terms.where(F.col("term").isin(words)).groupBy(key).agg(F.collect_list(F.struct("term", "frequency")).alias("hits"))  # a query's terms at most
    ratio = F.try_divide(F.col("length").cast("double"), F.col("average"))
    found = lambda t: F.aggregate(F.filter("hits", lambda h: h["term"] == t), F.lit(0).cast("long"), lambda n, h: n + h["frequency"])
    weight = lambda t: term_weight(found(t).cast("double"), ratio)
    score = F.lit(0.0)
    for w in words:
        score = score + weight(F.lit(w))
    scored = lengths.select(key, "length").withColumn("average", average).join(hits, key, "left")
    return scored.select(key, F.when(F.col("hits").isNull(), 0.0).otherwise(score).alias("bm25"))
