"""BM25 without IDF, and the re-ranking of a bounded set of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..plans.materialize import materialized

K1, B = 1.5, 0.75


def term_weight(f: Column, ratio: Column, k1: float = K1, b: float = B) -> Column:
    """What a term that stands f times in a text counts; ratio is the text's length by the average one."""
    return F.when(f == 0, 0.0).otherwise(F.coalesce(f * (k1 + 1) / (f + k1 * (1 - b + b * ratio)), F.lit(0.0)))


def bm25(query_terms: Column, doc_terms: Column, average: Column, k1: float = K1, b: float = B, length: Column | None = None) -> Column:
    """Sum over query terms, repeats included; 0 for a document without terms. doc_terms may be only those of the query, if length is given."""
    length = F.size(doc_terms).cast("double") if length is None else length.cast("double")
    counts = F.transform(query_terms, lambda t: F.size(F.filter(doc_terms, lambda x: x == t)).cast("double"))
    ratio = F.try_divide(length, average)
    return F.when(length == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda total, f: total + term_weight(f, ratio, k1, b)))


def bm25_scores(chunks: DataFrame, query: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys and bm25 of chunks (name, content); the average length is over content, the scored text is name and content.

    One pass cuts the texts into tokens, and writes their number and those that the query has; scores follow from this.
    """
    terms = bm25_tokens(F.lit(query))
    cut = chunks.select(*keys, F.explode(F.array(F.struct(bm25_tokens(F.col("name")).alias("name"), bm25_tokens(F.col("content")).alias("content")))).alias("t"))
    asked = lambda c: F.filter(c, lambda x: F.array_contains(terms, x))
    few = materialized(cut.select(*keys, F.size("t.content").alias("n"), (F.size("t.name") + F.size("t.content")).alias("length"), F.concat(asked(F.col("t.name")), asked(F.col("t.content"))).alias("hits")))
    average = few.agg(F.avg("n")).first()[0]
    return few.select(*keys, bm25(terms, F.col("hits"), F.lit(average).cast("double"), length=F.col("length")).alias("bm25"))


def rerank(candidates: DataFrame, query: str, top_k: int, embedding_weight: float = 0.7) -> DataFrame:
    """The top_k of candidates (score, rank, name, content) by weight * score + (1 - weight) * BM25 scaled to 0..1.

    candidates must be few: windows over all of them run in one task. Ties keep the order of rank.
    """
    every = Window.partitionBy()
    terms = candidates.withColumn("_terms", F.explode(F.array(bm25_tokens(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.col("content"))))))
    average = F.avg(F.size(bm25_tokens(F.col("content")))).over(every)
    scored = terms.withColumn("_average", average).withColumn("bm25", bm25(bm25_tokens(F.lit(query)), F.col("_terms"), F.col("_average")))
    least, most = F.min("bm25").over(every), F.greatest(F.max("bm25").over(every), F.lit(1e-9))
    span = F.when(most - least == 0, 1.0).otherwise(most - least)
    out = scored.withColumn("_scaled", (F.col("bm25") - least) / span)
    out = out.withColumn("score", F.least(F.lit(1.0), embedding_weight * F.col("score") + (1 - embedding_weight) * F.col("_scaled")))
    first = out.orderBy(F.desc("score"), "rank").limit(top_k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank"))).drop("_terms", "_average", "_scaled")
