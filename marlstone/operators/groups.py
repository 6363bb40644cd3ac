"""Exact nearest vectors by groups around centres: groups that can't hold one of the best are not read.

Angles obey the triangle inequality, so no vector of a group is nearer to a query than the query's angle to the centre allows, given the least and the
greatest angle of the group's vectors to it. Groups are folders of a partitioned table, read in the order of this bound until none that is left can
reach the last of the best. Centres are a bounded sample; any centres give right results, better ones leave more unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import VectorBackend, cosine

MOST_CENTRES = 256
SLACK = 1e-9  # of a cosine, for rounding
OTHER = -1  # the group of vectors without a direction, or of another length: their cosine is 0


def sampled_centres(vectors: DataFrame, most: int = MOST_CENTRES) -> np.ndarray:
    """Up to so many vectors (embedding) of length 1, the first by a hash, of the commonest length."""
    own = vectors.where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    lengths = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    size = lengths.first()
    if size is None:
        return np.zeros((0, 0))
    rows = own.where(F.size("v") == size["n"]).orderBy(F.xxhash64("v")).limit(most).collect()  # most vectors
    v = np.array([r["v"] for r in rows])
    norms = np.linalg.norm(v, axis=1)
    return v[norms > 0] / norms[norms > 0, None]


def grouped(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors (embedding) with group and angle, those to the nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # MOST_CENTRES vectors

    @F.arrow_udf("struct<group:int,angle:double>")
    def nearest(column: pa.Array) -> pa.Array:
        c = shared.value
        group, angle = np.full(len(column), OTHER, np.int32), np.zeros(len(column))
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(sizes == c.shape[1]) if len(c) else np.zeros(0, np.int64)
        if len(at):
            v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            norms = np.linalg.norm(v, axis=1)
            near = (v @ c.T) / np.where(norms == 0, 1, norms)[:, None]
            best = near.argmax(axis=1)
            group[at] = np.where(norms > 0, best, OTHER)
            angle[at] = np.where(norms > 0, np.arccos(np.clip(near[np.arange(len(at)), best], -1, 1)), 0)
        return pa.StructArray.from_arrays([pa.array(group), pa.array(angle)], ["group", "angle"])

    own = vectors.where("embedding is not null").withColumn("_own", F.col("embedding").cast("array<double>"))
    return own.withColumn("_near", nearest.asNondeterministic()("_own")).select(*vectors.columns, F.col("_near.group").alias("group"), F.col("_near.angle").alias("angle"))


def write_groups(vectors: DataFrame, path: str, most: int = MOST_CENTRES) -> None:
    """vectors (embedding, ...) below path: rows by group, and for each group its centre, how far it reaches, and (like, null) the type of the rows."""
    spark, centres = vectors.sparkSession, sampled_centres(vectors, most)
    own = grouped(vectors, centres)
    own.hint("rebalance", "group").write.mode("overwrite").partitionBy("group").parquet(f"{path}/rows")
    rows = spark.read.schema(own.schema).parquet(f"{path}/rows")
    reach = rows.groupBy("group").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    values = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    held = spark.createDataFrame(values, "group int, centre array<double>").join(reach, "group", "right")
    held.withColumn("like", F.lit(None).cast(own.schema)).coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")


def bounds(groups: list, query: np.ndarray) -> list[tuple[float, int]]:
    """The greatest cosine that a vector of each group can have with the query, greatest first."""
    out, norm = [], np.linalg.norm(query)
    size = next((len(g["centre"]) for g in groups if g["centre"] is not None), None)
    for g in groups:
        if g["group"] == OTHER or not norm or size != len(query):
            out.append((1.0 if g["group"] == OTHER and size != len(query) else 0.0, g["group"]))
            continue
        angle = math.acos(max(-1.0, min(1.0, float(np.dot(query, g["centre"]) / norm))))
        out.append((math.cos(max(0.0, angle - g["most"], g["least"] - angle)), g["group"]))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def top_k(spark: SparkSession, path: str, query: list[float], k: int, key: str) -> tuple[DataFrame, int]:
    """The k rows nearest to the query with score, ties by key, and how many rows were read; equal to a scan of all.

    Groups are read in parts, each twice as many as before. k rows reach the driver in each part.
    """
    held = spark.read.parquet(f"{path}/groups")
    groups = held.drop("like").collect()  # MOST_CENTRES rows
    sizes = {g["group"]: g["n"] for g in groups}
    order, rows = bounds(groups, np.array(query, float)), spark.read.schema(held.schema["like"].dataType).parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c not in ("group", "angle")]
    scored = rows.withColumn("score", cosine(VectorBackend(query).vector, F.col("embedding").cast("array<double>")))
    at, step, best = 0, 2, []
    while at < len(order) and (len(best) < k or order[at][0] >= best[-1]["score"] - SLACK):
        part = [g for _, g in order[at : at + step]]
        best += scored.where(F.col("group").isin(part)).select(*columns, "score").orderBy(F.desc("score"), key).limit(k).collect()  # k rows
        best = sorted(best, key=lambda r: (-r["score"], r[key]))[:k]
        at, step = at + step, 2 * step
    schema = scored.select(*columns, "score").schema
    return spark.createDataFrame(best, schema), sum(sizes[g] for _, g in order[:at])
