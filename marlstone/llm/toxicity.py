"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, their stems (the first STEM bytes of longer words), word pairs and
pairs with one word between. The learner keeps a rate
for each coordinate and L1 sparsity; what is broadcast are the nonzero weights, of which there are at most
1 << BITS. It learns from a bounded sample: PER_CLASS labelled documents of each label, first by a hash of doc_id, as
far as their texts together have BYTES_PER_CLASS; where they have more, the longest are left out first. The intercept is then
corrected to the labels' true shares.
Scoring reads whole texts, slice by slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import COEFFICIENTS, LOWER, first_by_hash, map_batches, mix64, row_slices, temporary, text_buffer, tidy, word_slices, written

BITS = 20
STEM = 4
PER_CLASS = 3000
BYTES_PER_CLASS = 32 << 20
EPOCHS = 4
RATE, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
FOLDS, HELD_OUT = 5, 0

#: ASCII signs separate words.
TABLE = LOWER.copy()
TABLE[[b for b in range(128) if not chr(b).isalnum()]] = 32


def features(buf: np.ndarray, offsets: np.ndarray):
    """Row and index of each feature, with repeats, slice by slice."""
    c = COEFFICIENTS[2000:2004] | np.uint64(1)
    before, its_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the last two words of the slice before
    for row, h, starts, ends in word_slices(buf, offsets, TABLE):
        long_ = np.flatnonzero(ends - starts > STEM)
        stem = np.zeros(len(long_), np.uint64)
        for i in range(STEM):
            stem = (stem << np.uint64(8)) | TABLE[buf[starts[long_] + i]]
        made, rows = [h, mix64(stem ^ c[3])], [row, row[long_]]
        known = len(before)
        h, row = np.concatenate([before, h]), np.concatenate([its_row, row])
        with np.errstate(over="ignore"):
            for gap in (1, 2):
                at = np.arange(max(gap, known), len(h))
                at = at[row[at] == row[at - gap]]
                made.append(mix64(h[at - gap] * c[0] + h[at] * c[gap]))
                rows.append(row[at])
        before, its_row = h[-2:], row[-2:]
        yield np.concatenate(rows), (np.concatenate(made) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def feature_sets(text: pa.Array) -> list[np.ndarray]:
    """The distinct feature indices of each text."""
    out = []
    buf, offsets = text_buffer(text)
    for a, z in row_slices(offsets):
        codes = np.zeros(0, np.int64)
        for row, index in features(buf[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]):
            codes = np.union1d(codes, (row << BITS) | index)
        ends = np.searchsorted(codes, np.arange(z - a + 1) << BITS)
        out += [(codes[s:e] & ((1 << BITS) - 1)).astype(np.int32) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept; examples are distinct indices, in the order in which they are learnt."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / RATE + L2))

    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            x = np.append(x, 1 << BITS)
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            grown = nx + g * g
            z[x] = zx + g - (np.sqrt(grown) - np.sqrt(nx)) / RATE * w
            n[x] = grown
    w = weights(z, n)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the nonzero weights, and the intercept; from labels outside the held-out fold."""
    with temporary(docs.sparkSession):
        return learned(*sampled(docs, labels, per_class, bytes_per_class))


def sampled(docs: DataFrame, labels: DataFrame, per_class: int, bytes_per_class: int) -> tuple[list, dict[int, int]]:
    """Rows (doc_id, toxic, x: distinct features) to learn from, and how many documents have each label."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = written(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    sample = first_by_hash(known, "toxic", per_class)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # 2 * per_class rows
    chosen = written(chosen.groupBy("doc_id", "toxic", "hash").agg(F.min("text").alias("text")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    share = max(1, bytes_per_class // max(1, per_class))
    longer = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("bytes"), F.lit(1)) / F.lit(share))))  # doublings of an even share of the bytes
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("toxic").orderBy(longer, "hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    fitting = chosen.drop("text").withColumn("so_far", before).where(F.col("so_far") <= bytes_per_class).select("doc_id")  # of per_class rows a label

    def describe(batch):
        return {"doc_id": batch.column(0), "toxic": batch.column(1), "x": pa.array([x.tobytes() for x in feature_sets(batch.column(2))], pa.binary())}

    rows = map_batches(chosen.join(F.broadcast(fitting), "doc_id").select("doc_id", "toxic", "text"), describe, "doc_id long, toxic int, x binary").collect()
    return [r for r in rows if len(r["x"])], shares


def learned(rows: list, shares: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    if len({r["toxic"] for r in rows}) < 2:
        return np.zeros(0, np.int64), np.zeros(0), -4.0 if not rows or rows[0]["toxic"] == 0 else 4.0
    rows.sort(key=lambda r: r["doc_id"])
    order = np.random.default_rng(7).permutation(len(rows))
    y = np.array([rows[i]["toxic"] for i in order], float)
    w, intercept = fit([np.frombuffer(rows[i]["x"], np.int32) for i in order], y)
    del rows
    tidy()
    intercept += np.log(shares[1] / y.sum()) - np.log(shares[0] / (len(y) - y.sum()))
    at = np.flatnonzero(w)
    return at, w[at], float(intercept)


def scorer(spark, model):
    """A Column function: text to score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        at, w, intercept = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        out = np.full(len(text), intercept)
        buf, offsets = text_buffer(text)
        for a, z in row_slices(offsets):
            both = np.zeros(0, np.int64)
            for row, index in features(buf[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]):
                keep = dense[index] != 0
                both = np.union1d(both, (row[keep] << BITS) | index[keep])
            out[a:z] += np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=z - a)
        tidy()
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    A null or empty text has the score of the intercept alone; a very long one is read whole, in slices. Labels other than 0 and
    1 are not used; of repeated labels of one document, the highest counts, and of texts that share a doc_id the
    first in order is learnt from. Repeated rows have equal scores. A score of just 0.5 is predicted 1. Without
    labels of both kinds all scores are alike and say the one label, or 0. Extra columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    score = scorer(docs.sparkSession, learn(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def acceptable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns.

    Each row goes by its text alone, so repeated rows go or stay together, and rows without a doc_id are judged like
    others. Null, empty and very long texts, ties, labels and empty tables as in toxicity_scores; any columns of docs are kept,
    whatever their names.
    """
    score = scorer(docs.sparkSession, learn(docs, labels))
    return docs.where(score("text") < 0.5)
