"""Exact dedup by progressive refinement: length, then a hash of the beginning, then the full hash.

Each step keeps the groups of two rows or more, and shuffles numbers or digests of rows, never texts; groups are
aggregated before they are shuffled, so a group of copies of any size costs one row a task. Rows of groups that
survive the first two steps are found in the texts by a filter of fixed size, and only these are hashed in full. exact_groups
has to give the digest of every text, so there one reading gives the keys of all three steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, lower_ascii, map_batches, mix64, set_bits, temporary, text_buffer, without, written

PREFIX_BYTES = 256
PIECE = 1 << 20


def pieces(buf: np.ndarray):
    """The bytes of one text after lower-casing A-Z, piece by piece."""
    for a in range(0, len(buf), PIECE):
        yield lower_ascii(buf[a : a + PIECE]).tobytes()


def prefix_hash(buf: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(lower_ascii(buf[:PREFIX_BYTES]).tobytes(), digest_size=8).digest(), "little", signed=True)


def full_hash(buf: np.ndarray):
    out = hashlib.sha256()
    for piece in pieces(buf):
        out.update(piece)
    return out


def mixed_key(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64(n.astype(np.uint64) ^ mix64(h.view(np.uint64))).view(np.int64)


def keyed(docs: DataFrame, full: bool) -> DataFrame:
    """doc_id, length in bytes n, hash of the beginning h, one number of both, and with full the digest of each text."""

    def key(batch):
        buf, offsets = text_buffer(batch.column(1))
        n = np.diff(offsets)
        h = np.array([prefix_hash(buf[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
        out = {"doc_id": batch.column(0), "n": pa.array(n), "h": pa.array(h), "key": pa.array(mixed_key(n, h))}
        return out | ({"text_sha256": pa.array([full_hash(buf[a:z]).hexdigest() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())} if full else {})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key, "doc_id long, n long, h long, key long" + ", text_sha256 string" * full)


def alike(keys: DataFrame) -> DataFrame:
    """n, h, key shared by two rows or more: by length first, and by the beginning among those of shared lengths."""
    lengths = written(keys.groupBy("n").agg(F.count("*").alias("rows")).where("rows > 1").select("n"))
    among = keys.select("n", "h", "key").join(lengths, "n", "left_semi")
    return written(among.groupBy("n", "h", "key").agg(F.count("*").alias("rows")).where("rows > 1").select("n", "h", "key"))


def copies(rows: DataFrame, digest: list[str]) -> DataFrame:
    """digest, keep_id, group_size of each group of two rows (doc_id, digest) or more."""
    return written(rows.groupBy(*digest).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is empty, and empty texts are one
    group. Very long texts are read in pieces and compared whole. keep_id is the group's largest doc_id (null only if all are
    null); group_size counts rows. Rows that repeat a doc_id and text are rows of the same document: each of them has kept
    true if it stays, as has each row of a group without any doc_id. Extra columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    with temporary(docs.sparkSession) as keep:
        keys = keep(written(keyed(docs, True)))
        same = keep(copies(keys.join(alike(keys), ["n", "h", "key"], "left_semi"), ["text_sha256"]))
    out = keys.select("doc_id", "text_sha256").join(same, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def halves(buf: np.ndarray) -> tuple[int, int]:
    """The first sixteen bytes of the full hash, as two numbers."""
    return tuple(np.frombuffer(full_hash(buf).digest()[:16], np.int64).tolist())


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Of equal texts (see exact_groups) the row with the largest doc_id stays; rows without one go if any has one. A row goes
    by its doc_id and its text: another text of the same doc_id stays, if that has the largest doc_id of its own group. Rows
    that repeat the doc_id and the text that stay are the same document and all stay, as do rows without a doc_id
    if their text has no other. Null, empty and very long texts, clashing names and empty tables as in exact_groups.
    """

    def digest(batch):
        buf, offsets = text_buffer(batch.column(1))
        n, h, keep, halves_ = np.diff(offsets), [], [], []
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            h.append(prefix_hash(buf[a:z]))
        key = mixed_key(n, np.array(h, np.int64))
        keep = np.flatnonzero(set_bits(key, shared.value))
        halves_ = [halves(buf[offsets[i] : offsets[i + 1]]) for i in keep]
        return {"doc_id": batch.column(0).take(pa.array(keep)), "k1": pa.array([x[0] for x in halves_], pa.int64()), "k2": pa.array([x[1] for x in halves_], pa.int64())}

    with temporary(docs.sparkSession) as keep:
        found = alike(written(keyed(docs, False)))
        shared = docs.sparkSession.sparkContext.broadcast(bit_filter(found.select("key")))
        rows = written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), digest, "doc_id long, k1 long, k2 long"))
        same = copies(rows, ["k1", "k2"])
        gone = keep(written(rows.join(same, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "k1", "k2").distinct()))

    def keys(text):
        buf, offsets = text_buffer(text)
        found = [halves(buf[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        return [x[0] for x in found], [x[1] for x in found]

    return without(docs, gone, keys)
