"""Kernels and helpers that the operators of this subpackage share.

Texts are handled as UTF-8 bytes in numpy slices of bounded size. Random-coefficient
(multilinear) hashing modulo 2**64 makes a collision of two given words about 2**-56.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import delete, temporary  # noqa: F401
from ..plans.materialize import materialized as written

SLICE_BYTES = 1 << 17
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    COEFFICIENTS = mix64(np.arange(1, 4097, dtype=np.uint64) * _GOLD)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets from 0; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = lower_ascii(AS_IS)


def word_slices(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = AS_IS, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, hash, first byte and end of the words [^\\x20\\x09-\\x0D]+, by slices of so many bytes; table maps bytes.

    Rows and words may go on over any number of slices: a word that does is held back, as its first byte and sum.
    """
    held = None
    for lo in range(0, len(buf), most):
        part = table[buf[lo : lo + most]]
        hi = lo + len(part)
        cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")]
        space = _SPACES[part]
        edge = np.empty(len(part) + 1, bool)
        edge[0] = held is None
        edge[1:] = space
        edge[cuts - lo] = True
        starts = np.flatnonzero(~space & edge[:-1])
        at = starts if held is None else np.concatenate([[0], starts])
        if not len(at):
            continue
        first = np.full(len(part), 0 if held is None else held[0] - lo)
        first[starts] = starts
        place = np.arange(len(part)) - np.maximum.accumulate(first)
        place[space] = 0
        with np.errstate(over="ignore"):
            value = (part.astype(np.uint64) + np.uint64(1)) * COEFFICIENTS[place & 4095]
            if place.max() >= 4096:
                far = place >= 4096
                value[far] *= mix64((place[far] >> 12).astype(np.uint64)) | np.uint64(1)
            value[space] = 0
            sums = np.add.reduceat(value, at)
            ends = lo + at + np.add.reduceat((~space).astype(np.int64), at)
            starts = lo + at
            if held is not None:
                starts[0] = held[0]
                sums[0] += held[1]
        held = None
        if hi < len(buf) and not space[-1] and not _SPACES[table[buf[hi]]] and not edge[-1]:
            held = (int(starts[-1]), sums[-1])
            starts, ends, sums = starts[:-1], ends[:-1], sums[:-1]
        if len(starts):
            yield np.searchsorted(offsets, starts, side="right") - 1, mix64(sums), starts, ends


def word_hashes(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = AS_IS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and the words' count by row, of a slice of rows."""
    found = list(word_slices(buf, offsets, table, max(len(buf), 1)))
    row, h, starts, ends = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return h, starts, ends, np.bincount(row, minlength=len(offsets) - 1)


def all_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, first byte and end of all words of rows, found slice by slice, so that a very long row takes no more than its words."""
    parts = list(word_slices(buf, offsets))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def count_words(text: pa.Array) -> np.ndarray:
    buf, offsets = text_buffer(text)
    out = np.zeros(len(text), np.int64)
    for lo in range(0, len(buf), SLICE_BYTES):
        space = _SPACES[buf[max(lo - 1, 0) : lo + SLICE_BYTES]]
        if not lo:
            space = np.concatenate([[True], space])
        cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, lo + len(space) - 1)]
        edge = space[:-1].copy()
        edge[cuts - lo] = True
        at = lo + np.flatnonzero(~space[1:] & edge)
        out += np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=len(text))
    return out


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int, most: int = 1 << 16) -> tuple[bytes, np.ndarray]:
    """The words of each row, each followed by a space, as bytes, and where rows begin and end in them."""
    sizes = ends - starts + 1
    out = bytearray()
    for lo in range(0, len(starts), most):
        size = sizes[lo : lo + most]
        at = np.cumsum(size) - size
        part = buf[np.minimum(np.arange(int(size.sum())) + np.repeat(starts[lo : lo + most] - at, size), len(buf) - 1)]
        part[at + size - 1] = 32
        out += part.tobytes()
    return bytes(out), np.concatenate([[0], np.cumsum(np.bincount(row, sizes, rows).astype(np.int64))])


def tidy() -> None:
    """Hands memory that a Python worker has freed back to the system: idle workers are kept, next to those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, end: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow where fn turns a batch into dicts of columns in the order of schema; end is called after the last batch."""

    def run(batches):
        for batch in batches:
            made = fn(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_pydict(columns)
            del batch, made
            tidy()
        if end:
            end()
            tidy()

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"{w}{i or ''}") not in taken) for w in wanted]


def first_by_hash(rows: DataFrame, label: str, k: int) -> DataFrame:
    """Of rows (doc_id, label) without repeats, the k of each label that come first by a hash of doc_id.

    Where a label has many more, a bound on the hash leaves some more than k, so no task sorts all rows of a label.
    """
    rows = written(rows.select("doc_id", label).distinct().withColumn("hash", F.xxhash64("doc_id")))
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # a row a label
    bound = F.lit(2**63 - 1).cast("long")
    for x, n in counts.items():
        want = 1.25 * k + 64
        if n > want:
            bound = F.when(F.col(label) == x, F.lit(int(want / n * 2**64) - 2**63)).otherwise(bound)
    place = F.row_number().over(Window.partitionBy(label).orderBy("hash", "doc_id"))
    return rows.where(F.col("hash") <= bound).withColumn("place", place).where(F.col("place") <= k).select("doc_id", label, "hash")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """df with columns of the sums over all rows before in the order, which has no ties, and the sums over all rows; no task holds all rows."""
    parts = shuffle_partitions(df.sparkSession)
    held = df.withColumns({f"own_{k}": c for k, c in sums.items()}).repartitionByRange(parts, *order)
    held = written(held.withColumn("part", F.spark_partition_id()))
    per = sorted(held.groupBy("part").agg(*[F.sum(f"own_{k}").alias(k) for k in sums]).collect())  # a row a partition
    before, total = [], dict.fromkeys(sums, 0)
    for r in per:
        before.append((r["part"], *total.values()))
        total = {k: v + r[k] for k, v in total.items()}
    if not before:
        return held.select(*df.columns, *[F.col(f"own_{k}").alias(k) for k in sums]), total
    rows = F.array(*[F.struct(F.lit(r[0]).alias("part"), *[F.lit(v).cast("long").alias(f"to_{k}") for k, v in zip(sums, r[1:], strict=True)]) for r in before])
    offsets = df.sparkSession.range(1).select(F.inline(rows))  # createDataFrame would start Python workers of another kind beside those of the functions
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = held.join(F.broadcast(offsets), "part")  # a row a partition
    return held.select(*df.columns, *[(F.coalesce(F.sum(f"own_{k}").over(inside), F.lit(0)) + F.col(f"to_{k}")).alias(k) for k in sums]), total


LEAST_BITS, MOST_BITS = 24, 28


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits by the end of key, eight a key or more, within bounds (32 MB at most): the fuller, the more rows it lets through, so what it lets through is checked exactly."""
    bits = min(max((8 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.pmod("key", F.lit(1 << bits))
    rows = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("bits")).toArrow()  # 1 << MOST_BITS - 6 rows at most
    flags = np.zeros(1 << (bits - 6), np.int64)
    flags[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return flags


def set_bits(key: np.ndarray, flags: np.ndarray) -> np.ndarray:
    at = key & (64 * len(flags) - 1)
    return (flags[at >> 6] >> (at & 63)) & 1 == 1


def without(docs: DataFrame, gone: DataFrame, keys: Callable[[pa.Array], tuple[list, list]]) -> DataFrame:
    """docs but for the rows whose doc_id and keys of the text are in gone (doc_id, k1, k2); the columns of docs.

    Only rows with a doc_id that may be in gone are keyed and shuffled. Each scan has one call to Python.
    """
    if not hasattr(gone, "table_path"):
        gone = written(gone)
    if gone.isEmpty():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(gone.select(F.xxhash64("doc_id").alias("key"))))
    maybe, k1, k2, own = free_names(docs, "maybe", "k1", "k2", "own")

    @F.arrow_udf("boolean")
    def met(key: pa.Array) -> pa.Array:
        return pa.array(set_bits(key.to_numpy(zero_copy_only=False), shared.value))

    @F.arrow_udf("struct<k1:long,k2:long>")
    def keyed(key: pa.Array, text: pa.Array) -> pa.Array:
        hit = set_bits(key.to_numpy(zero_copy_only=False), shared.value)
        at = np.where(hit, np.cumsum(hit) - 1, -1)
        a, b = keys(text.filter(pa.array(hit)))
        found = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["k1", "k2"])
        tidy()
        return found.take(pa.array(at, mask=~hit))

    id_ = F.col("doc_id").cast("long")
    keyed = keyed.asNondeterministic()  # else the filter on what it gives calls it once more
    key = F.xxhash64(id_)
    stay, rest = docs.where(~met(key)), docs.withColumn(maybe, keyed(key, F.col("text"))).where(F.col(maybe).isNotNull())
    gone = gone.select(F.col("doc_id").alias(own), F.col("k1").alias(k1), F.col("k2").alias(k2))
    rest = rest.join(gone, id_.eqNullSafe(F.col(own)) & (F.col(f"{maybe}.k1") == F.col(k1)) & (F.col(f"{maybe}.k2") == F.col(k2)), "left_anti")
    return stay.select(docs.columns).union(rest.select(docs.columns))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest reachable node.

    Alternating large-star and small-star steps on distributed edges; only counts reach the driver.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.col("v") % 1000003), F.sum(F.xxhash64("u", "v") % 1000000007)).first()
        if now[0] == 0 or tuple(now) == before:
            break
        before = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        old, e = e, written(small)
        delete(e.sparkSession, old.table_path)
    else:
        raise RuntimeError("components didn't settle")
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
