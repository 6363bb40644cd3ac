"""Document fingerprints: an improbable-feature digest in chained Bloom filters.

Each window of WINDOW bytes has an entropy; the further from what is usual in prose, the rarer, and windows of hardly
any entropy come last. The rarest window of SPAN successive ones, leftmost in ties, gains a vote; a span may reach beyond the ends of the
text. Windows with VOTES or more are features; any text has at least one, and one shorter than a window is a window by itself.
They go in order into filters of BITS bits, PER_FILTER to a filter. Likeness is the overlap of bits beyond
chance as a share of the most there can be, each filter of the shorter digest against its best match.
Entropies are sums of integers, so that equal bytes give equal fingerprints wherever they stand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COEFFICIENTS, mix64, row_slices, shuffle_partitions, text_buffer, tidy

WINDOW, SPAN, VOTES = 16, 32, 8
USUAL_ENTROPY, LEAST_ENTROPY = 3.5, 1.0
BITS, HASHES, PER_FILTER = 2048, 5, 128
PIECE = 1 << 20
_UNIT = 1 << 16


def _growth() -> np.ndarray:
    """What the c-th equal byte adds to the sum of c * log2(c), in units."""
    c = np.arange(WINDOW + 2, dtype=float)
    total = c * np.log2(np.maximum(c, 1))
    return np.concatenate([[0], np.round((total[1:] - total[:-1]) * _UNIT)]).astype(np.int64)


_GROWTH = _growth()
_USUAL = int((np.log2(WINDOW) - USUAL_ENTROPY) * WINDOW * _UNIT)
_MOST = int((np.log2(WINDOW) - LEAST_ENTROPY) * WINDOW * _UNIT)


def rarity(buf: np.ndarray) -> np.ndarray:
    """Of each window, by its first byte: the distance from the usual sum; -1 where there is hardly any entropy."""
    n = len(buf) - WINDOW + 1
    after, before = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for k in range(1, WINDOW):
        same = buf[:-k] == buf[k:]
        after[:-k] += same
        before[k:] += same
    first = sum(int(_GROWTH[1 : c + 1].sum()) for c in np.bincount(buf[:WINDOW]))
    change = _GROWTH[before[WINDOW:].astype(np.int64) + 1] - _GROWTH[after[: n - 1].astype(np.int64) + 1]
    total = np.concatenate([[first], first + np.cumsum(change)])
    return np.where(total > _MOST, -1, np.abs(total - _USUAL))


def window_hashes(windows: np.ndarray) -> np.ndarray:
    """Of rows of WINDOW bytes."""
    w = np.ascontiguousarray(windows).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix64((mix64(w) * (COEFFICIENTS[: WINDOW // 8] | np.uint64(1))).sum(axis=1, dtype=np.uint64))


def voted(far: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The windows with VOTES or more; far holds the windows of one text after the other, from starts on (and one end)."""
    if not len(far):
        return np.zeros(0, np.int64)
    none = np.int64(1) << np.int64(60)
    own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(far)) + (own + 1) * (SPAN - 1)  # no span reaches two texts
    least = np.full(len(far) + len(starts) * (SPAN - 1), none)
    least[place] = ((np.int64(1 << 27) - far) << np.int64(32)) | np.arange(len(far))
    step = 1
    while step < SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    votes = np.bincount(least[least < none] & np.int64(0xFFFFFFFF), minlength=len(far))
    return np.flatnonzero(votes >= VOTES)


def long_features(buf: np.ndarray) -> np.ndarray:
    """The features of one text of more than PIECE bytes, piece by piece."""
    out, n = [], len(buf) - WINDOW + 1
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        a, z = max(0, lo - SPAN + 1), min(n, hi + SPAN - 1)  # all windows that share a span with these
        part = buf[a : z + WINDOW - 1]
        at = voted(rarity(part), np.array([0, z - a]))
        at = at[(at >= lo - a) & (at < hi - a)]
        out.append(window_hashes(part[at[:, None] + np.arange(WINDOW)].reshape(len(at), WINDOW)))
    return np.concatenate(out)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each feature, in order."""
    lengths = np.diff(offsets)
    if len(lengths) == 1 and lengths[0] > PIECE:
        h = long_features(buf)
        return np.zeros(len(h), np.int64), h
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    enough = np.flatnonzero(lengths >= WINDOW)
    if len(enough):
        far, windows = rarity(buf), lengths[enough] - WINDOW + 1
        starts = np.concatenate([[0], np.cumsum(windows)])
        at = np.repeat(offsets[enough] - starts[:-1], windows) + np.arange(starts[-1])
        chosen = voted(far[at], starts)
        at = at[chosen]
        rows.append(enough[np.searchsorted(starts, chosen, side="right") - 1])
        hashes.append(window_hashes(buf[at[:, None] + np.arange(WINDOW)].reshape(len(at), WINDOW)))
    few = np.flatnonzero((lengths > 0) & (lengths < WINDOW))
    if len(few):
        at = offsets[few][:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < lengths[few][:, None]
        rows.append(few)
        hashes.append(window_hashes(np.where(inside, buf[np.minimum(at, len(buf) - 1)], np.uint8(0))))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def digests(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By row: features in each filter, and the filters as rows of uint64."""
    row, h = features(buf, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts)])
    filters = -(-counts // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(filters)])
    own = base[row] + (np.arange(len(row)) - begin[row]) // PER_FILTER
    bits = np.zeros(int(base[-1]) * BITS, np.uint8)
    for i in range(HASHES):
        bits[own * BITS + ((h >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, bitorder="little").view(np.uint64).reshape(-1, BITS // 64)
    held = np.bincount(own, minlength=int(base[-1]))
    return [(held[base[i] : base[i + 1]], packed[base[i] : base[i + 1]]) for i in range(n)]


def text_of(digest) -> str:
    """Per filter two hex digits for its features less one, then its bits."""
    return "".join(f"{int(c) - 1:02x}{f.tobytes().hex()}" for c, f in zip(*digest, strict=True))


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, BITS // 8 + 1)
    return raw[:, 0].astype(np.int64) + 1, np.ascontiguousarray(raw[:, 1:]).view(np.uint64)


def likeness(a, b) -> float:
    """0 to 1, of two digests; two empty ones are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if a[0].sum() > b[0].sum() or (a[0].sum() == b[0].sum() and len(a[0]) > len(b[0])):
        a, b = b, a
    known = {f.tobytes() for f in b[1]}
    same = np.array([f.tobytes() in known for f in a[1]])  # these have a likeness of 1
    all_, sure, a = a[0].sum(), a[0][same].sum(), (a[0][~same], a[1][~same])
    if not len(a[0]):
        return 1.0
    p, q = np.bitwise_count(a[1]).sum(axis=1).astype(float), np.bitwise_count(b[1]).sum(axis=1).astype(float)
    both = np.stack([np.bitwise_count(b[1] & f).sum(axis=1) for f in a[1]]).astype(float)
    most, chance = np.minimum(p[:, None], q[None, :]), p[:, None] * q[None, :] / BITS
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(most > chance, (both - chance) / (most - chance), (both == most).astype(float))
    best = np.clip(score, 0, 1).max(axis=1)
    return float(min(1.0, (sure + (best * a[0]).sum()) / all_))


def digest_texts(texts: list[str]) -> list:
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    out = []
    for a, z in row_slices(offsets):
        out += digests(buf[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (text) with a column fingerprint, which replaces one of that name; other columns stay.

    A null or empty text has an empty fingerprint. Equal texts, repeated rows too, have equal ones: what is rare, and which of equally rare windows is
    taken, follows from the text alone. A very long text is read piece by piece; an empty table gives an empty result.
    """

    @F.arrow_udf("string")
    def fingerprint(text: pa.Array) -> pa.Array:
        buf, offsets = text_buffer(text)
        return pa.array([text_of(d) for a, z in row_slices(offsets) for d in digests(buf[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])], pa.string())

    return docs.withColumn("fingerprint", fingerprint("text"))


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): _OUT, where the next document is the next by doc_id, and after the last the first.

    Ranges of doc_id are dealt out; the first row of each range also goes to the range before, so each text is
    shuffled once and no task sees all; rows that share a doc_id, or have none, are in one range. A null text is empty; a very
    long one is read whole, in pieces. Null doc_ids come first; rows with equal doc_id go by text, and repeated rows follow each
    other. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    found = rows.agg(F.min("key").alias("least"), F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).first()  # a cut for each range
    splits = np.unique(np.array([found["least"], *(found["cuts"] or [])] if found["least"] is not None else [0], np.int64))

    @F.arrow_udf("array<int>")
    def ranges(key: pa.Array) -> pa.Array:
        k = key.to_numpy(zero_copy_only=False)
        at = np.searchsorted(splits, k, side="right") - 1
        again = splits[at] == k
        before = np.where(at > 0, at - 1, len(splits) - 1)
        ends = np.concatenate([[0], np.cumsum(1 + again)])
        values = np.empty(ends[-1], np.int32)
        values[ends[:-1]] = 2 * at
        values[ends[1:][again] - 1] = 2 * before[again] + 1
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    dealt = rows.withColumn("x", F.explode(ranges("key"))).select(F.shiftright("x", 1).alias("range"), (F.col("x") % 2).alias("extra"), "key", "doc_id", "text")
    dealt = dealt.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "extra", "key", "text")

    def compare(held):
        """Of held rows (range, extra, doc_id, text), those that aren't extra and have a follower."""
        texts = [r[3] for r in held]
        own = [i for i in range(len(held) - 1) if not held[i][1]]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        needed = sorted({*own, *(i + 1 for i in own)})
        d = dict(zip(needed, digest_texts([texts[i] for i in needed]), strict=True))
        e = digest_texts(changed)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([held[i][2] for i in own], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                "fingerprint": pa.array([text_of(d[i]) for i in own], pa.string()),
                "edited_fingerprint": pa.array([text_of(x) for x in e], pa.string()),
                "near_edited": pa.array([likeness(d[i], x) for i, x in zip(own, e, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(d[i], d[i + 1]) for i in own], pa.float64()),
            }
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                for r in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                    if held and r[1] and held[-1][1] and held[-1][0] == r[0]:
                        continue
                    held.append(r)
                    size += len(r[3])
                    if size > 1 << 20 and len(held) > 1:
                        yield compare(held)
                        held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield compare(held)
        held.clear()
        tidy()

    return dealt.mapInArrow(run, _OUT)
