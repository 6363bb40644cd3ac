"""Runs of periodic words, from the suffix array, the LCP array, longest previous factors and LZ blocks of each text.

A run is a stretch of words with smallest period q that no neighbouring word extends. The texts of a slice are one sequence of symbols, of which
no two texts share any, so one suffix array serves them all. The previous-factor array cuts a text into LZ blocks; a run that
crosses or touches a block's edge is found there by extending candidate periods both ways (Main), the others lie inside a block and are copied from
the block's earlier occurrence, by buckets of runs with one start. All steps are linear in the text but for the sorting.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_words, joined_words, map_batches, mix64, row_slices, text_buffer

FEWEST, EXPONENT = 6, 4
SLICE = 1 << 19
STEPS = 32  # words compared for all pairs at once; beyond them pair by pair
WIDE, FEW = 1024, 32  # edges with more than WIDE words around and more than FEW candidate periods take Z arrays


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; each round sorts only what still shares its prefix with others."""
    n = len(symbols)
    sa = np.argsort(symbols)
    edge = np.concatenate([[True], symbols[sa[1:]] != symbols[sa[:-1]]]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = first, -1
    open_ = np.flatnonzero(~(edge & np.append(edge[1:], True)))
    h = 1
    while len(open_):
        at = sa[open_]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key)
        sa[open_], key = at[order], key[order]
        edge = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sa[open_]] = open_[np.maximum.accumulate(np.where(edge, np.arange(len(open_)), 0))]
        open_ = open_[~(edge & np.append(edge[1:], True))]
        h *= 2
    return sa


def _longer(w: np.ndarray, a: int, b: int) -> int:
    n, at, size = len(w) - max(a, b), 0, 4 * STEPS
    while at < n:
        size = min(size, n - at)
        differ = w[a + at : a + at + size] != w[b + at : b + at + size]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, size = at + size, 2 * size
    return n


def common_lengths(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of different places of w, which ends with a symbol of its own, how long what follows is equal."""
    out, left = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(STEPS):
        left = left[w[i[left] + k] == w[j[left] + k]]
        if not len(left):
            return out
        out[left] = k + 1
    for x in left.tolist():
        out[x] += _longer(w, int(i[x]) + STEPS, int(j[x]) + STEPS)
    return out


def lcp_array(w: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each suffix in order with the one before. Only values that don't follow from the place before are compared; their sum is O(n log n)."""
    n = len(sa)
    before = np.full(n, n, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] < n) & (before[1:] > 0) & (w[:-2] == w[before[1:] - 1])
    own = np.flatnonzero(~follows)
    base = np.zeros(n, np.int64)
    base[own] = common_lengths(w, own, before[own])
    at = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return (base[at] - (np.arange(n) - at))[sa]


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the length of the longest factor that also starts before it, and where."""
    n = len(sa)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    alone = lcp == 0
    first = np.flatnonzero(alone)
    size = np.diff(np.append(first, n))
    two = first[size == 2]
    a, b = np.minimum(sa[two], sa[two + 1]), np.maximum(sa[two], sa[two + 1])
    length[b], source[b] = lcp[two + 1], a
    many = np.repeat(size > 2, size)
    places, commons = sa[many].tolist(), lcp[many].tolist()
    stack, shared = [], []

    def settle(p: int, with_last: int, l: int, place: int) -> None:
        if with_last >= l:
            if with_last:
                length[p], source[p] = with_last, stack[-1]
        else:
            length[p], source[p] = l, place

    for place, l in zip(places, commons, strict=True):
        while stack and (stack[-1] > place or not l):
            with_last, p = shared.pop(), stack.pop()
            settle(p, with_last, l, place)
            l = min(l, with_last) if l else 0
        stack.append(place)
        shared.append(l)
    while stack:
        with_last, p = shared.pop(), stack.pop()
        settle(p, with_last, 0, -1)
    return length, source


def z_array(s: list) -> list[int]:
    n = len(s)
    z = [0] * n
    l = r = 0
    for i in range(1, n):
        k = min(r - i, z[i - l]) if i < r else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > r:
            l, r = i, i + k
    return z


def _by_z(w: np.ndarray, b: int, u: int, left: int) -> tuple[np.ndarray, ...]:
    """Periods, ways back and on of the two kinds of runs at edge b, from Z arrays of left words before it and u after."""
    after, before = w[b : b + u + 1].tolist(), w[b - left : b][::-1].tolist()
    on = z_array([*after, -2, *before[::-1], *after])
    back = z_array([*before, -2, *after[:u][::-1], *before])
    p, q = np.arange(1, u + 1), np.arange(1, left + 1)
    on, back = np.array(on), np.array([*back, 0])
    return p, back[left + 1 + u - p], on[p], q, np.where(q < left, back[q], 0), on[u + 2 + left - q]


def edge_runs(w: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray, room: np.ndarray, fewest: int, exponent: int) -> np.ndarray:
    """Runs (start, end, period) that cross or touch the edges before LZ blocks and end in the block or at its edges.

    before: length of the block before; room: words of the text before the edge; w ends with a symbol of its own.
    """
    left = np.minimum(lengths + 2 * before + 1, room)
    back_w = np.append(w[:-1][::-1], -1)
    n, found = len(w) - 1, []

    def take(b, u, reach, p, back, on, right):
        s, e = b - back - (0 if right else p), b + on + (p if right else 0)
        ok = (back + on >= p) & (e <= b + u) & ((b - s < reach[0]) | (reach[0] == reach[1])) & (e - s >= np.maximum(fewest, exponent * p))
        found.append(np.stack([s[ok], e[ok], np.broadcast_to(p, s.shape)[ok]], 1))

    def pairs(which, count):
        k = np.repeat(which, count[which])
        p = np.arange(len(k)) - np.repeat(np.cumsum(count[which]) - count[which], count[which]) + 1
        return k, p

    def candidates(which, count, right):
        k, p = pairs(which, count)
        b = starts[k]
        x, y = (b, b + p) if right else (b - p, b)
        near = w[x] == w[y]
        inner = x > 0
        near[inner] |= w[x[inner] - 1] == w[y[inner] - 1]
        return k[near], p[near]

    wide = lengths + left > WIDE
    for right, count in ((True, lengths), (False, left)):
        k, p = candidates(np.arange(len(starts)), count, right)
        many = (np.bincount(k, minlength=len(starts)) > FEW) & wide
        direct = ~many[k]
        k, p = k[direct], p[direct]
        b = starts[k]
        x, y = (b, b + p) if right else (b - p, b)
        take(b, lengths[k], (left[k], room[k]), p, common_lengths(back_w, n - x, n - y), common_lengths(w, x, y), right)
        for z in np.flatnonzero(many).tolist():
            b, u, l = int(starts[z]), int(lengths[z]), int(left[z])
            p, back, on, q, back_q, on_q = _by_z(w, b, u, l)
            p, back, on = (p, back, on) if right else (q, back_q, on_q)
            take(b, u, (np.int64(l), room[z]), p, back, on, right)
    return np.concatenate(found)


def runs_of(hashes: np.ndarray, row: np.ndarray, fewest: int = 2, exponent: int = 2) -> np.ndarray:
    """Every run of at least max(fewest, exponent * period) words of each row: start, end, period, ordered; places are those of the sequence.

    exponent is 2 or more: that a run is repeated at all.
    """
    n = len(hashes)
    if not n:
        return np.zeros((0, 3), np.int64)
    symbols = mix64(hashes ^ mix64(row.astype(np.uint64) + np.uint64(1)))
    sa = suffix_array(symbols)
    w = np.empty(n + 1, np.int64)
    w[sa] = np.cumsum(np.concatenate([[0], symbols[sa[1:]] != symbols[sa[:-1]]]))
    w[n] = -1
    lcp = lcp_array(w, sa)
    length, source = previous_factors(sa, lcp)
    if length.max() < fewest - max(1, fewest // exponent):
        return np.zeros((0, 3), np.int64)  # a run repeats all but its first period
    steps, starts, at = np.maximum(length, 1).tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    sizes = np.diff(np.append(starts, n))
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    own = np.repeat(heads, np.diff(np.append(heads, n)))  # where the text of each word starts
    head = own[starts]
    before = np.where(starts > head, np.concatenate([[0], sizes[:-1]]), 0)
    ends = np.append(heads[1:], n)  # each text's end is an edge of no block
    last = np.searchsorted(starts, ends) - 1
    found = edge_runs(w, np.append(starts, ends), np.append(sizes, np.zeros(len(ends), np.int64)), np.append(before, sizes[last]), np.append(starts - head, ends - heads), fewest, exponent)
    if not len(found):
        return found
    found = found[np.lexsort(found.T[[2, 1, 0]])]
    found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])]  # of one stretch, the smallest period
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in found.tolist():
        buckets.setdefault(s, []).append((e, p))
    order = sorted(buckets)
    inside = np.flatnonzero(sizes >= fewest + 2)
    for b, u, src in zip(starts[inside].tolist(), sizes[inside].tolist(), source[starts[inside]].tolist(), strict=True):
        if src < 0:
            continue
        i = bisect.bisect_right(order, src)
        while i < len(order) and order[i] < src + u:
            s = order[i]
            for e, p in buckets[s]:
                if e < src + u:
                    to = s + b - src
                    if to not in buckets:
                        bisect.insort(order, to)
                        buckets[to] = []
                    if (e + b - src, p) not in buckets[to]:
                        buckets[to].append((e + b - src, p))
            i += 1
    return np.array(sorted((s, e, p) for s, own_runs in buckets.items() for e, p in own_runs), np.int64)


def rotated(ids: list[int | None], counts: np.ndarray) -> np.ndarray:
    """For each word of rows with these ids and counts of words, which word stands there by the rule that repeats stretches of every tenth text."""
    at = np.arange(int(counts.sum()))
    for i, n, first in zip(ids, counts.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[first + a : first + n] = first + a + np.arange(n - a) % p
    return at


def with_runs(docs: DataFrame, fewest: int = FEWEST, exponent: int = EXPONENT, rotate: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, runs (start, length, period of each, by start, then period) and the text without repeats.

    Words are [^\\x20\\x09-\\x0D]+ and equal if their bytes are (by a hash of 64 bits). collapsed_text has the words that no run contains after its first period, joined by
    one space. A null or empty text, or one without words, has no runs and an empty collapsed text. Rows stand for themselves, repeated ones and
    those with a null doc_id too; extra columns are ignored, whatever their names; an empty table gives an empty result. A text of any length is
    taken whole by one task, which holds some 300 bytes a word of it. rotate first makes texts periodic by a rule on doc_id (see rotated; a
    null doc_id leaves the text as it is).
    """

    def find(batch):
        ids, (buf, offsets) = batch.column(0).to_pylist(), text_buffer(batch.column(1))
        for lo, hi in row_slices(offsets, SLICE):
            own = buf[offsets[lo] : offsets[hi]]
            row, h, starts, ends = all_words(own, offsets[lo : hi + 1] - offsets[lo])
            counts = np.bincount(row, minlength=hi - lo)
            if rotate:
                at = rotated(ids[lo:hi], counts)
                h, starts, ends = h[at], starts[at], ends[at]
            runs = runs_of(h, row, fewest, exponent)
            drop = np.zeros(len(h) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 1], -1)
            stay = np.cumsum(drop)[:-1] == 0
            text, cuts = joined_words(own, starts[stay], ends[stay], row[stay], hi - lo)
            first = np.cumsum(counts) - counts
            of = np.searchsorted(first + counts, runs[:, 0], side="right")
            per = np.searchsorted(of, np.arange(hi - lo + 1))
            values = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
            yield {
                "doc_id": pa.array(ids[lo:hi], pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(per, pa.int32()), values),
                "collapsed_text": pa.array([text[a:z].decode(errors="replace") for a, z in zip(cuts[:-1], np.maximum(cuts[1:] - 1, cuts[:-1]), strict=True)], pa.string()),
            }

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256.

    Of runs of equal length the first is the longest, then the one of the smaller period; without runs, its columns are null. Texts are made periodic by
    the rule on doc_id. The other cases are those of with_runs.
    """
    found = with_runs(docs, rotate=True)
    best = F.get(F.array_sort("runs", lambda a, b: F.when(a.length != b.length, F.when(a.length > b.length, -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0)), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed_text")
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
