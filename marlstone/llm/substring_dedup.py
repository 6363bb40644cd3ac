"""Substring dedup by suffix automata of reference shards and matching statistics.

The reference is the corpus itself, so of the corpus only stretches that may repeat get as far as an automaton. Each window of so many words
takes the least hash of its shingles as anchor: equal windows have equal anchors. Consecutive windows with one anchor are a piece: a
piece's windows are in no other piece, and each window is in one. Pieces whose anchor occurs once are left out, and of equal pieces
one is kept with its number of places. If these are all pieces of their anchor, their windows stand where they do. Else they
go to a shard with the other pieces of the anchor: the shard's suffix automaton knows in how many places each of its sequences stands, its
pieces are read for matching statistics, and where a match of a window's length stands in two places or more, the window repeats.

A broadcast of the shards would pass all that repeats in the corpus to the driver and each document to each shard. So a shard and what is to be
matched with it meet by a shuffle on the anchor, once for each different piece. What is broadcast are filters of anchors, of bounded size.
An anchor with very many different pieces (in a passage that stands in many surroundings) is split: the windows of a piece that begin within
some words of each other share a longer core, which is their new anchor, in the end the whole window. Cores of windows that
reach beyond a passage mostly occur once, and are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COEFFICIENTS, all_words, bit_filter, free_names, joined_words, map_batches, mix64, row_slices, set_bits, temporary, text_buffer, tidy, word_slices, written

WORDS, SHINGLE = 35, 8
MOST_KINDS = 256  # different pieces of an anchor; beyond them it is split
SPLITS = (7, 1)  # windows of a piece that share a core, at the first split and at the second
SHARD_WORDS = 50_000  # of a shard's pieces, on average; an anchor's pieces stay together


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each width values in a row, the first of equal ones."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        have += step
    return at


def pieces_of(buf: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, number of the first window, windows, words before the anchor, first byte, end and anchor of the pieces, by slices of the texts.

    A piece ends where a slice does.
    """
    shingle = min(SHINGLE, words)
    held, before = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
    for part in word_slices(buf, offsets):
        row, h, start, end = (np.concatenate(x) for x in zip(held, part, strict=True))
        n = len(row)
        new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        number = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        number[: new[1] if len(new) > 1 else n] += before
        keep = max(n - words + 1, 0)
        held, before = (row[keep:], h[keep:], start[keep:], end[keep:]), int(number[keep]) if keep < n else 0
        if n < words:
            continue
        with np.errstate(over="ignore"):
            x = mix64(sum(h[i : n - shingle + 1 + i] * COEFFICIENTS[i] for i in range(shingle)))
        at = leftmost_least(x, words - shingle + 1)
        window = np.flatnonzero(row[: n - words + 1] == row[words - 1 :])
        if not len(window):
            continue
        at = at[window]
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        first, last = window[edge], window[np.append(edge[1:], len(window)) - 1]
        yield row[first], number[first], last - first + 1, at[edge] - first, start[first], end[last + words - 1], x[at[edge]].view(np.int64)


def repeated_anchors(docs: DataFrame, words: int) -> DataFrame:
    """anchor: those of two pieces or more; counted before they are shuffled."""

    def find(batch):
        for *_, anchor in pieces_of(*text_buffer(batch.column(0)), words):
            yield {"anchor": pa.array(anchor)}

    return written(map_batches(docs.select("text"), find, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))


PIECE = "doc_id long, text_key long, first long, windows long, lead long, anchor long, content string"


def with_hashes(pieces: DataFrame) -> DataFrame:
    return pieces.withColumns({"h1": F.xxhash64("content"), "h2": F.xxhash64(F.lit(1), "content")})


def candidate_pieces(docs: DataFrame, words: int) -> DataFrame:
    """The pieces whose anchor may repeat: doc_id, text_key, first window, windows, words before the anchor, anchor, words joined by one space, and two hashes of these."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated_anchors(docs, words).select(F.col("anchor").alias("key"))))

    def find(batch):
        ids, keys, (buf, offsets) = batch.column(0), batch.column(1), text_buffer(batch.column(2))
        for row, first, windows, lead, start, end, anchor in pieces_of(buf, offsets, words):
            hit = np.flatnonzero(set_bits(anchor, shared.value))
            at = pa.array(row[hit])
            content = [b" ".join(buf[a:z].tobytes().split()).decode(errors="replace") for a, z in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
            yield {"doc_id": ids.take(at), "text_key": keys.take(at), "first": pa.array(first[hit]), "windows": pa.array(windows[hit]), "lead": pa.array(lead[hit]), "anchor": pa.array(anchor[hit]), "content": pa.array(content, pa.string())}

    return written(with_hashes(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"), find, PIECE)))


def split_pieces(pieces: DataFrame, words: int, widest: int, most: int) -> DataFrame:
    """Pieces (of widest windows or fewer) as ones of most windows or fewer: those that begin within so many words of each other before the anchor.

    The words that they share are hashed as anchor. A piece becomes widest / most pieces at most, each by a projection of its own.
    """
    lead, last = F.col("lead"), F.col("lead") - F.col("windows") + 1
    words_of = lambda at, n: F.array_join(F.slice("w", at.cast("int") + 1, n.cast("int")), " ")
    parts = []
    for i in range((widest - 1) // most + 1):
        g = F.floor(lead / most) - i
        far, near = F.least(lead, g * most + most - 1), F.greatest(last, g * most)
        cut = pieces.where(near <= far).withColumn("w", F.split("content", " "))
        core = words_of(lead - g * most, F.lit(words - most + 1))
        parts.append(cut.select("doc_id", "text_key", (F.col("first") + lead - far).alias("first"), (far - near + 1).alias("windows"), far.alias("lead"), F.xxhash64(F.lit(2), g, core).alias("anchor"), words_of(lead - far, far - near + words).alias("content")))
    own = functools.reduce(DataFrame.union, parts)
    return with_hashes(own.select(*(F.col(c).cast("long" if c != "content" else "string").alias(c) for c in own.columns)))


class SuffixAutomaton:
    """Of sequences, each added with its number of places; a state stands for sequences that end in the same places."""

    def __init__(self) -> None:
        self.on, self.link, self.length, self.places = [{}], [-1], [0], [0]

    def _state(self, on: dict, link: int, length: int) -> int:
        self.on.append(on)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.on) - 1

    def _split(self, p: int, x, q: int) -> int:
        """The state that p leads to by x, made one if q also stands for longer sequences."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(dict(self.on[q]), self.link[q], self.length[p] + 1)
        self.link[q] = own
        while p >= 0 and self.on[p].get(x) == q:
            self.on[p][x] = own
            p = self.link[p]
        return own

    def add(self, sequence: list, places: int) -> None:
        last = 0
        for x in sequence:
            q = self.on[last].get(x)
            if q is not None:
                last = self._split(last, x, q)
            else:
                own, p = self._state({}, 0, self.length[last] + 1), last
                while p >= 0 and x not in self.on[p]:
                    self.on[p][x] = own
                    p = self.link[p]
                if p >= 0:
                    self.link[own] = self._split(p, x, self.on[p][x])
                last = own
            self.places[last] += places

    def count(self) -> None:
        """Adds up places; after the last sequence."""
        for s in sorted(range(1, len(self.on)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]

    def matches(self, sequence: list, words: int) -> Iterator[tuple[int, int]]:
        """For each end in the sequence: the length of the longest match there, words at most, and in how many places it stands."""
        on, link, length, s, n = self.on, self.link, self.length, 0, 0
        for x in sequence:
            while s and x not in on[s]:
                s = link[s]
                n = length[s]
            if x in on[s]:
                s, n = on[s][x], n + 1
            while s and length[link[s]] >= words:
                s = link[s]
                n = length[s]
            yield min(n, words), self.places[s]


def stretches(hits: list[bool]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(hits):
        if hits[at]:
            first = at
            while at < len(hits) and hits[at]:
                at += 1
            yield first, at
        at += 1


def shard_repeats(kinds: list[tuple], words: int) -> Iterator[tuple]:
    """Of a shard's kinds (anchor, h1, h2, content, places): anchor, h1, h2 and ranges of windows that stand in two places or more."""
    reference = SuffixAutomaton()
    texts = [k[3].split(" ") for k in kinds]
    for k, text in zip(kinds, texts, strict=True):
        reference.add(text, k[4])
    reference.count()
    for k, text in zip(kinds, texts, strict=True):
        found = [n == words and places > 1 for n, places in reference.matches(text, words)]
        for a, z in stretches(found[words - 1 :]):
            yield (*k[:3], a, z)


def among(pieces: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pieces whose anchor is one of anchors (anchor), and maybe some others."""
    shared = pieces.sparkSession.sparkContext.broadcast(bit_filter(anchors.select(F.col("anchor").alias("key"))))

    @F.arrow_udf("boolean")
    def met(anchor: pa.Array) -> pa.Array:
        return pa.array(set_bits(anchor.to_numpy(zero_copy_only=False), shared.value))

    return pieces.where(met("anchor"))


def matched(pieces: DataFrame, contested: DataFrame, words: int) -> DataFrame:
    """anchor, h1, h2, lo, hi: of the different pieces of contested anchors (anchor, kinds), ranges of windows that stand in two places or more.

    A task holds one shard at a time. Of an anchor that the filter lets through but that isn't contested, what has more than MOST_KINDS pieces is passed over.
    """
    spark = pieces.sparkSession
    n = contested.agg(F.sum("kinds")).first()[0] or 0
    shards = max(1, n * 3 * words // 2 // SHARD_WORDS)

    def run(batches):
        shard, anchor, group, held = None, None, [], []

        def close():
            if len(group) <= MOST_KINDS:
                held.extend(group)
            group.clear()

        def flush():
            rows = list(shard_repeats(held, words))
            held.clear()
            return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("anchor", "h1", "h2", "lo", "hi"))})

        for batch in batches:
            for s, *kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind[0] != anchor or s != shard:
                    close()
                if s != shard and held:
                    yield flush()
                shard, anchor = s, kind[0]
                if len(group) <= MOST_KINDS:
                    group.append(tuple(kind))
        close()
        if held:
            yield flush()
        tidy()

    kinds = among(pieces, contested).groupBy("anchor", "h1", "h2", "content").agg(F.count("*").alias("places"))
    dealt = kinds.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "h1", "h2", "content", "places")
    parts = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "shard").sortWithinPartitions("shard", "anchor").mapInArrow(run, "anchor long, h1 long, h2 long, lo long, hi long")


def repeated_spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), spans (first word, end) of the texts in which windows of so many words also start anywhere else."""
    with temporary(docs.sparkSession) as keep:
        pieces, hits, widest = candidate_pieces(docs, words), [], words - min(SHINGLE, words) + 1
        for most in (*SPLITS, None):
            kinds = pieces.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("places"), F.max("windows").alias("windows"))
            per = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("places").alias("places"), F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.max("windows").alias("windows")))
            alone = per.where("kinds = 1 and places > 1").select("anchor", "h1", "h2", F.lit(0).cast("long").alias("lo"), F.col("windows").alias("hi"))
            found = written(alone.union(matched(pieces, per.where(F.col("kinds").between(2, MOST_KINDS)), words)))
            own = pieces.select("doc_id", "text_key", "first", "anchor", "h1", "h2").join(found, ["anchor", "h1", "h2"])
            hits.append(own.select("doc_id", "text_key", F.struct((F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") - 1 + words).alias("z")).alias("span")))
            crowded = per.where(F.col("kinds") > MOST_KINDS).select("anchor")
            if most is None or crowded.isEmpty():
                break
            most = min(most, widest)
            pieces, widest = written(split_pieces(written(among(pieces, crowded)), words, widest, most)), most  # to split others too changes nothing
        hits = functools.reduce(DataFrame.union, hits)
        return keep(written(hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("span")).alias("spans"))))  # of one document


def _kept(text: pa.Array, spans: pa.Array) -> dict[str, pa.Array]:
    """n_words, merged spans and the words left, of texts and spans (list of a, z)."""
    spans = spans.cast(pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))
    n_words, kept, removed = [], [], []
    buf, offsets = text_buffer(text)
    at = spans.to_pylist()
    for lo, hi in row_slices(offsets):
        own = buf[offsets[lo] : offsets[hi]]
        row, _, starts, ends = all_words(own, offsets[lo : hi + 1] - offsets[lo])
        counts = np.bincount(row, minlength=hi - lo)
        first, stay = np.cumsum(counts) - counts, np.ones(len(row), bool)
        for i, x in enumerate(at[lo:hi]):
            merged = []
            for span in x or []:
                if merged and span["a"] <= merged[-1]["z"]:
                    merged[-1]["z"] = max(merged[-1]["z"], span["z"])
                else:
                    merged.append(dict(span))
            for span in merged:
                stay[first[i] + span["a"] : first[i] + span["z"]] = False
            removed.append(merged)
        words, cuts = joined_words(own, starts[stay], ends[stay], row[stay], hi - lo)
        kept += [words[a:z].decode(errors="replace") for a, z in zip(cuts[:-1], np.maximum(cuts[1:] - 1, cuts[:-1]), strict=True)]
        n_words += counts.tolist()
    return {"n_words": pa.array(n_words, pa.int64()), "removed": pa.array(removed, spans.type), "kept_text": pa.array(kept, pa.string())}


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with n_words, removed (spans of words, first and end, in order) and kept_text: the text without words in windows of so many words that repeat.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is so many consecutive words of one text; it repeats if its words also start anywhere else, in the
    same text too, where windows may overlap. What is left is joined by one space. A null or empty text, or one with fewer
    words, keeps what it has. Each row stands for itself: two rows with one text, and with one doc_id too, lose all windows of it; rows with a null doc_id are like
    others. Columns of docs named like the new ones are replaced, other extra columns stay; an empty table gives an empty result. Texts of any
    length are read in slices, and a text's words are shuffled only if something in it repeats.
    """
    if words < 2:
        raise ValueError("windows have two words or more")
    spans = repeated_spans(docs, words)
    docs = docs.drop("n_words", "removed", "kept_text")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select(F.xxhash64("doc_id", "text_key").alias("key"))))
    own_id, own_key, own_spans, made = free_names(docs, "own_id", "own_key", "own_spans", "made")

    @F.arrow_udf("boolean")
    def met(key: pa.Array) -> pa.Array:
        return pa.array(set_bits(key.to_numpy(zero_copy_only=False), shared.value))

    @F.arrow_udf("struct<n_words:long,removed:array<struct<a:long,z:long>>,kept_text:string>")
    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = _kept(text, spans)
        tidy()
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    kept = kept.asNondeterministic()  # else it is called once for each column taken from what it gives
    id_, text_key = F.col("doc_id").cast("long"), F.xxhash64("text")
    gone = spans.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("spans").alias(own_spans))
    hit = met(F.xxhash64(id_, text_key))
    rest = docs.where(hit).join(gone, id_.eqNullSafe(F.col(own_id)) & (text_key == F.col(own_key)), "left").select(*docs.columns, own_spans)
    stay = docs.where(~hit).withColumn(own_spans, F.lit(None).cast("array<struct<a:long,z:long>>"))
    parts = [x.withColumn(made, kept("text", own_spans)).select(*docs.columns, f"{made}.*") for x in (stay, rest)]
    return parts[0].union(parts[1])


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 of the words that are left; the cases are those of without_repeats."""
    found = without_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda x, s: x + s.z - s.a)
    return found.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
