"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The distinct words of a batch that earlier batches of the task haven't had are concatenated (the ids of the others are kept, up to
MOST_KNOWN words) and their suffixes sorted, as deep as the longest piece. Each
piece's occurrences are a range, found by binary search; they are edges from the start to the end of the
occurrence. Sorted by end position, edges are relaxed for all words at once: a prefix's encoding ends with
the one piece that fits what the encoding of the shorter prefix ends with. Two pieces fit if merging
their joined text gives just them, which two-pointer runs over both pieces' own merges decide.

This gives the ids of the library's encoder for BPE models whose normaliser keeps the text, puts a space in front
and has byte fallback. Words begin at spaces if no piece has a space after another character; else a text is one word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, row_slices, text_buffer

SPACE = "▁"
NONE = np.int32(2**31 - 1)
SLICE = 1 << 20
MOST_CHARS = 200_000
MOST_KNOWN = 150_000
CACHE_BITS = 20
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_EDGE = re.compile(f"(?<![ {SPACE}])[ {SPACE}]")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """What encoding and decoding need of a model; its size is bounded by the vocabulary's."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(n)]
        self.bytes = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.decoded = [b"" if m.is_control(i) or m.is_unknown(i) else bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.size = n
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        scores = sorted({m.get_score(i) for i in self.id_of.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = np.full(n, NONE, np.int32)
        for i in self.id_of.values():
            self.rank[i] = place[m.get_score(i)]
        self.length = np.array([len(p) for p in self.pieces] + [1], np.int32)
        joins = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    joins[a * n + b] = i
        self.join_keys = np.array(sorted(joins), np.int64)
        self.joined = np.array([joins[k] for k in self.join_keys], np.int32)
        self.runs(joins)

    def runs(self, joins: dict) -> None:
        """For each piece, its own merges: their ranks, and the last and first symbols before each and at the end."""
        deep = max(map(len, self.id_of)) - 1
        self.steps = np.full((self.size, deep + 1), NONE, np.int32)
        self.last, self.first = (np.full((self.size, deep + 1), -1, np.int32) for _ in range(2))
        self.whole = []
        for p, i in self.id_of.items():
            symbols = [self.id_of.get(c, -1) for c in p]
            if -1 in symbols:
                continue
            at = 0
            self.last[i, 0], self.first[i, 0] = symbols[-1], symbols[0]
            while len(symbols) > 1:
                options = [(self.rank[j], k, j) for k in range(len(symbols) - 1) if (j := joins.get(symbols[k] * self.size + symbols[k + 1])) is not None]
                if not options:
                    break
                rank, k, j = min(options)
                symbols[k : k + 2] = [j]
                self.steps[i, at] = rank
                at += 1
                self.last[i, at], self.first[i, at] = symbols[-1], symbols[0]
            if symbols == [i]:
                self.whole.append(i)
        self.whole = np.array(sorted(self.whole), np.int32)
        self.codes = np.zeros((len(self.whole), int(self.length[self.whole].max())), np.uint32)
        for row, i in enumerate(self.whole):
            self.codes[row, : self.length[i]] = np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined texts of pieces a and b gives a and b."""
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(left):
            x, y = self.last[a, i], self.first[b, j]
            key = x.astype(np.int64) * self.size + y
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            cross = np.where(self.join_keys[at] == key, self.rank[self.joined[at]], NONE)
            ra, rb = self.steps[a, i], self.steps[b, j]
            broken = (cross < ra) & (cross <= rb) & (cross != NONE)  # of equal ranks, the leftmost merges first
            out[left[broken]] = False
            go = ~broken & ((ra != NONE) | (rb != NONE))
            by_a = ra <= rb
            i, j = (i + by_a)[go], (j + ~by_a)[go]
            left, a, b = left[go], a[go], b[go]
        return out


class Encoder:
    """Encodes words, and keeps those it knows up to a bound."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.cache_key = np.full(1 << CACHE_BITS, -1, np.int64)
        self.cache_fit = np.zeros(1 << CACHE_BITS, bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts, self.starts, self.held = [], [], [], 0

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.p.size + 1) + b
        slot = (key * 0x9E3779B1 >> 12) & ((1 << CACHE_BITS) - 1)
        out = self.cache_fit[slot]
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            u, back = np.unique(key[miss], return_inverse=True)
            x, y = u // (self.p.size + 1), u % (self.p.size + 1)
            plain = (x < self.p.size) & (y < self.p.size)
            fit = np.ones(len(u), bool)
            fit[plain] = self.p.fit(x[plain], y[plain])
            out[miss] = fit[back]
            s = (u * 0x9E3779B1 >> 12) & ((1 << CACHE_BITS) - 1)
            s, only = np.unique(s, return_index=True)
            self.cache_key[s], self.cache_fit[s] = u[only], fit[only]
        return out

    def edges(self, code: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and row in pieces.whole of each occurrence of a piece in code (0 between words)."""
        n, deep = len(code), self.p.codes.shape[1]
        bits = max(1, int(len(alphabet) + 1).bit_length())
        per = 62 // bits
        padded = np.concatenate([code, np.zeros(deep + per, np.int64)])
        own = np.searchsorted(alphabet, self.p.codes)
        own = np.minimum(own, len(alphabet) - 1)
        known = alphabet[own] == self.p.codes
        lengths = self.p.length[self.p.whole]
        inside = np.arange(deep)[None, :] < lengths[:, None]
        usable = np.flatnonzero((known | ~inside).all(axis=1))
        own = np.where(inside, own + 1, 0)[usable].astype(np.int64)
        inside = inside[usable]
        keys, low, high = [], [], []
        for k in range(0, deep, per):
            key, lo, hi = np.zeros(n, np.int64), np.zeros(len(usable), np.int64), np.zeros(len(usable), np.int64)
            for j in range(k, k + per):
                key = (key << bits) | padded[j : j + n]
                c = own[:, j] if j < deep else 0
                lo = (lo << bits) | c
                hi = (hi << bits) | (np.where(inside[:, j], c, (1 << bits) - 1) if j < deep else (1 << bits) - 1)
            keys.append(key)
            low.append(lo)
            high.append(hi)
        order = np.lexsort(keys[::-1])
        ranked = [k[order] for k in keys]

        def bound(wanted, after):
            """How many suffixes are less than wanted (after: or equal)."""
            a, z = np.zeros(len(usable), np.int64), np.full(len(usable), n, np.int64)
            while (a < z).any():
                mid = np.minimum((a + z) >> 1, n - 1)
                less, same = np.zeros(len(usable), bool), np.ones(len(usable), bool)
                for r, w in zip(ranked, wanted, strict=True):
                    v = r[mid]
                    less |= same & (v < w)
                    same &= v == w
                go = (less | same) if after else less
                go &= a < z
                stay = ~go & (a < z)
                a, z = np.where(go, mid + 1, a), np.where(stay, mid, z)
            return a

        begin, end = bound(low, False), bound(high, True)
        count = end - begin
        total = int(count.sum())
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        return order[at].astype(np.int32), np.repeat(usable, count).astype(np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        p = self.p
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet = np.unique(chars)
        starts = np.cumsum(lengths + 1) - lengths - 1
        n = int(lengths.sum()) + len(words)
        code = np.zeros(n, np.int64)
        own = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(chars)) + own
        code[place] = np.searchsorted(alphabet, chars) + 1
        start, row = self.edges(code, alphabet)
        piece = p.whole[row]
        single = np.zeros(n, bool)
        single[start[p.length[piece] == 1]] = True
        odd = place[~single[place]]  # characters without a piece
        start = np.concatenate([start, odd.astype(np.int32)])
        piece = np.concatenate([piece, np.full(len(odd), p.size, np.int32)])
        end = start + p.length[piece]
        begin = np.zeros(n, np.int64)
        begin[starts] = starts
        depth = end - np.maximum.accumulate(begin)[start]
        most = int(lengths.max())
        order = np.argsort(depth.astype(np.uint16) if most < 65536 else depth, kind="stable")
        start, piece, end = start[order], piece[order], end[order]
        edge = np.searchsorted(depth[order], np.arange(1, most + 2))
        last = np.full(n + 1, -1, np.int32)
        last[starts] = -2
        count = np.zeros(n + 1, np.int32)
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            a, b, z = last[start[s:e]], piece[s:e], end[s:e]
            ok = a == -2
            check = np.flatnonzero(a >= 0)
            ok[check] = self.fits(a[check], b[check])
            last[z[ok]] = b[ok]
            count[z[ok]] = count[start[s:e][ok]] + 1
        node = starts + lengths
        counts = count[node].astype(np.int64)
        out = np.empty(int(counts.sum()), np.int32)
        write = np.cumsum(counts) - 1
        where = np.empty(len(out), np.int64) if len(odd) else None
        active = np.flatnonzero(counts)
        node, left = node[active], counts[active]
        write = write[active]
        while len(node):
            out[write] = last[node]
            if where is not None:
                where[write] = node
            node = node - p.length[last[node]]
            write, left = write - 1, left - 1
            go = left > 0
            node, write, left = node[go], write[go], left[go]
        if len(odd):
            out, counts = self.with_bytes(out, counts, where, chars, place)
        return out, counts

    def with_bytes(self, out, counts, where, chars, place):
        """Characters without a piece as the pieces of their bytes."""
        at = np.flatnonzero(out == self.p.size)
        own = np.repeat(np.arange(len(counts)), counts)[at]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[np.searchsorted(place, where[at] - 1)]]
        extra = np.array([len(r) for r in raw], np.int64)
        widths = np.ones(len(out), np.int64)
        widths[at] = extra
        begin = np.cumsum(widths) - widths
        made = np.repeat(out, widths)
        for i, r in zip(at, raw, strict=True):
            made[begin[i] : begin[i] + len(r)] = self.p.bytes[list(r)]
        return made, counts + np.bincount(own, weights=extra - 1, minlength=len(counts)).astype(np.int64)

    def learn(self, new: list[str]) -> None:
        new.sort(key=len)
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and (end == at or chars + len(new[end]) <= MOST_CHARS):
                chars += len(new[end]) + 1
                end += 1
            part = new[at:end]
            ids, counts = self.encode_words(part)
            for w, k in zip(part, range(len(self.known), len(self.known) + len(part)), strict=True):
                self.known[w] = k
            self.ids.append(ids)
            self.counts.append(counts)
            self.starts.append(self.held + np.cumsum(counts) - counts)
            self.held += len(ids)
            at = end
        self.ids, self.counts, self.starts = ([np.concatenate(x)] for x in (self.ids, self.counts, self.starts))

    def words_of(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return _WORD.findall(marked) if self.p.cuts else [marked]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        return self.encode_cut([self.words_of(t) for t in texts])

    def encode_long(self, text: str):
        """The ids of one text, piece by piece, and the piece; pieces after the first begin where a word does."""
        at = 0
        while at < len(text):
            end = len(text)
            if self.p.cuts and (edge := _EDGE.search(text, at + SLICE)):
                end = edge.start()
            piece = text[at:end]
            marked = (SPACE if not at else "") + piece.replace(" ", SPACE)
            yield self.encode_cut([_WORD.findall(marked) if self.p.cuts else [marked]])[0], piece
            at = end

    def encode_cut(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each list of words has."""
        if len(self.known) > MOST_KNOWN:
            self.forget()
        new = set().union(*words) - self.known.keys()
        if new:
            self.learn(list(new))
        total = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter((self.known[w] for x in words for w in x), np.int64, int(total.sum()))
        if not len(index):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        counts = self.counts[0][index]
        at = np.repeat(self.starts[0][index] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], np.cumsum(total)])
        return self.ids[0][at], np.diff(ends[bounds])


def joined(pieces: Pieces, ids) -> str:
    return b"".join(map(pieces.decoded.__getitem__, ids)).decode("utf-8", "replace")


def decode(pieces: Pieces, ids) -> str:
    """The text of ids, without the space that encoding put in front; broken bytes become U+FFFD."""
    return joined(pieces, ids).removeprefix(" ")


_encoders: dict = {}


def _encoder(shared) -> Encoder:
    pieces = shared.value
    if _encoders.get("of") is not pieces:
        _encoders.clear()
        _encoders["of"], _encoders["is"] = pieces, Encoder(pieces)
    return _encoders["is"]


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids, round_trip (decoding the ids gives the text).

    A null text is empty; an empty text has no ids; a very long one is encoded whole, in pieces that end where words do (one word must fit
    into memory some hundred times). There are no ties: of equal
    merges the leftmost comes first, as in the library. A text that itself holds U+2581 decodes to spaces there, as with the
    library, and has round_trip false. Repeated rows are encoded each; extra columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_file or default_model()))

    def encode(batch):
        coder = _encoder(shared)
        _, offsets = text_buffer(batch.column(1))
        for a, z in row_slices(offsets, SLICE):  # words are kept from slice to slice of a partition
            texts = [t or "" for t in batch.column(1).slice(a, z - a).to_pylist()]
            if len(texts) == 1 and len(texts[0]) > SLICE:
                parts, same = [], [True]
                for own, piece in coder.encode_long(texts[0]):
                    same[0] &= joined(coder.p, own.tolist()) == (" " if not parts else "") + piece
                    parts.append(own)
                ids, counts = np.concatenate(parts), np.array([sum(map(len, parts))], np.int64)
                ends = np.concatenate([[0], counts])
            else:
                ids, counts = coder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                same = [decode(coder.p, ids[s:e].tolist()) == t for s, e, t in zip(ends[:-1], ends[1:], texts, strict=True)]
            yield {"doc_id": batch.column(0).slice(a, z - a), "n_tokens": pa.array(counts), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), "round_trip": pa.array(same)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "doc_id long, n_tokens long, ids array<int>, round_trip boolean", lambda: _encoder(shared).forget())


def decoded(tokens: DataFrame, model_file: str | None = None) -> DataFrame:
    """tokens (ids) with a column text, which replaces one of that name; other columns stay.

    Null ids give a null text, no ids an empty one. Each row is decoded for itself, repeated ones alike, ids of any number as a whole; an empty table
    gives an empty result.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces(model_file or default_model()))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(shared.value, x) for x in ids.to_pylist()], pa.string())

    return tokens.withColumn("text", text("ids"))
