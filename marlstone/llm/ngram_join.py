"""N-gram Jaccard join: exact, on sets of word shingles.

1. One pass counts shingles within batches; a bounded list of very frequent ones is put last in the order of
   shingles. Any order is exact: the list only saves work, and nothing depends on its being complete.
2. Each set keeps its prefix in that order (two sets that link share a shingle of their prefixes) and a
   bitmap signature with the parity of the shingles hashed to each bit. Equal sets become one node.
3. Prefix shingles deal the nodes into runs. A run is cut where sizes leave a gap no link can span, and
   the bitmaps bound the overlap from above; what may link is joined to coarse groups. A node with a listed shingle in
   its prefix, or one whose run is longer than MOST_RUN, is crowded; such runs are not formed.
4. Crowded nodes are counted anew: all their shingles are dealt out, each gets the number of crowded nodes that
   hold it, and their prefixes are taken again in the order of these numbers, rarest first. So shared passages don't
   deal documents together unless more than a fifth of their shingles is left to nothing else. Two crowded nodes that
   link share a shingle of the new prefixes; a link with a node that isn't crowded was met in step 3.
   Runs that are long even now, such as those of thousands of near copies, are joined to rough groups.
5. Each group is a tile; larger ones are cut into tiles of neighbouring size bands and blocks. In a tile,
   bitmaps bound the overlap, then exact intersection of sorted arrays decides. Only links that join two parts
   of a tile leave it, never all pairs.
6. Of a large group, first each block meets itself and some pivots: a group of copies becomes one part in work
   that is linear in it. Then the nodes that are left outside the largest part meet all nodes of the group, by
   bitmaps alone; what these let through is grouped anew and compared by sorted arrays.
7. Components over these links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COEFFICIENTS, LOWER, bit_filter, components, map_batches, mix64, row_slices, set_bits, shuffle_partitions, temporary, text_buffer, tidy, without, word_hashes, word_slices, written

SHINGLE = 5
PERCENT = 80
MOST_RUN = 256
HELD_ENTRIES = 1_000_000
BUCKET_ENTRIES = 250_000
HOT_LIST = 1 << 16
HOT_LOCAL, HOT_TOTAL = 4, 64
COUNTED = 1_000_000
TILE_NODES = 512
PIVOTS = 64
TILE_SHINGLES = 2_000_000
PIECE = 1 << 17
_HOT_BITS = 20
_LISTED = 1 << 31


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the successive k-word shingles."""
    c = COEFFICIENTS[1000 : 1000 + k] | np.uint64(1)
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1] * c[0]
        for j in range(1, k):
            out = out + h[j : len(h) - k + 1 + j] * c[j]
    return mix64(out)


def few_words(h: np.ndarray) -> np.ndarray:
    c = COEFFICIENTS[1000 : 1000 + len(h)] | np.uint64(1)
    with np.errstate(over="ignore"):
        return mix64(np.array([(h * c).sum() + np.uint64(len(h))], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def distinct(x: np.ndarray) -> np.ndarray:
    """x sorted, without repeats; in place, so that a long x needs no second copy."""
    x.sort()
    done = 0
    for a in range(0, len(x), PIECE):
        part = x[a : a + PIECE].copy()
        keep = np.ones(len(part), bool)
        np.not_equal(part[1:], part[:-1], out=keep[1:])
        if done and part[0] == x[done - 1]:
            keep[0] = False
        part = part[keep]
        x[done : done + len(part)] = part
        done += len(part)
    return x[:done]


def long_set(buf: np.ndarray, k: int) -> np.ndarray:
    """The set of one text of any length, slice by slice."""
    made, tail, total = [], np.zeros(0, np.uint64), 0
    for _, h, _, _ in word_slices(buf, np.array([0, len(buf)]), LOWER):
        total += len(h)
        h = np.concatenate([tail, h])
        if len(h) >= k:
            made.append(np.unique(rolled(h, k)))
        tail = h[-(k - 1) :] if k > 1 else h[:0]
    if total < k:
        return few_words(tail) if total else np.zeros(0, np.uint64)
    out, at = np.empty(sum(map(len, made)), np.uint64), 0
    while made:
        part = made.pop()
        out[at : at + len(part)] = part
        at += len(part)
    return distinct(out)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct uint64 hashes of the k-word shingles by row; with fewer words, the whole sequence as one."""
    h, _, _, counts = word_hashes(buf, offsets, LOWER)
    ends = np.concatenate([[0], np.cumsum(counts)])
    all_ = rolled(h, k) if len(h) >= k else h
    out = []
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        if z - a >= k:
            out.append(distinct(all_[a : z - k + 1].copy()))
        else:
            out.append(few_words(h[a:z]) if z > a else np.zeros(0, np.uint64))
    return out


def batch_sets(text: pa.Array, k: int):
    buf, offsets = text_buffer(text)
    for a, z in row_slices(offsets):
        part = buf[offsets[a] : offsets[z]]
        yield a, z, [long_set(part, k)] if z == a + 1 else shingle_sets(part, offsets[a : z + 1] - offsets[a], k)


def set_hashes(x: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed numbers."""
    out = np.zeros(2, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(x), PIECE):
            part = x[a : a + PIECE]
            out[0] += mix64(part + np.uint64(1)).sum(dtype=np.uint64)
            out[1] += mix64(part ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return tuple(out.view(np.int64).tolist())


def bitmap(x: np.ndarray) -> np.ndarray:
    """Parity by bit; as many bits as shingles at least, a power of two of 64-bit words."""
    bits = 64
    while bits < len(x):
        bits *= 2
    odd = np.zeros(bits, np.uint8)
    for a in range(0, len(x), PIECE):
        slot = ((x[a : a + PIECE] >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
        if bits <= PIECE:
            odd ^= (np.bincount(slot, minlength=bits) & 1).astype(np.uint8)
        else:
            slot, n = np.unique(slot, return_counts=True)
            odd[slot] ^= (n & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    while len(b) > words:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def needed(a, b, percent: int):
    """The least overlap at which sets of sizes a and b link."""
    return -((-percent * (a + b)) // (100 + percent))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Join:
    """Union-find over the members of a tile or run; possible() and exact() tell of pairs."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int):
        self.sizes, self.percent = sizes.astype(np.int64), percent
        self.parent = list(range(len(sizes)))
        self.words = np.array([len(b) for b in bitmaps])
        self.by_width = {}
        for w in np.unique(self.words):  # each row folded to this width, as far as it is that wide
            ids = np.flatnonzero(self.words >= w)
            self.by_width[int(w)] = (ids, np.stack([fold(bitmaps[i], int(w)) for i in ids]))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def possible(self, i: int, order_after: np.ndarray) -> np.ndarray:
        """Members after i, in the order of sizes, that the bitmaps let link with it; likeliest first."""
        ids, rows = self.by_width[int(self.words[i])]
        own = rows[np.searchsorted(ids, i)]
        ok = order_after[ids]
        ids, rows = ids[ok], rows[ok]
        a, b = self.sizes[i], self.sizes[ids]
        fits = 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
        ids, rows, b = ids[fits], rows[fits], b[fits]
        if not len(ids):
            return ids
        apart = np.bitwise_count(rows ^ own).sum(axis=1).astype(np.int64)
        keep = (a + b - apart) // 2 >= needed(a, b, self.percent)
        return ids[keep][np.argsort(apart[keep], kind="stable")]

    def links(self, sets: list[np.ndarray] | None):
        """Pairs that join two parts; exact where sets are given, else all that the bitmaps allow."""
        after = np.ones(len(self.sizes), bool)
        for i in np.argsort(self.sizes, kind="stable"):
            after[i] = False
            for j in self.possible(int(i), after):
                p, q = self.find(int(i)), self.find(int(j))
                if p == q:
                    continue
                if sets is not None:
                    x, y = sets[i], sets[j]
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    if int((y[at] == x).sum()) < needed(int(self.sizes[i]), int(self.sizes[j]), self.percent):
                        continue
                self.parent[p] = q
                yield int(i), int(j)


def prefix_length(n, percent: int):
    return n - (-(-percent * n // 100)) + 1


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most HOT_LIST shingles that many documents share, counted by parts of about COUNTED shingles, and their places by frequency."""

    def count(batch):
        held, size = [], 0
        for _, z, sets in batch_sets(batch.column(0), k):
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED or z == batch.num_rows:
                u, n = np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
                keep = n >= HOT_LOCAL
                yield {"token": signed(u[keep]), "n": pa.array(n[keep].astype(np.int64))}

    found = map_batches(docs.select("text"), count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= HOT_TOTAL).orderBy(F.desc("n"), "token").limit(HOT_LIST).collect()
    token = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], (len(rows) - order).astype(np.uint32)


class Listed:
    """Tells which shingles are in the list."""

    def __init__(self, listed: tuple[np.ndarray, np.ndarray]):
        self.token, self.place = listed
        self.flags = np.zeros(1 << _HOT_BITS, bool)
        self.flags[(self.token & np.uint64((1 << _HOT_BITS) - 1)).astype(np.int64)] = True

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = self.flags[(x & np.uint64((1 << _HOT_BITS) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.token[np.minimum(np.searchsorted(self.token, x[at]), len(self.token) - 1)] == x[at]
        return out

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.token, x)] + np.uint32(_LISTED)


def described(docs: DataFrame, listed, k: int, percent: int) -> DataFrame:
    """row, doc_id, n, two hashes of the set, its prefix without listed shingles, whether that lacks some, its bitmap."""

    def describe(batch):
        top = Listed(listed.value)
        for a, z, sets in batch_sets(batch.column(1), k):
            n, h, prefix, crowded, maps = [], [], [], [], []
            for x in sets:
                length = prefix_length(len(x), percent) if len(x) else 0
                own = []
                for s in range(0, len(x), PIECE):  # until the prefix is full
                    part = x[s : s + PIECE]
                    own.append(part[~top.mask(part)][:length].copy())
                    length -= len(own[-1])
                    if not length:
                        break
                n.append(len(x))
                h.append(set_hashes(x))
                prefix.append(b"".join(o.tobytes() for o in own))
                crowded.append(length > 0)
                maps.append(bitmap(x).tobytes() if len(x) else b"")
            yield {"doc_id": batch.column(0).slice(a, z - a), "n": pa.array(n, pa.int64()), "h1": pa.array([x[0] for x in h], pa.int64()), "h2": pa.array([x[1] for x in h], pa.int64()), "prefix": pa.array(prefix, pa.binary()), "crowded": pa.array(crowded), "bitmap": pa.array(maps, pa.binary())}

    made = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), describe, "doc_id long, n long, h1 long, h2 long, prefix binary, crowded boolean, bitmap binary")
    return made.withColumn("row", F.monotonically_increasing_id())


_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4")])
_SHARED = np.dtype([("node", "<i8"), ("token", "<u8"), ("n", "<u4"), ("count", "<u4")])
_BLOCKS = "bucket long, block binary"


def blocks_of(entries: np.ndarray, key: str, buckets: int) -> dict:
    """The entries packed into a block for each bucket of their key."""
    bucket = (mix64(entries[key].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    entries = entries[order]
    bucket, at = np.unique(bucket[order], return_index=True)
    ends = [*at[1:], len(entries)] if len(at) else []
    return {"bucket": pa.array(bucket, pa.int64()), "block": pa.array([entries[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary())}


def by_bucket(blocks: DataFrame, dtype: np.dtype, fn, schema: str) -> DataFrame:
    """fn of the blocks of each bucket, one after the other; Spark sorts (and spills) the blocks of a task."""

    def run(batches):
        rows = ((b, x) for batch in batches for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, held in itertools.groupby(rows, key=lambda r: r[0]):
            for made in fn(np.frombuffer(x.as_buffer(), dtype) for _, x in held):
                yield pa.RecordBatch.from_pydict(made)
        tidy()

    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def settled(entries: np.ndarray, known: np.ndarray, most_run: int):
    """entries of short runs in the order of token, size, node without repeats; those of long ones; the tokens known to be long."""
    entries = entries[np.lexsort((entries["node"], entries["n"], entries["token"]))]
    if not len(entries):
        return entries, entries, known
    t, d = entries["token"], entries["node"]
    keep = np.ones(len(entries), bool)
    keep[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    entries = entries[keep]
    token, run, count = np.unique(entries["token"], return_inverse=True, return_counts=True)
    long_ = count > most_run
    if len(known):
        long_ |= known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token
    return entries[~long_[run]], entries[long_[run]], np.union1d(known, token[long_])


def runs_in(blocks, percent: int, most_run: int, most_held: int):
    """kind, a, b: node b is in run a (0), or shares with a first node a a shingle of more than most_run (1).

    When more than most_held entries are held, those of long runs are given out and only their tokens are kept.
    """
    held, rows, limit, known, firsts = [], 0, most_held, np.zeros(0, np.uint64), {}

    def starred(far):
        for t in np.unique(far["token"]).tolist():
            firsts.setdefault(t, int(far["node"][np.searchsorted(far["token"], np.uint64(t))]))
        return 1, np.array([firsts[t] for t in far["token"].tolist()], np.int64), far["node"].copy()

    for block in blocks:
        held.append(block)
        rows += len(block)
        if rows > limit:
            near, far, known = settled(np.concatenate(held), known, most_run)
            if len(far):
                yield starred(far)
            held, rows = [near], len(near)
            limit = max(limit, 2 * rows)
    if not rows:
        return
    near, far, known = settled(np.concatenate(held), known, most_run)
    held.clear()
    if len(far):
        yield starred(far)
    if not len(near):
        return
    new = np.ones(len(near), bool)
    new[1:] = (near["token"][1:] != near["token"][:-1]) | (100 * near["n"][:-1].astype(np.int64) < percent * near["n"][1:].astype(np.int64))
    run = np.cumsum(new) - 1
    keep = np.bincount(run)[run] > 1
    kept, run = near[keep], run[keep]
    if not len(kept):
        return
    _, run = np.unique(run, return_inverse=True)
    with np.errstate(over="ignore"):
        name = np.zeros(int(run.max()) + 1, np.uint64)
        np.add.at(name, run, mix64(kept["node"].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    name = mix64(name)
    _, first = np.unique(name, return_index=True)  # many shingles have the same nodes
    chosen = np.zeros(len(name), bool)
    chosen[first] = True
    keep = chosen[run]
    yield 0, name[run[keep]].view(np.int64), kept["node"][keep].copy()


def candidate_runs(entries: DataFrame, percent: int) -> DataFrame:
    """kind, a, b of the runs of blocks of entries, dealt by token."""

    def find(blocks):
        for kind, a, b in runs_in(blocks, percent, MOST_RUN, HELD_ENTRIES):
            yield {"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b)}

    return by_bucket(entries, _ENTRY, find, "kind int, a long, b long")


def prefix_entries(nodes: DataFrame, buckets: int) -> DataFrame:
    """Blocks of the prefix shingles of nodes."""

    def deal(whole):
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            prefixes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            lengths = np.array([len(x) for x in prefixes])
            entries = np.empty(int(lengths.sum()), _ENTRY)
            entries["token"] = np.concatenate(prefixes)
            entries["node"] = np.repeat(batch.column(0).to_numpy(), lengths)
            entries["n"] = np.repeat(batch.column(1).to_numpy(), lengths)
            yield blocks_of(entries, "token", buckets)

    return map_batches(nodes.select("node", "n", "prefix"), deal, _BLOCKS)


def crowded_entries(sets: DataFrame, listed, buckets: int, percent: int) -> DataFrame:
    """Blocks of the prefix shingles of the crowded nodes (node, set), in the order of how many of them hold a shingle; listed ones last."""

    def deal(batch):
        top = Listed(listed.value)
        for node, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            late = top.mask(x)
            yield node, x[~late], x[late], len(x)

    def deal_blocks(batch):
        held, size = [], 0
        top = Listed(listed.value)

        def packed():
            near, far = np.empty(sum(len(r[1]) for r in held), _ENTRY), np.empty(sum(len(r[2]) for r in held), _SHARED)
            for out, c in ((near, 1), (far, 2)):
                lengths = [len(r[c]) for r in held]
                out["token"] = np.concatenate([r[c] for r in held])
                out["node"] = np.repeat(np.array([r[0] for r in held], np.int64), lengths)
                out["n"] = np.repeat(np.array([r[3] for r in held], np.uint32), lengths)
            far["count"] = top.rank(far["token"])
            for kind, entries, key in ((0, near, "token"), (1, far, "node")):
                made = blocks_of(entries, key, buckets)
                yield {"kind": pa.array(np.full(len(made["bucket"]), kind, np.int32))} | made

        for row in deal(batch):
            held.append(row)
            size += row[3]
            if size > COUNTED:
                yield from packed()
                held, size = [], 0
        if held:
            yield from packed()

    def count(blocks):
        near, *_ = settled(np.concatenate(list(blocks)), np.zeros(0, np.uint64), 1 << 40)
        _, at, n = np.unique(near["token"], return_inverse=True, return_counts=True)
        n = n[at]
        near, n = near[n > 1], n[n > 1]
        for s in range(0, len(near), BUCKET_ENTRIES):
            part = near[s : s + BUCKET_ENTRIES]
            out = np.empty(len(part), _SHARED)
            out["node"], out["token"], out["n"], out["count"] = part["node"], part["token"], part["n"], np.minimum(n[s : s + BUCKET_ENTRIES], _LISTED - 1)
            yield blocks_of(out, "node", buckets)

    def choose(blocks):
        x = np.concatenate(list(blocks))
        x = x[np.lexsort((x["token"], x["count"], x["node"]))]
        keep = np.ones(len(x), bool)
        keep[1:] = (x["node"][1:] != x["node"][:-1]) | (x["token"][1:] != x["token"][:-1])
        x = x[keep]
        _, first, own, shared = np.unique(x["node"], return_index=True, return_inverse=True, return_counts=True)
        n = x["n"].astype(np.int64)
        alone = n - shared[own]  # shingles of no other crowded node come first in the order
        x = x[np.arange(len(x)) - first[own] < prefix_length(n, percent) - alone]
        for s in range(0, len(x), BUCKET_ENTRIES):
            part = x[s : s + BUCKET_ENTRIES]
            out = np.empty(len(part), _ENTRY)
            out["token"], out["node"], out["n"] = part["token"], part["node"], part["n"]
            yield blocks_of(out, "token", buckets)

    dealt = written(map_batches(sets.select("node", "set"), deal_blocks, f"kind int, {_BLOCKS}"))
    counts = by_bucket(dealt.where("kind = 0").drop("kind"), _ENTRY, count, _BLOCKS)
    return by_bucket(counts.union(dealt.where("kind = 1").drop("kind")), _SHARED, choose, _BLOCKS)


def coarse_edges(nodes: DataFrame, runs: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning pairs of what the bitmaps let link within runs."""
    members = runs.select(F.col("a").alias("run"), F.col("b").alias("node")).distinct()
    members = members.join(nodes.select("node", "n", "bitmap"), "node")
    grouped = members.groupBy("run").agg(F.collect_list(F.struct("node", "n", "bitmap")).alias("x"))  # MOST_RUN nodes at most

    def chain(batch):
        a, b = [], []
        x = batch.column(0)
        flat = x.flatten()
        ids, sizes = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        maps = flat.field(2)
        ends = np.concatenate([[0], np.cumsum(np.array([len(v) for v in x], np.int64))])
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            join = Join(sizes[s:e], [np.frombuffer(v.as_buffer(), np.uint64) for v in maps[s:e]], percent)
            for i, j in join.links(None):
                a.append(ids[s + i])
                b.append(ids[s + j])
        return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}

    return map_batches(grouped.select("x"), chain, "a long, b long").distinct()


def coarse_groups(docs: DataFrame, nodes: DataFrame, listed, k: int, percent: int) -> DataFrame:
    """node, component: any two nodes that link are in one."""
    held = nodes.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0)) / 8, F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = shuffle_partitions(docs.sparkSession)
    runs = written(candidate_runs(prefix_entries(nodes, max(16 * parts, int(held[0]) // BUCKET_ENTRIES + 1)), percent))
    edges = coarse_edges(nodes, runs.where("kind = 0"), percent)
    crowd = written(runs.where("kind = 1").select(F.col("b").alias("node")).union(nodes.where("crowded").select("node")).distinct())
    if not crowd.isEmpty():
        sets = written(sets_of(docs, nodes.join(crowd, "node", "left_semi"), k))  # ends a stage, so that no task has two Python workers
        again = written(candidate_runs(crowded_entries(sets, listed, max(16 * parts, int(held[1]) // BUCKET_ENTRIES + 1), percent), percent))
        edges = edges.union(coarse_edges(nodes, again.where("kind = 0"), percent)).union(again.where("kind = 1").select("a", "b")).distinct()
    return components(edges)


def sized_nodes(coarse: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, component, blocks (into how many tiles' worth of nodes its group is cut), apart (one node in so many is a pivot)."""
    sized = coarse.join(nodes.select("node", "n"), "node")
    groups = sized.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / TILE_NODES), F.ceil(F.col("total") / TILE_SHINGLES)).cast("long")
    apart = F.greatest(F.col("m").cast("double") / PIVOTS, F.lit(1.0)).cast("long")
    return sized.join(written(groups.select("component", blocks.alias("blocks"), apart.alias("apart"))), "component")


def _bands(percent: int):
    """The tiles by size that a node is in: its own band with the next, and the band before with its own."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9))
    return F.explode(F.array(band, band - 1)).alias("band")


def _all(n):
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


_TILE = ["component", "band", "i", "j", "node", "label"]


def first_tiles(sized: DataFrame, percent: int) -> DataFrame:
    """Small groups whole; of large ones each block with itself and with the group's pivots."""
    zero, own = F.lit(0).cast("long"), F.pmod(F.xxhash64("node"), F.col("blocks"))
    small = sized.where("blocks = 1").select("component", F.lit(None).cast("long").alias("band"), zero.alias("i"), zero.alias("j"), "node")
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("apart")) == 0
    where = F.when(pivot, _all("blocks")).otherwise(F.array(own))
    large = sized.where("blocks > 1").select("component", "node", "n", F.explode(where).alias("i")).select("component", _bands(percent), "i", F.col("i").alias("j"), "node")
    return small.union(large).withColumn("label", F.col("node")).select(_TILE)


def second_tiles(labelled: DataFrame, percent: int) -> DataFrame:
    """Of groups (component, node, n, label, blocks) of more than one part: every node outside the largest part with every node of the group."""
    parts = labelled.groupBy("component", "label").agg(F.count("*").alias("m"))
    main = parts.groupBy("component").agg(F.max_by("label", F.struct("m", "label")).alias("main"), (F.sum("m") - F.max("m")).alias("tail")).where("tail > 0")
    open_ = labelled.join(written(main.select("component", "main", F.ceil(F.col("tail") / TILE_NODES).cast("long").alias("tails"))), "component")
    hash_ = F.xxhash64("node")
    as_any = open_.select("component", "node", "n", "label", F.explode(_all("tails")).alias("i"), F.pmod(hash_, F.col("blocks")).alias("j"))
    as_tail = open_.where("label <> main").select("component", "node", "n", "label", F.pmod(hash_, F.col("tails")).alias("i"), F.explode(_all("blocks")).alias("j"))
    return as_any.union(as_tail).select("component", _bands(percent), "i", "j", "node", "label").select(_TILE).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and sorted shingle array of the wanted nodes (node, doc_id, h1, h2)."""
    keys = wanted.select("node", F.col("doc_id").alias("own"), "h1", "h2")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.xxhash64("own").alias("key"))))

    def load(batch):
        keep = pa.array(np.flatnonzero(set_bits(batch.column(2).to_numpy(), shared.value)))
        ids, text = batch.column(0).take(keep), batch.column(1).take(keep)
        for a, z, sets in batch_sets(text, k):
            h = [set_hashes(x) for x in sets]
            yield {"doc_id": ids.slice(a, z - a), "h1": pa.array([x[0] for x in h], pa.int64()), "h2": pa.array([x[1] for x in h], pa.int64()), "set": pa.array([x.tobytes() for x in sets], pa.binary())}

    id_ = F.col("doc_id").cast("long")
    made = map_batches(docs.select(id_.alias("doc_id"), "text", F.xxhash64(id_).alias("key")), load, "doc_id long, h1 long, h2 long, set binary")
    return made.join(keys, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("own"))).select("node", "set")


def possible(nodes: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Labels a, b of parts that the bitmaps let link in a tile."""

    def test(table: pa.Table) -> pa.Table:
        labels = table.column("label").to_numpy()
        maps = [np.frombuffer(x, np.uint64) for x in table.column("bitmap").to_pylist()]
        join = Join(table.column("n").to_numpy(), maps, percent)
        _, first, part = np.unique(labels, return_index=True, return_inverse=True)
        join.parent = first[part].tolist()
        found = list(join.links(None))
        return pa.table({"a": pa.array([labels[i] for i, _ in found], pa.int64()), "b": pa.array([labels[j] for _, j in found], pa.int64())})

    return placed.join(nodes.select("node", "n", "bitmap"), "node").groupBy("component", "band", "i", "j").applyInArrow(test, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links a, b that join two parts of a tile; nodes of one label are one part from the start."""
    loaded = sets_of(docs, nodes.join(placed.select("node").distinct(), "node", "left_semi"), k).join(placed, "node")

    def verify(table: pa.Table) -> pa.Table:
        ids, labels = table.column("node").to_numpy(), table.column("label").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()] if table.num_rows else []
        a, b = [], []
        if len(sets) > 1:
            join = Join(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], percent)
            _, first, part = np.unique(labels, return_index=True, return_inverse=True)
            join.parent = first[part].tolist()
            for i, j in join.links(sets):
                a.append(ids[i])
                b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return loaded.groupBy("component", "band", "i", "j").applyInArrow(verify, "a long, b long")


def exact_links(docs: DataFrame, coarse: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    sized = written(sized_nodes(coarse, nodes))
    links = written(verified(docs, nodes, written(first_tiles(sized, percent)), k, percent))
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return links
    labels = components(links).select("node", F.col("component").alias("label"))
    large = written(large.drop("apart").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    pairs = written(possible(nodes, second_tiles(large, percent), percent))
    if pairs.isEmpty():
        return links
    again = components(pairs).withColumnRenamed("node", "label")
    again = sized_nodes(large.drop("component", "blocks", "n").join(again, "label"), nodes)
    return links.union(verified(docs, nodes, written(second_tiles(written(again), percent)), k, percent))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, h1, h2, component_id, and of its group the doc_id and hashes (keep, k1, k2) of the row that stands for it."""
    listed = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))
    with temporary(docs.sparkSession) as keep:
        all_ = written(described(docs, listed, k, percent))
        rows = keep(written(all_.select("doc_id", "n", "h1", "h2")))
        full = all_.where("n > 0")
        reps = written(full.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")))
        nodes = written(full.join(reps.select("node"), full.row == reps.node).select("node", "doc_id", "h1", "h2", "n", "prefix", "crowded", "bitmap"))
        links = written(exact_links(docs, written(coarse_groups(docs, nodes, listed, k, percent)), nodes, k, percent))
        own = reps.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h1", "h2")).alias("first")
        groups = keep(written(own.join(own.groupBy("component").agg(first), "component").select("h1", "h2", "first")))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(groups, ["h1", "h2"], "left")
    id_ = F.when(F.col("n_shingles") > 0, F.col("first.rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "h1", "h2", id_.alias("component_id"), F.col("first.h1").alias("k1"), F.col("first.h2").alias("k2"))


def ngram_jaccard_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * overlap >= percent * union of their k-word shingles. Texts that are null,
    empty or without words have no shingles and link with nothing. Very long texts are read in slices and compared whole.
    Rows are linked by their sets: repeated rows are in one group; rows that share a doc_id but not the text are in the groups of
    their texts. component_id is the smallest doc_id of the group; rows with a null doc_id are linked like
    others, and a group of such rows only has a null component_id. There are no ties. Extra columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    return grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their group, with all their columns.

    That is the row with the group's smallest doc_id, nulls last; of rows with that doc_id and other texts of the group, the one
    whose set has the smaller hashes. Rows that repeat its doc_id and words are the same document, and stay.
    Rows without words stay. A row goes by its doc_id and its set, so that other texts with its doc_id stay.
    Very long texts, nulls, clashing names and empty tables as in ngram_jaccard_join.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))

    def keys(batch):
        h = [set_hashes(x) for _, _, sets in batch_sets(batch, k) for x in sets]
        return [x[0] for x in h], [x[1] for x in h]

    with temporary(docs.sparkSession) as keep:
        found = grouped(docs, k, percent).where("n_shingles > 0")
        gone = keep(written(found.where(~stays).select("doc_id", F.col("h1").alias("k1"), F.col("h2").alias("k2")).distinct()))
    return without(docs, gone, keys)
