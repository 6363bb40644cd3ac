import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import common, run_detection, substring_dedup

DOCS = "doc_id long, text string, runs string, n_words long, kept_text string, removed string, anchor long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", -1, "clash", None, 7) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(w, fewest, exponent):
    """By definition: maximal stretches for each period, smallest period only."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(fewest, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def tangled(rng, n, letters):
    """Words with runs inside copies of runs."""
    w = []
    while len(w) < n:
        kind = rng.random()
        if kind < 0.4 or not w:
            w += [rng.choice(letters) for _ in range(rng.randint(1, 6))]
        elif kind < 0.7:
            block = [rng.choice(letters) for _ in range(rng.randint(1, 5))]
            w += (block * rng.randint(2, 9))[: rng.randint(2, 40)]
        else:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 60)]
    return w[:n]


@pytest.mark.parametrize("wide", [run_detection.WIDE, 4])
@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijk"])
def test_all_runs_of_many_texts_at_once(monkeypatch, letters, wide):
    monkeypatch.setattr(run_detection, "WIDE", wide)
    monkeypatch.setattr(run_detection, "FEW", 0 if wide == 4 else 32)
    rng = random.Random(f"{letters}{wide}")
    for fewest, exponent in ((2, 2), (6, 4), (3, 3)):
        for _ in range(25):
            texts = [tangled(rng, rng.randint(0, 150), letters) for _ in range(rng.randint(1, 4))]
            flat = np.array([ord(x) for t in texts for x in t], np.uint64)
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            want, at = [], 0
            for t in texts:
                want += [(s + at, e + at, q) for s, e, q in plain_runs(t, fewest, exponent)]
                at += len(t)
            assert [tuple(x) for x in run_detection.runs_of(flat, row, fewest, exponent).tolist()] == want


def test_arrays_by_definition():
    rng = random.Random(5)
    for _ in range(40):
        t = tangled(rng, rng.randint(1, 120), "ab")
        s = np.array([ord(x) for x in t], np.uint64)
        sa = run_detection.suffix_array(s)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        common = lambda i, j: next((k for k in range(len(t) - max(i, j)) if t[i + k] != t[j + k]), len(t) - max(i, j))
        lcp = run_detection.lcp_array(np.append(s.astype(np.int64), -1), sa)
        assert lcp.tolist() == [0] + [common(int(a), int(b)) for a, b in zip(sa[:-1], sa[1:])]
        length, source = run_detection.previous_factors(sa, lcp)
        assert length.tolist() == [max([0, *(common(i, j) for j in range(i))]) for i in range(len(t))]
        assert all(not n or (0 <= j < i and common(i, j) >= n) for i, (n, j) in enumerate(zip(length.tolist(), source.tolist())))


def plain_digest(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = [(s, e - s, q) for s, e, q in plain_runs(w, 6, 4)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(" ".join(kept)))


def test_digests_of_texts_against_definition(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(tangled(rng, rng.randint(0, 90), ["ä", "bé", "c", "Ca b", "dd"]))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "x " * 9), (203, "a b " * 30), (203, "a b " * 30), (204, "a b " * 30), (205, "z " * 5), (206, "z " * 6)]
    got = [tuple(r) for r in run_detection.run_digests(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(i, t) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120)) > 5


def test_runs_and_collapsed_text_of_the_operator(spark):
    rows = frame(spark, [(1, "x a b a b a b a b y"), (2, "q q q"), (3, None)])
    got = {r["doc_id"]: r for r in run_detection.with_runs(rows).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 8, 2)] and got[1]["collapsed_text"] == "x a b y"
    assert got[2]["runs"] == [] and got[2]["collapsed_text"] == "q q q" and got[3]["collapsed_text"] == ""
    assert run_detection.with_runs(rows.where("false")).count() == 0
    all_runs = run_detection.with_runs(rows, 2, 2).where("doc_id = 2").first()["runs"]
    assert [tuple(x) for x in all_runs] == [(0, 3, 1)]


def test_a_long_periodic_text(spark):
    text = " ".join(["u"] + ["a", "b", "c"] * 200_000 + ["v"])
    r = run_detection.with_runs(spark.range(1).select(F.lit(7).alias("doc_id"), F.lit(text).alias("text"))).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 600_000, 3)] and r["collapsed_text"] == "u a b c v"


def plain_repeats(rows, n):
    """Each window of n words, wherever it starts, in a dictionary."""
    texts, seen = [words(t) for _, t in rows], {}
    for w in texts:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {k for a in range(len(w) - n + 1) if seen[tuple(w[a : a + n])] > 1 for k in range(a, a + n)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def shared_corpus(seed, n, size):
    """Copies, near copies, passages within other words, passages that differ in a word, loops."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(size // 2, 3 * size))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 2 * size))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = word()
            a = rng.randint(0, len(p) - 1)
            w += p[a:] if rng.random() < 0.3 else p
            w += [word() for _ in range(rng.randint(0, size))]
        if rng.random() < 0.1:
            w += [word(), word()] * size
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
        if rng.random() < 0.2:
            rows.append((rng.randint(0, i), rows[-1][1]))
    return rows


def digests(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def with_words(docs, n):
    found = substring_dedup.without_repeats(docs, n)
    return found.select("doc_id", "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda x, s: x + s.z - s.a).alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@pytest.mark.parametrize(("n", "kinds", "slice_bytes", "shard"), [(35, 256, 1 << 17, 50_000), (12, 2, 1 << 17, 300), (5, 1, 200, 50), (9, 1, 64, 1)])
def test_repeats_against_a_dictionary_of_windows(spark, monkeypatch, n, kinds, slice_bytes, shard):
    monkeypatch.setattr(substring_dedup, "MOST_KINDS", kinds)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = shared_corpus(n, 90, n)
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[3][1]), (None, rows[3][1] + " x"), (903, "q " * (n - 1)), (904, "r " * n), (905, "s " * (n + 1))]
    assert digests(with_words(frame(spark, rows), n)) == plain_repeats(rows, n)
    for piece in (slice_bytes,):  # slices of any size give the same windows
        buf, offsets = common.text_buffer(substring_dedup.pa.array([t for _, t in rows], substring_dedup.pa.string()))
        monkeypatch.setattr(substring_dedup, "word_slices", lambda b, o, most=piece: common.word_slices(b, o, most=most))
        count = {}
        for row, first, windows, lead, *_ in substring_dedup.pieces_of(buf, offsets, n):
            assert (lead >= windows - 1).all() and (lead <= n - 1).all()
            for r, f, k in zip(row.tolist(), first.tolist(), windows.tolist()):
                for i in range(f, f + k):
                    count[r, i] = count.get((r, i), 0) + 1
        assert count == {(r, i): 1 for r, (_, t) in enumerate(rows) for i in range(len(words(t)) - n + 1)}


def test_columns_and_spans_of_the_operator(spark):
    p = " ".join(f"w{i}" for i in range(6))
    got = substring_dedup.without_repeats(frame(spark, [(1, f"a {p} b"), (2, f"c  {p}"), (3, "d e f g")]), 4)
    assert set(got.columns) == {"doc_id", "text", "runs", "n_words", "kept_text", "removed", "anchor"} and got.first()["runs"] == "clash"
    by = {r["doc_id"]: r for r in got.collect()}
    assert [tuple(x) for x in by[1]["removed"]] == [(1, 7)] and by[1]["kept_text"] == "a b" and by[2]["kept_text"] == "c" and by[3]["removed"] == []
    assert substring_dedup.without_repeats(frame(spark, []), 4).count() == 0


def test_query_against_a_dictionary_of_windows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert digests(substring_dedup.repeat_digests(docs)) == plain_repeats(rows, 35)


def test_automaton_counts_places():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice("ab") for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 4))]
        times = [rng.randint(1, 3) for _ in texts]
        a = substring_dedup.SuffixAutomaton()
        for t, k in zip(texts, times):
            a.add(t, k)
        a.count()
        for t in texts:
            n = rng.randint(1, 6)
            for end, (length, places) in enumerate(a.matches(t, n), 1):
                assert length == min(n, end)
                part = t[end - length : end]
                assert places == sum(k * sum(x[i : i + length] == part for i in range(len(x))) for x, k in zip(texts, times))
