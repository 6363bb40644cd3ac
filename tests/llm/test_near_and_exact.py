import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import common, exact_dedup, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, size long, group_size long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "clash", -1, -2, -3) for i, t in rows], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.randint(1, 150))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if i % 3 else [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = word()
        if i % 5 == 0:
            w += passage
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_join_in_small_runs_and_tiles(spark, monkeypatch):
    """Long runs are chained and large groups cut into bands and blocks: the result stays the same."""
    for name, value in (("MOST_RUN", 3), ("TILE_NODES", 4), ("PIVOTS", 2), ("TILE_SHINGLES", 300), ("HOT_LOCAL", 2), ("HOT_TOTAL", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(3) + [(1000 + i, " ".join(f"w{j if j != i and j != 100 - i else 'x'}" for j in range(60 + i % 3))) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_runs_of_a_task():
    """A shingle of more than most_run nodes gives all of them out, however the blocks fall; shorter runs end at gaps of sizes."""
    entries = lambda t, nodes, sizes: np.array([(t, i, n) for i, n in zip(nodes, sizes)], ngram_join._ENTRY)
    blocks = [entries(7, range(300), [100] * 300), entries(8, [1, 2], [100, 110]), entries(7, range(300, 310), [130] * 10), entries(9, [400, 401, 402, 403], [5000, 5001, 9000, 9001]), entries(8, [3], [500])]
    for held in (5, 250, 10_000):
        runs, far = [], set()
        for kind, a, b in ngram_join.runs_in(blocks, 80, 256, held):
            if kind:
                far |= set(b.tolist())
                assert len(set(a.tolist())) == 1
            else:
                runs += [sorted(b[a == r].tolist()) for r in np.unique(a)]
        assert sorted(runs) == [[1, 2], [400, 401], [402, 403]] and far == set(range(310))


def boilerplate(n):
    """Texts of two or three of six passages and words of their own: no two link."""
    rng = random.Random(12)
    passages = [[f"p{k}x{j}" for j in range(40)] for k in range(6)]
    rows = []
    for i in range(n):
        w = [x for p in rng.sample(passages, rng.choice([2, 3])) for x in p] + [f"own{i}w{j}" for j in range(60)]
        rows.append((i, " ".join(w)))
    return rows


def test_boilerplate_makes_no_groups(spark, monkeypatch):
    """Documents that share only passages are dealt together by none of them, though the list of frequent shingles is exhausted."""
    monkeypatch.setattr(ngram_join, "HOT_LIST", 20)
    docs = frame(spark, boilerplate(6000))
    listed = spark.sparkContext.broadcast(ngram_join.frequent(docs, 5))
    assert len(listed.value[0]) == 20
    all_ = common.written(ngram_join.described(docs, listed, 5, 80))
    nodes = all_.select(F.col("row").alias("node"), "doc_id", "h1", "h2", "n", "prefix", "crowded", "bitmap")
    assert ngram_join.candidate_runs(ngram_join.prefix_entries(nodes, 8), 80).where("kind = 1").count() > 1000
    assert ngram_join.coarse_groups(docs, nodes, listed, 5, 80).groupBy("component").count().where("count > 512").count() == 0
    again = ngram_join.candidate_runs(ngram_join.crowded_entries(ngram_join.sets_of(docs, nodes, 5), listed, 8, 80), 80)
    assert again.count() == 0


@pytest.mark.parametrize("listed", [0, 20])
def test_join_of_boilerplate_and_copies(spark, monkeypatch, listed):
    for name, value in (("MOST_RUN", 8), ("HOT_LIST", listed), ("TILE_NODES", 16), ("PIVOTS", 2), ("HOT_LOCAL", 2), ("HOT_TOTAL", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(13)
    rows = boilerplate(60) + boilerplate(20)
    for i in range(80):  # mostly passages: some link, others are alike by less
        w = [x for k in range(3) for x in [f"q{(i + k) % 4}x{j}" for j in range(40)]]
        rows.append((i, " ".join(w[: rng.choice([120, 110, 90])]) + f" own{i}" * 2))
    for i in range(60):
        rows.append((i, " ".join(f"z{j}" if rng.random() > 0.03 else f"c{i}" for j in range(120))))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_join_with_few_entries_held(spark, monkeypatch):
    for name, value in (("MOST_RUN", 3), ("HELD_ENTRIES", 20), ("HOT_LOCAL", 2), ("HOT_TOTAL", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == brute(rows)


EDGES = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "a b c d"), (11, "a b c d"), (12, "x" * 100_000), (13, "w " * 20_000), (14, "w " * 19_000), (15, "É b c d e f"), (16, "é b c d e f")]


def test_join_edge_cases(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(spark, EDGES)).collect()}
    assert got == brute(EDGES)
    again = ngram_join.ngram_jaccard_join(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]))
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in again.collect()) == [(-1, 1), (1, 1), (1, 1), (2, 1)]
    assert ngram_join.ngram_jaccard_join(frame(spark, [])).count() == 0


def test_one_of_each_keeps_columns(spark):
    df = frame(spark, [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other words are here now"), (None, None)])
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2]
    odd = spark.createDataFrame([(1, "x y", 5, 6, 7, 8), (2, "x y", 5, 6, 7, 8)], "doc_id long, text string, k10 long, K2 long, maybe0 long, own0 long")
    assert [tuple(r) for r in ngram_join.one_of_each(odd).collect()] == [(1, "x y", 5, 6, 7, 8)] and ngram_join.one_of_each(odd.limit(0)).count() == 0


def test_one_of_each_loses_no_text(spark):
    """A row goes by its doc_id and its text; rows without a doc_id are linked like others."""
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(2, a), (1, a), (2, b), (None, b), (None, a), (3, "z y x w v u t"), (3, "z y x w v u t"), (None, "k l m n o p"), (None, "k l m n o p")]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in ngram_join.one_of_each(frame(spark, rows)).collect())
    assert got == [(-1, "k l m n o p")] * 2 + [(1, a), (2, b)] + [(3, "z y x w v u t")] * 2


def test_words_and_slices():
    text = " ab\tcé\x0bd  " + "z" * 5000
    buf = np.frombuffer(text.encode(), np.uint8)
    h, starts, ends, counts = common.word_hashes(buf, np.array([0, len(buf)]))
    assert [buf[a:z].tobytes().decode() for a, z in zip(starts, ends)] == re.findall(r"[^\x20\x09-\x0D]+", text) and counts.tolist() == [4]
    both = np.concatenate([buf, buf])
    h2, *_, c2 = common.word_hashes(both, np.array([0, len(buf), 2 * len(buf)]))
    assert c2.tolist() == [4, 4] and h2.tolist() == h.tolist() * 2
    assert list(common.row_slices(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(common.row_slices(np.array([0]), 10)) == []


def test_words_by_slices():
    """Rows and words that go on over slices have the hashes and places that they have in one."""
    rng = random.Random(8)
    texts = ["", "x" * 9000, " ", "é" * 5000 + " end"] + ["".join(rng.choice("ab\t É") for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["", "last"]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    whole = list(common.word_slices(buf, offsets, common.LOWER, 1 << 20))
    assert len(whole) == 1
    cut = [buf[a:z].tobytes().decode() for a, z in zip(whole[0][2], whole[0][3])]
    assert cut == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    for most in (1, 7, 100, 4097):
        parts = list(common.word_slices(buf, offsets, common.LOWER, most))
        assert [np.concatenate(x).tolist() for x in zip(*parts)] == [x.tolist() for x in whole[0]]
    import pyarrow as pa

    counts = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    for most in (7, 100, 1 << 20):
        common.SLICE_BYTES, was = most, common.SLICE_BYTES
        try:
            assert common.count_words(pa.array(texts)).tolist() == counts
        finally:
            common.SLICE_BYTES = was


def test_long_sets():
    for text in ("a b c d e f " * 30_000 + "z", "one word", "w" * 200_000, "", " ".join(str(i) for i in range(70_000))):
        buf = np.frombuffer(text.encode(), np.uint8)
        assert ngram_join.long_set(buf, 5).tolist() == ngram_join.shingle_sets(buf, np.array([0, len(buf)]))[0].tolist()
    x = np.unique(np.random.default_rng(1).integers(0, 2**64, 400_000, np.uint64))
    odd = np.bincount(((x >> np.uint64(20)) & np.uint64((1 << 19) - 1)).astype(np.int64), minlength=1 << 19) & 1
    assert (np.unpackbits(ngram_join.bitmap(x).view(np.uint8), bitorder="little") == odd).all()


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1) if i != 150], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    left, right = order[:151], order[151:]
    assert got == {x: min(left) for x in left} | {x: min(right) for x in right}


def test_exact_groups(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "ab "), (8, "x" * 300_000), (9, "X" * 300_000), (10, "y" * 300_000), (11, "p" * 300 + "q"), (12, "p" * 300 + "r")]
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    texts = {i: lower(t) for i, t in rows}
    for i, t in texts.items():
        same = [j for j, u in texts.items() if u == t]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())


def test_exact_repeats_nulls_and_empty(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")])
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    kept = exact_dedup.deduplicated(frame(spark, [(1, "A"), (2, "a"), (3, "b")]))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    assert exact_dedup.deduplicated(df.limit(0)).agg(F.count("*")).first()[0] == 0


def test_deduplicated_loses_no_text(spark):
    rows = [(1, "a"), (1, "z"), (2, "A"), (None, "a"), (None, "n"), (None, "N"), (3, ""), (4, None), (5, "y" * 300 + "1"), (6, "y" * 300 + "2"), (7, "rep"), (7, "rep")]
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in exact_dedup.deduplicated(frame(spark, rows)).collect())
    assert got == [(-1, "N"), (-1, "n"), (1, "z"), (2, "A"), (4, ""), (5, "y" * 300 + "1"), (6, "y" * 300 + "2"), (7, "rep"), (7, "rep")]


def test_exact_groups_shuffle_no_texts(spark, small):
    from marlstone.llm import queries

    p = queries.op8_exact_dedup(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("MapInArrow|documents", p)  # what is joined was written: numbers and digests
