import hashlib
import random

import numpy as np
import pytest

from marlstone.llm import fingerprints, spiece


def plain_rarity(b):
    """Distance from the usual, window by window."""
    out = []
    for t in range(len(b) - fingerprints.WINDOW + 1):
        counts = np.bincount(b[t : t + fingerprints.WINDOW])
        total = sum(int(fingerprints._GROWTH[1 : c + 1].sum()) for c in counts)
        out.append(-1 if total > fingerprints._MOST else abs(total - fingerprints._USUAL))
    return out


M64 = 2**64 - 1


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_digest(text):
    """Features by filter, and the filters as sets of bits, in plain loops."""
    raw = text.encode()
    if not raw:
        return []
    w, span = fingerprints.WINDOW, fingerprints.SPAN
    windows = [raw[i : i + w] for i in range(len(raw) - w + 1)] or [raw + bytes(w - len(raw))]
    far = plain_rarity(np.frombuffer(raw, np.uint8)) if len(raw) >= w else [0]
    votes = [0] * len(windows)
    for s in range(1 - span, len(windows)):
        votes[min(range(max(s, 0), min(s + span, len(windows))), key=lambda i: (-far[i], i))] += 1
    hashes = []
    for i, v in enumerate(votes):
        if v >= fingerprints.VOTES:
            words = [int.from_bytes(windows[i][k : k + 8], "little") for k in range(0, w, 8)]
            hashes.append(plain_mix(sum(plain_mix(x) * (plain_mix((k + 1) * 0x9E3779B97F4A7C15 & M64) | 1) for k, x in enumerate(words)) & M64))
    filters = [hashes[i : i + fingerprints.PER_FILTER] for i in range(0, len(hashes), fingerprints.PER_FILTER)]
    return [(len(f), {(h >> 11 * i) % fingerprints.BITS for h in f for i in range(fingerprints.HASHES)}) for f in filters]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = sorted((a, b), key=lambda d: (sum(c for c, _ in d), len(d)))
    total = 0.0
    for c, x in a:
        scores = []
        for _, y in b:
            most, chance = min(len(x), len(y)), len(x) * len(y) / fingerprints.BITS
            scores.append(min(1.0, max(0.0, (len(x & y) - chance) / (most - chance) if most > chance else float(len(x & y) == most))))
        total += c * max(scores)
    return min(1.0, total / sum(c for c, _ in a))


def test_rarity():
    rng = np.random.default_rng(1)
    for n in (16, 17, 32, 33, 300):
        b = rng.choice(np.frombuffer(b"abcdefgh  ", np.uint8), n)
        assert fingerprints.rarity(b).tolist() == plain_rarity(b)


@pytest.mark.parametrize("piece", [1 << 20, 100])
def test_digests_against_plain_loops(monkeypatch, piece):
    """Whole digests and likenesses by an independent version; long texts piece by piece."""
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    rng = random.Random(7)
    texts = ["", "x", "a" * 15, "b" * 16, "c" * 500, "\n" * 40, "é日本 " * 30, "0123456789abcdef"]
    texts += ["".join(rng.choice("abcdefghij klmnop.é") for _ in range(rng.choice([10, 31, 50, 94, 95, 300, 3000]))) for _ in range(25)]
    own, want = fingerprints.digest_texts(texts), [plain_digest(t) for t in texts]
    for t, d, w in zip(texts, own, want, strict=True):
        alone = fingerprints.digest_texts([t])[0]
        for got in (d, alone):
            assert got[0].tolist() == [c for c, _ in w], t
            assert [set(np.flatnonzero(np.unpackbits(f.view(np.uint8), bitorder="little")).tolist()) for f in got[1]] == [bits for _, bits in w]
    for _ in range(300):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert abs(fingerprints.likeness(own[i], own[j]) - plain_likeness(want[i], want[j])) < 1e-12


def test_equal_texts_wherever_they_stand_and_likeness():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.choice([0, 5, 40, 200, 6000]))) for _ in range(60)]
    alone = [fingerprints.text_of(fingerprints.digest_texts([t])[0]) for t in texts]
    assert [fingerprints.text_of(d) for d in fingerprints.digest_texts(texts)] == alone
    d = fingerprints.digest_texts(texts)
    for i, t in enumerate(texts):
        assert fingerprints.likeness(d[i], d[i]) == 1.0
        p = fingerprints.parsed(alone[i])
        assert p[0].tolist() == d[i][0].tolist() and (p[1] == d[i][1]).all()
        j = rng.randrange(60)
        s = fingerprints.likeness(d[i], d[j])
        assert 0 <= s <= 1 and s == fingerprints.likeness(d[j], d[i])
    a, b = fingerprints.digest_texts(["a" * 5000, "b" * 5000])
    assert fingerprints.likeness(a, b) < 0.5


def test_neighbours_against_plain(spark):
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choice("abcdefghij é\n") for _ in range(rng.choice([0, 3, 30, 700])))) for i in range(120)] + [(500, None), (501, "z" * 150_000), (502, "no")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in fingerprints.neighbour_likeness(df).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        f, g, h = fingerprints.digest_texts([t, e, n])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.text_of(f), fingerprints.text_of(g))
        assert r["near_edited"] == fingerprints.likeness(f, g) and r["near_next"] == fingerprints.likeness(f, h)


@pytest.mark.parametrize("ids", [[7], [7, 7], [None, None], [None, 3, 3, 3, 9], []])
def test_neighbours_of_few_and_repeated_rows(spark, ids):
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = fingerprints.neighbour_likeness(df).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i in ids)


def test_fingerprints_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "some text that is long enough to have a window")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert got[1] == got[2] == "" and len(got[3]) == 514  # one filter


@pytest.fixture(scope="module")
def coder():
    return spiece.Encoder(spiece.Pieces(spiece.default_model()))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=spiece.default_model())


ODD = ["Hello  world", " a\tb\n c", "", "ﬁ ½ é 日本́ \x00", "a▁b", "<s> <0x41>", "   ", "\u3000x", "a\ufffdb", "😀😀 x" * 5, " " * 37 + "the" + " " * 50 + "日 " * 4, "aaaa" * 50, "x" * 3000, "=====----____ 10000000", "    def f(x):\n        return x\n" * 3]


def encode(coder, texts):
    ids, counts = coder.encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:], strict=True)]


def test_ids_against_the_library(coder, library):
    docs = __import__("pyarrow.parquet").parquet.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()[:300]
    rng = random.Random(1)
    noise = ["".join(rng.choice("aé日▁ \n\tZ0-1😀ß th") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for texts in (ODD, docs, noise):
        got = encode(coder, texts)
        assert got == library.encode(texts)
        for ids, t in zip(got, texts, strict=True):
            assert spiece.decode(coder.p, ids) == t.replace("▁", " ")


@pytest.mark.parametrize("size", [3, 20, 200])
def test_long_texts_in_pieces(coder, library, monkeypatch, size):
    monkeypatch.setattr(spiece, "SLICE", size)
    rng = random.Random(size)
    texts = ["".join(rng.choice("aé日 th \n▁") for _ in range(rng.randrange(0, 400))) for _ in range(40)] + ["   " * 30, "x" * 300 + "    y", " lead", "trail   "]
    for t in texts:
        parts = list(coder.encode_long(t))
        assert "".join(p for _, p in parts) == t
        assert [i for ids, _ in parts for i in ids.tolist()] == library.encode(t), t


def test_forgetting_words(coder, library, monkeypatch):
    monkeypatch.setattr(spiece, "MOST_KNOWN", 10)
    monkeypatch.setattr(spiece, "MOST_CHARS", 40)
    for texts in (["one two three four five six seven eight nine ten eleven twelve"], ["one more"], ["", ""]):
        assert encode(coder, texts) == library.encode(texts)


def test_encoded_and_decoded(spark, library):
    long = "many different words0 like1 this2 " * 60_000
    both = spiece.encoded(spark.createDataFrame([(1, long), (2, long + "▁"), (3, "short")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["ids"] == library.encode({1: long, 2: long + "▁", 3: "short"}[r["doc_id"]]), r["round_trip"]) for r in both} == {1: (True, True), 2: (True, False), 3: (True, True)}
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "x"), (3, "again"), (3, "again"), (100, "long words " * 20_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = spiece.encoded(df).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got) == sorted((i if i is not None else -1, library.encode(t or "")) for i, t in rows)
    assert all(r["n_tokens"] == len(r["ids"]) and (r["round_trip"] or r["doc_id"] == 4) for r in got)
    back = {r["doc_id"]: r["text"] for r in spiece.decoded(spiece.encoded(df.where("doc_id < 3"))).collect()}
    assert back == {0: ODD[0], 1: ODD[1], 2: ODD[2]}
    assert spiece.encoded(df.limit(0)).count() == 0
