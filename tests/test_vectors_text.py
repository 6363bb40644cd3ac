import hashlib
import math

from pyspark.sql import functions as F

from marlstone.functions import text, vectors


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")


def test_cosine_cases(spark):
    for a, b, want in (((1, 2, 3), (1, 2, 3), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((0, 0), (1, 1), 0), ((1, 2), (1, 2, 3), 0), ((), (), 0)):
        assert math.isclose(one(spark, vectors.cosine(arr(*a), arr(*b))), want, abs_tol=1e-12)


def test_json_round_trip(spark):
    for n in (0, 3, 1536):
        v = [i / 7 for i in range(n)]
        assert one(spark, vectors.from_json(vectors.to_json(arr(*v)))) == v


def literal_embedding(t):
    """The hashed projection step by step: term hash, one generator step a dimension, sign by the low bit."""
    import re

    counts = {}
    for tok in re.sub("[^a-z0-9]", " ", t[:4096].lower()).split():
        if 2 <= len(tok) <= 40:
            counts[tok] = counts.get(tok, 0) + 1
    total = sum(n * (1 if sum(ord(c) & 1 for c in w) % 2 else -1) for w, n in counts.items())
    sign = (total > 0) - (total < 0)
    return [sign * (0.0625 if d % 2 == 0 else -0.0625) for d in range(256)]


def test_local_embedding(spark):
    for t in ("getUserName fetches a user", "", "a b c", "zz xx", "Token token TOKEN auth" * 500):
        assert one(spark, vectors.local_embedding(F.lit(t))) == literal_embedding(t)


def test_tokens(spark):
    assert one(spark, text.embed_tokens(F.lit("getUserName a foo_bar x1, " + "y" * 41))) == ["getusername", "foo", "bar", "x1"]
    assert one(spark, text.bm25_tokens(F.lit("Foo_bar a, b!"))) == ["foo_bar", "a", "b"]
    assert one(spark, text.bm25_tokens(F.lit(None).cast("string"))) == []


def test_query_hash_and_path(spark):
    assert one(spark, text.query_hash(F.lit("abc"))) == hashlib.sha256(b"abc").hexdigest()[:16]
    for q, want in (("fix src/a.ts now", "src/a.ts"), ("foo.tsx", "foo.ts"), ("see a.json", "a.js"), ("nothing", None)):
        assert one(spark, text.mentioned_path(F.lit(q))) == want


def test_embed_text_and_estimate(spark):
    assert one(spark, text.embed_text(F.lit(None).cast("string"), F.lit("module"), F.lit("x" * 600))) == "module " + "x" * 512
    assert one(spark, text.token_estimate(F.lit("abcde"))) == 2


def test_client_embeddings(spark):
    df = spark.createDataFrame([("abc",), (None,), ("x" * 9000,)], "t string")
    embed = vectors.embedded_by(lambda texts: [[float(len(t)), 1.0] if t != "abc" else None for t in texts], batch=1)
    assert [r["v"] for r in df.select(embed("t").alias("v")).collect()] == [None, None, [8192.0, 1.0]]
    assert vectors.backend_name(None, True) == "hosted" and vectors.backend_name(None, False) == "local" and vectors.backend_name("local", True) == "local"
