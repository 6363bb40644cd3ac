import pytest
from pyspark.sql import functions as F

from marlstone.functions.vectors import LocalBackend, VectorBackend
from marlstone.operators import feedback, packing, rerank, scoring

COLUMNS = "id string, file_path string, name string, start_line int, content string, score double, rank int, seq long"


def ranked(spark, rows):
    return spark.createDataFrame([(i, f"/p/{i}.ts", n, 1, c, float(s), k, k) for k, (i, n, c, s) in enumerate(rows, 1)], COLUMNS)


def body(i):
    return f"function fn_{i}() {{\n  // line 2\n  return 42;\n}}"


def test_rerank_keywords_boost(spark):
    df = ranked(spark, [("a", "pay", "processPayment(card)", 0.6), ("b", "auth", "authenticate(token) token", 0.6)])
    assert [r["id"] for r in rerank.rerank(df, "authenticate token", 2).orderBy("rank").collect()] == ["b", "a"]


def test_rerank_similarity_dominates_and_weight_one(spark):
    df = ranked(spark, [("high", None, "nothing here", 0.95), ("low", None, "authenticate token", 0.1)])
    assert rerank.rerank(df, "authenticate token", 2).orderBy("rank").first()["id"] == "high"
    df = ranked(spark, [("a", None, "x", 0.9), ("b", None, "y", 0.7), ("c", None, "query", 0.5)])
    assert [r["id"] for r in rerank.rerank(df, "query", 3, 1.0).orderBy("rank").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("n,k,want", [(20, 5, 5), (2, 10, 2), (0, 5, 0)])
def test_rerank_top_k(spark, n, k, want):
    assert rerank.rerank(ranked(spark, [(str(i), None, "t", i / 30) for i in range(n)]), "t", k).count() == want


def test_bm25_against_formula(spark):
    docs = ["a b a", "b c", "", "a a a a"]
    df = ranked(spark, [(str(i), None, t, 0) for i, t in enumerate(docs)])
    got = {r["id"]: r["bm25"] for r in rerank.bm25_scores(df, "a b a").collect()}
    average = sum(len(t.split()) for t in docs) / len(docs)
    for i, t in enumerate(docs):
        w, want = t.split(), 0.0
        for q in "a b a".split():
            f = w.count(q)
            want += f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(w) / average)) if f else 0
        assert abs(got[str(i)] - want) < 1e-12


def test_temporal_and_structural(spark):
    now = 10 * scoring.MOST_AGE
    df = spark.createDataFrame([(now,), (0,), (None,), (now - scoring.MOST_AGE // 2,), (now + scoring.MOST_AGE,), (1,)], "t long")
    assert [round(r[0], 6) for r in df.select(scoring.temporal_score(F.col("t"), now)).collect()] == [1, 0, 0, 0.5, 2, 0]
    assert [r[0] for r in spark.range(6).select(scoring.structural_score(F.col("id"))).collect()] == [1.0, 0.8, 0.6, 0.4, 0, 0]


def test_scored_chunks_joins_signals(spark):
    chunks = spark.createDataFrame([("1", "/a", None, 1, "use the token", 1), ("2", "/b", None, 1, "zz", 2), ("3", "/c", None, 1, None, 3)], "id string, file_path string, name string, start_line int, content string, seq long")
    meta = spark.createDataFrame([("/a", 1000), ("/b", None)], "path string, git_updated_at long")
    log = spark.createDataFrame([("h", "1", "expand", 0)] * 9 + [("h", "2", "returned", 0)], "query_hash string, chunk_id string, action string, ts long")
    edges = spark.createDataFrame([("/b", "/a")], "from_file string, to_file string")
    got = {r["id"]: r["score"] for r in scoring.scored_chunks(chunks, "token", 1000, meta, log, edges, "/a").collect()}
    assert set(got) == {"1", "2"}
    sign = {r["id"]: r["s"] for r in chunks.where("id < 3").select("id", LocalBackend("token").similarity().alias("s")).collect()}
    assert abs(got["1"] - min(1, sign["1"] * 0.65 + 0.2 + 0.15 + 0.15)) < 1e-9
    assert abs(got["2"] - (sign["2"] * 0.65 + 0.8 * 0.2)) < 1e-9


def test_search_with_stored_vectors(spark):
    rows = [(str(i), "/a", None, 1, "text", [1.0, i / 10], i) for i in range(10)] + [("n", "/a", None, 1, "text", None, 10)]
    chunks = spark.createDataFrame(rows, "id string, file_path string, name string, start_line int, content string, embedding array<double>, seq long")
    got = scoring.search_context(chunks, "query", 0, 3, backend=VectorBackend([1.0, 0.0]))
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["0", "1", "2"]


def test_feedback(spark):
    log = feedback.returned_events(spark, "h", ["b"], 1)
    for _ in range(2):
        log = log.unionByName(feedback.expand_event(spark, "h", "a", 1))
    assert [tuple(r) for r in feedback.chunk_boosts(log).collect()] == [("a", 0.04)]
    assert [round(r[0], 2) for r in spark.range(7, 9).select(feedback.boost(F.col("id"))).collect()] == [0.14, 0.15]


def tiers(df):
    return {r["id"]: r["tier"] for r in df.collect()}


def test_tiers(spark):
    df = ranked(spark, [(i, None, body(i), s) for i, s in (("a", 0.9), ("b", 0.5), ("c", 0.2), ("d", 0.05))])
    packed = packing.compressed(df)
    assert tiers(packed) == {"a": "full", "b": "summary", "c": "stub", "d": "dropped"}
    assert packing.dropped_count(packed).first()["dropped"] == 1
    content = {r["id"]: r["content"] for r in packed.collect()}
    assert content["b"] == "function fn_b() {\n  // line 2\n  // … 4 lines  (chunk_id: b)"
    assert content["c"] == "function fn_c() {\n  // … (chunk_id: c)"
    half = ranked(spark, [("a", None, body("a"), 0.5)])
    assert tiers(packing.compressed(half, "thorough")) == {"a": "full"} and tiers(packing.compressed(half, "minimal")) == {"a": "stub"}


def test_exclude_and_budget(spark):
    df = ranked(spark, [(i, None, body(i), 0.9) for i in "abc"])
    assert tiers(packing.compressed(df, exclude=["b"])) == {"a": "full", "c": "full"}
    many = ranked(spark, [(f"x{i}", None, body(i), 0.9) for i in range(10)])
    assert set(tiers(packing.compressed(many, token_budget=50)).values()) == {"dropped"}
    assert set(tiers(packing.compressed(df, token_budget=10_000)).values()) == {"full"}
    mixed = ranked(spark, [("big", None, "x" * 5000, 0.9), ("small", None, "y", 0.1)])
    assert tiers(packing.compressed(mixed, token_budget=80)) == {"big": "dropped", "small": "full"}


def test_render(spark):
    df = ranked(spark, [("a", "fa", body("a"), 0.9), ("b", None, body("b"), 0.5), ("c", None, body("c"), 0.2)])
    r = packing.rendered(packing.compressed(df, "thorough"), "task").first()
    text = r["context"]
    assert text.startswith("# Context: task\n\n## High\n\n### /p/a.ts:1 `fa`\n```\n") and text.index("## High") < text.index("## Medium") < text.index("## Low")
    assert "omitted" not in text and r["ids"] == ["a", "b", "c"]
    low = packing.rendered(packing.compressed(ranked(spark, [(i, None, "t", 0.05) for i in "abc"])), "t").first()
    assert "3 lower-scoring chunk(s) omitted" in low["context"]
