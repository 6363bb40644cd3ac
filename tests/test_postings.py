"""Postings: what they hold, and how little is moved to make them."""

import re
from collections import Counter

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import indexing, postings

CHUNKS = [("a", "Foo foo", "foo bar_1 BAR_1, x"), ("b", None, "z" + " z" * 3000), ("c", None, ""), ("d", "", "éİK k\n\tk_"), ("e", None, None), ("f", "only", None)]


def words(x):
    return re.findall("[a-z0-9_]+", (x or "").lower())


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_postings_are_counted_without_a_shuffle(spark):
    made = postings.postings(spark.createDataFrame(CHUNKS, "id string, name string, content string"), "id")
    assert made.schema.simpleString() == "struct<id:string,term:string,frequency:bigint>"
    rows = made.collect()
    want = {(i, t): n for i, name, content in CHUNKS for t, n in Counter(words(name) + words(content)).items()}
    assert {(r["id"], r["term"]): r["frequency"] for r in rows} == want and len(rows) == len(want)
    assert "Exchange" not in plan(made) and "Aggregate" not in plan(made)


def test_tokens_in_one_pass(spark):
    made = spark.createDataFrame(CHUNKS, "id string, name string, content string").select("content", text.bm25_tokens(F.col("content")).alias("t"))
    assert all(r["t"] == words(r["content"]) for r in made.collect())
    assert "regexp_replace" not in plan(made) and "lambdafunction" not in plan(made)


def test_repeated_keys_add_up(spark):
    terms = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 1)], "id string, term string, frequency long")
    lengths = spark.createDataFrame([("a", 4, 4), ("b", 4, 4)], "id string, tokens int, length int")
    got = {r["id"]: r["bm25"] for r in postings.bm25_scores(terms, lengths, "x y x").collect()}
    assert abs(got["a"] - (2 * 3 * 2.5 / 4.5 + 2.5 / 2.5)) < 1e-9 and got["b"] == 0


def test_chunks_are_shuffled_once_unless_ids_are_repeated(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    once = indexing.chunk_rows(files(("b.md", "# Y\nb"), ("a.md", "# X\na\n# Z\nc"), ("c.txt", "d")), 7, 10)
    rows = sorted(once.collect(), key=lambda r: r["seq"])
    assert [r["id"] for r in rows] == ["a.md::X", "a.md::Z", "b.md::Y", "c.txt::module"] and rows[0]["seq"] == 10
    assert all(len(r["embedding"]) == 256 and r["embedding"][0] == r["sign"] / 16 and r["updated_at"] == 7 for r in rows)
    assert "hashpartitioning" not in plan(once) and "rangepartitioning" in plan(once)
    twice = indexing.chunk_rows(files(("a.md", "# X\nfirst\n# X\nsecond"), ("a.md::x.md", "# y\nlast"), ("a.md", "# x.md::y\nother")), 7, 10)
    got = {r["id"]: r["content"] for r in twice.collect()}
    assert twice.count() == 2 and got == {"a.md::X": "# X\nsecond", "a.md::x.md::y": "# y\nlast"}
