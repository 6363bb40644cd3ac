"""The jobs: two runs over growing input, repeated batches, their SQL, and their command lines."""

import json
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import context_packs, queries, text_index
from marlstone.operators import rerank

ROOT = Path(__file__).resolve().parent.parent
SETTINGS = {"suffix": ".md", "files_per_batch": 1}


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").coalesce(1).write.mode("append").parquet(str(folder))


def words(text):
    return [x for x in re.sub("[^a-z0-9_]", " ", (text or "").lower()).split(" ") if x]


def expected(now):
    """Postings of the texts that hold now (doc_id, text)."""
    out = {}
    for i, text in now.items():
        lines = text.split("\n")
        heads = [k for k, line in enumerate(lines) if re.match(r"#{1,3}\s+.", line)]
        for a, z in zip(heads or [0], [*heads[1:], len(lines)] if heads else [len(lines)]):
            name = re.match(r"#{1,3}\s+(.+)", lines[a])[1] if heads else None
            for term, n in Counter(words(name) + words("\n".join(lines[a:z]))).items():
                out[f"{i}:{a + 1}", term] = n
    return out


def held(spark, out):
    _, terms = text_index.index(spark, out)
    rows = terms.collect()
    assert len({(r["chunk_id"], r["term"]) for r in rows}) == len(rows)
    return {(r["chunk_id"], r["term"]): r["frequency"] for r in rows}


def test_text_index_over_growing_input(spark, tmp_path):
    docs, out = tmp_path / "documents", str(tmp_path / "out")
    first = {i: f"Alpha beta_{i % 7} gamma " * (i % 5 + 1) for i in range(30)} | {100: "# One two\nalpha\n## Three\nbeta beta", 101: "", 102: "lost\n# Kept\nx"}
    arrive(spark, docs, [(i, t, f"s{i % 3}" if i % 4 else None, "x") for i, t in first.items()] + [(None, "no id", "s", "x"), (103, None, "s", "x"), (104, "short", "s", "x"), (104, "longer text", "s", "x")])
    done = text_index.run(spark, str(docs), out, SETTINGS)
    assert [(d["documents"], d["without_id"]) for d in done] == [(37, 1)]
    now = first | {103: "", 104: "longer text"}
    assert held(spark, out) == expected(now)
    kept = sorted(os.listdir(f"{out}/chunks"))

    assert text_index.run(spark, str(docs), out, SETTINGS) == []  # nothing is new
    arrive(spark, docs, [(5, "changed alpha", "s9", "y"), (200, "new words", None, "y")])
    arrive(spark, docs, [(201, "newer", "s1", "z")])
    done = text_index.run(spark, str(docs), out, SETTINGS)
    assert [d["batch"] for d in done] == [1, 2] and sorted(d["documents"] for d in done) == [1, 2]  # only what is new
    now |= {5: "changed alpha", 200: "new words", 201: "newer"}
    assert held(spark, out) == expected(now)
    assert set(kept) < set(os.listdir(f"{out}/chunks"))

    chunks, _ = text_index.index(spark, out)
    own = {r["doc_id"]: r for r in chunks.where("doc_id in (5, 200, 201)").collect()}
    assert (own[5]["source"], own[200]["source"], own[201]["tokens"]) == ("s9", None, 1)

    again = spark.read.parquet(str(docs)).where("doc_id = 201").select("doc_id", "text", "source")
    mark = own[201]["batch"]
    text_index.take(again, mark, out, SETTINGS)  # a batch that is repeated after a failure
    assert held(spark, out) == expected(now)

    chunks, _ = text_index.index(spark, out)
    found = text_index.search(spark, out, "changed alpha beta", 3).collect()
    want = rerank.bm25_scores(chunks.withColumnRenamed("chunk_id", "id"), "changed alpha beta").orderBy(F.desc("bm25"), "id").limit(3).collect()
    assert [(r["chunk_id"], round(r["bm25"], 9)) for r in sorted(found, key=lambda r: (-r["bm25"], r["chunk_id"]))] == [(r["id"], round(r["bm25"], 9)) for r in want]
    assert found[0]["content"]


@pytest.mark.parametrize("at", ["postings", "chunks"])
def test_text_index_after_a_failure(spark, tmp_path, monkeypatch, at):
    """A run that dies before or between the two outputs of a batch changes nothing, and is taken up by the next one."""
    docs, out, write = tmp_path / "documents", str(tmp_path / "out"), text_index._write
    first = {i: f"alpha beta_{i}" for i in range(8)}
    arrive(spark, docs, [(i, t, "s", "x") for i, t in first.items()])
    text_index.run(spark, str(docs), out, SETTINGS)
    arrive(spark, docs, [(3, "changed words", "s", "x"), (9, "new", "s", "x")])

    def dies(df, path, by):
        if path.endswith(at):
            raise RuntimeError("the cluster is gone")
        return write(df, path, by)

    monkeypatch.setattr(text_index, "_write", dies)
    with pytest.raises(Exception, match="the cluster is gone"):
        text_index.run(spark, str(docs), out, SETTINGS)
    assert held(spark, out) == expected(first)
    monkeypatch.setattr(text_index, "_write", write)
    done = text_index.run(spark, str(docs), out, SETTINGS)
    assert [(d["batch"], d["documents"]) for d in done] == [(1, 2)]
    assert held(spark, out) == expected(first | {3: "changed words", 9: "new"})
    assert text_index.run(spark, str(docs), out, SETTINGS) == []


def test_packs_of_no_texts(spark, tmp_path, small):
    for t in ("documents", "events", "conversations"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}")
    done = context_packs.run(spark, *(f"{tmp_path}/{t}" for t in ("documents", "events", "conversations")), str(tmp_path / "out"), queries.settings(context_packs))
    packs, reports = context_packs.output(spark, str(tmp_path / "out"))
    assert done["documents"] == 0 and packs.count() == 0 and "(none found for this topic)" in reports.where("task = 'brief'").first()["text"]


def test_empty_input(spark, tmp_path):
    docs, out = tmp_path / "documents", str(tmp_path / "out")
    arrive(spark, docs, [])
    done = text_index.run(spark, str(docs), out, SETTINGS)
    assert sum(d["documents"] for d in done) == 0


def test_a_search_reads_the_slots_of_its_terms(spark, tmp_path, small):
    out = str(tmp_path / "out")
    text_index.run(spark, f"{small}/documents.parquet", out, SETTINGS)
    terms = spark.read.schema(text_index.POSTINGS).parquet(f"{out}/postings")
    slots = {r["slot"] for r in terms.select("slot").distinct().collect()}
    assert slots <= set("0123456789abcdef") and len(slots) == 16
    plan = terms.where(F.col("slot").isin(["a"]) & F.col("term").isin(["the"]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*slot", plan) and re.search(r"PushedFilters: \[.*term", plan)


def inputs(spark, folder, small, n):
    for t in ("documents", "events", "conversations"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(n).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}")
    return [f"{folder}/{t}" for t in ("documents", "events", "conversations")]


def test_context_packs_again_and_over_more(spark, tmp_path, small):
    own, out = queries.settings(context_packs), str(tmp_path / "out")
    done = context_packs.run(spark, *inputs(spark, str(tmp_path / "in"), small, 50), out, own)
    assert done["documents"] == 50 and done["tasks"] == 3 and done["reports"] == 3

    def rows():
        return [sorted(tuple(r) for r in df.collect()) for df in context_packs.output(spark, out)]

    first = rows()
    assert sorted(os.listdir(f"{out}/packs"))[-3:] == ["task=brief", "task=handover", "task=review"]
    context_packs.run(spark, *(f"{tmp_path}/in/{t}" for t in ("documents", "events", "conversations")), out, own)
    assert rows() == first
    context_packs.run(spark, *inputs(spark, str(tmp_path / "in"), small, 120), out, own)
    assert rows() != first
    brief = {r["id"]: r for r in context_packs.output(spark, out)[0].where("task = 'brief'").collect()}
    assert sum(r["tokens"] for r in brief.values()) <= 3000
    with pytest.raises(ValueError):
        context_packs.run(spark, *(f"{tmp_path}/in/{t}" for t in ("documents", "events", "conversations")), out, own | {"tasks": own["tasks"] * 2})


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "events", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_command_lines(tmp_path, small):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"suffix": ".txt", "files_per_batch": 8}))
    call = lambda *x: subprocess.run([sys.executable, "-m", *x], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=True)
    said = call("jobs.text_index", "--documents", f"{small}/documents.parquet", "--out", str(tmp_path / "index"), "--config", str(config))
    assert json.loads(said.stdout.splitlines()[-1])[0]["documents"] == 200 and "read 200 documents" in said.stderr
    said = call("jobs.context_packs", *(y for t in ("documents", "events", "conversations") for y in (f"--{t}", f"{small}/{t}.parquet")), "--out", str(tmp_path / "packs"))
    assert json.loads(said.stdout.splitlines()[-1])["reports"] == 3 and "3 reports" in said.stderr


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_what_holds_is_read_without_shuffling_postings(spark, tmp_path, monkeypatch, most):
    """Also where joins are not broadcast by themselves; only documents that came again are compared, by a shuffle if they are many."""
    docs, out = tmp_path / "documents", str(tmp_path / "out")
    now = {i: f"alpha beta_{i} " * 3 for i in range(20)}
    arrive(spark, docs, [(i, t, "s", "x") for i, t in now.items()])
    text_index.run(spark, str(docs), out, SETTINGS)
    monkeypatch.setattr(text_index, "MOST_BROADCAST", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = lambda: [len(re.findall("SortMergeJoin|ShuffledHashJoin", df._jdf.queryExecution().executedPlan().toString())) for df in text_index.index(spark, out)]
        assert joins() == [0, 0] and held(spark, out) == expected(now)
        for more in ({3: "changed", 40: "new"}, {3: "changed again", 5: ""}):
            arrive(spark, docs, [(i, t, "s", "x") for i, t in more.items()])
            text_index.run(spark, str(docs), out, SETTINGS)
            now |= more
        assert (joins() == [0, 0]) == (most > 0) and held(spark, out) == expected(now)
        assert text_index.index(spark, out)[0].count() == len(now)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
