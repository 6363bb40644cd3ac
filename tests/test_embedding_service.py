"""Hosted embeddings against a server of our own: what is sent, tries, failures, and what is kept."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from marlstone.functions import vectors
from marlstone.session import Project
from marlstone.sources import embedding_service
from marlstone.sources.embedding_service import Service, ServiceError


def vector(text):
    return [float(len(text)), float(text.count("e")), 1.0]


@pytest.fixture
def server():
    calls, fails = [], []  # what was sent; codes to answer with first

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            texts = body["input"] if "input" in body else [body["prompt"]]
            calls.append((self.path, self.headers.get("Authorization"), body["model"], texts))
            code = fails.pop(0) if fails else 400 if any("poison" in t for t in texts) else 200
            answer = {"data": [{"index": i, "embedding": vector(t)} for i, t in reversed(list(enumerate(texts)))]} if "input" in body else {"embedding": vector(texts[0])}
            said = json.dumps(answer if code == 200 else {"error": "no"}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.calls, s.fails, s.url = calls, fails, f"http://127.0.0.1:{s.server_address[1]}/"
    yield s
    s.shutdown()


def test_calls_and_tries(server):
    hosted = Service(server.url, "m", key="k", wait=0.01)
    assert hosted.embed(["abc", "see"]) == [vector("abc"), vector("see")]
    assert server.calls == [("/v1/embeddings", "Bearer k", "m", ["abc", "see"])]
    assert len(hosted.embed(["x" * 9000])[0]) == 3 and len(server.calls[-1][3][0]) == 8000
    server.fails += [503, 429]
    assert hosted.embed(["again"]) == [vector("again")] and len(server.calls) == 5
    server.fails += [500, 500, 500]
    with pytest.raises(ServiceError, match="500"):
        hosted.embed(["never"])
    server.calls.clear()
    with pytest.raises(ServiceError, match="400"):
        hosted.embed(["poison"])
    assert len(server.calls) == 1  # not tried again
    assert hosted(["a", "poison", "b"]) == [vector("a"), None, vector("b")]
    own = Service(server.url, "n", "server")
    assert own(["one", "three"]) == [vector("one"), vector("three")] and server.calls[-1] == ("/api/embeddings", None, "n", ["three"])
    with pytest.raises(ServiceError):
        Service("http://127.0.0.1:9", "m", tries=2, wait=0.01, timeout=1).embed(["x"])


def test_kept_vectors_are_not_asked_for_again(spark, server):
    s = Service(server.url, "m", wait=0.01, batch=2)
    texts = spark.createDataFrame([("one",), ("three",), ("one",), (None,), ("poison",), ("",)], "text string")
    none = spark.createDataFrame([], "hash string, embedding array<double>")
    new = embedding_service.new_vectors(texts, none, s)
    sent = [t for c in server.calls for t in c[3]]
    assert new.count() == 4 and {"one", "three", "poison", ""} == set(sent)
    server.calls.clear()
    assert embedding_service.new_vectors(texts.where("text <> 'poison'"), none, s).count() == 3 and sorted(t for c in server.calls for t in c[3]) == ["", "one", "three"]
    kept = new.where("embedding is not null")
    server.calls.clear()
    again = embedding_service.new_vectors(texts, kept, s)
    assert {t for c in server.calls for t in c[3]} == {"poison"} and again.where("embedding is not null").count() == 0
    got = [r["embedding"] for r in embedding_service.with_vectors(texts.withColumn("embedding", F.lit("clash")), F.col("text"), kept, s).orderBy(F.length("text").asc_nulls_first(), "text").collect()]
    assert got == [None, vector(""), vector("one"), vector("one"), vector("three"), None]
    server.calls.clear()
    assert embedding_service.new_vectors(texts, kept, Service(server.url, "other", wait=0.01)).count() == 4  # another model keeps its own


def test_a_project_with_a_service(spark, tmp_path, server):
    root = tmp_path / "p"
    root.mkdir()
    for i, body in enumerate(("eee", "poison", "zzz")):
        (root / f"{i}.md").write_text(f"# Part{i}\n{body}\n")
    p = Project(spark, str(root), str(tmp_path / "store"), clock=lambda: 5, service=Service(server.url, "m", wait=0.01))
    assert p.index() == {"files": 3, "chunks": 3}
    rows = {r["name"]: r for r in p.store.read("chunks").collect()}
    assert rows["Part0"]["embedding"] == vector("Part0 # Part0\neee\n") and rows["Part1"]["embedding"] is None and rows["Part0"]["sign"] is None
    server.calls.clear()
    assert p.index()["chunks"] == 0 and server.calls == []
    (root / "2.md").write_text("# Part2\nzzz\n\n# More\nzzz\n")
    p.index()
    assert sorted(t for c in server.calls for t in c[3]) == ["More # More\nzzz\n", "Part2 # Part2\nzzz\n"] or len(server.calls) == 1
    server.calls.clear()
    p.index_file(str(root / "0.md"))
    assert server.calls == []  # kept
    found = p.search("eee", 2).collect()
    assert "Part1" not in {r["name"] for r in found} and len(found) == 2
    a = p.save_learning("a note of eee")
    assert a and "a note of eee" in p.recall("eee")
    server.fails += [500] * 3
    with pytest.raises(ServiceError):
        p.save_learning("another")


def test_choice_of_backend_as_a_column(spark):
    rows = spark.createDataFrame([("x", True), (None, True), (None, False), ("", False), ("", True)], "explicit string, key boolean")
    got = [r["b"] for r in rows.select(vectors.backend_choice(F.col("explicit"), F.col("key")).alias("b")).collect()]
    assert got == [vectors.backend_name(r["explicit"], r["key"]) for r in rows.collect()] == ["x", "hosted", "local", "local", "hosted"]
