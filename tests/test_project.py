import itertools
import json
import os

import pytest

from marlstone.__main__ import parser, run
from marlstone.plans import materialize
from marlstone.session import Project
from marlstone.sources import files, git, store
from marlstone.sources.files import path_aliases
from marlstone.sources.store import Conflict, Store
from marlstone.streaming.incremental import index_stream


def write(root, name, text, mtime=None):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    if mtime:
        os.utime(p, (mtime, mtime))
    return str(p)


@pytest.fixture
def project(spark, tmp_path):
    root = tmp_path / "p"
    write(root, "tsconfig.json", json.dumps({"compilerOptions": {"baseUrl": ".", "paths": {"@u/*": ["src/u/*"]}}}))
    write(root, "src/auth.ts", "import { hash } from '@u/hash';\nexport function authenticate(token: string) {\n  return hash(token);\n}\n", 1000)
    write(root, "src/u/hash.ts", "export function hash(x: string) {\n  return x;\n}\n", 1000)
    write(root, "src/auth.test.ts", "import { authenticate } from './auth';\nconst t = () => authenticate('x')\n", 1000)
    write(root, "README.md", "# Guide\nauthenticate users with a token\n", 1000)
    write(root, "node_modules/x/index.ts", "export function no() {}", 1000)
    return Project(spark, str(root), str(tmp_path / "store"), clock=lambda: 2000), root


def test_index_search_graph(project):
    p, root = project
    assert p.index() == {"files": 4, "chunks": 4}
    assert p.index() == {"files": 4, "chunks": 0}
    write(root, "src/u/hash.ts", "export function hash2(x: string) {\n  return x;\n}\n", 1500)
    assert p.index() == {"files": 4, "chunks": 1}
    names = {r["name"] for r in p.store.read("chunks").collect()}
    assert names == {"authenticate", "hash2", "t", "Guide"}

    auth, hash_ = str(root / "src/auth.ts"), str(root / "src/u/hash.ts")
    assert p.analyze_impact(hash_).endswith("Safe to change.")
    assert p.rebuild_graph() == 4
    report = p.analyze_impact(hash_)
    assert "**Risk: MEDIUM (12/100)**" in report and f"- `{auth}`" in report and "(depth 2)" in report and "**Test files affected (1):**" in report
    assert json.loads(p.safe_to_change(hash_)) == {"file": hash_, "risk": "medium", "score": 12, "affected": 2, "direct": 1}

    found = p.search_context("authenticate token", 3, "thorough")
    assert "# Context: authenticate token" in found and "chunks shown" in found and f"{auth}::authenticate" in found
    assert p.expand_chunk("none") == "Chunk not found: none"
    assert p.expand_chunk(f"{auth}::authenticate", "q").startswith(f"**{auth}:2**\n```\nexport function")
    p.set_context(auth)
    assert p.context_file() == auth and p.search("authenticate token", 2).count() == 2
    assert p.status()["expands"] == 1 and p.status()["edges"] == 2
    os.remove(root / "README.md")
    assert p.index(prune_deleted=True)["files"] == 3 and p.status()["chunks"] == 3


def test_query_names_context_file(project):
    p, _ = project
    p.index()
    p.search_context("fix src/auth.ts please")
    assert p.context_file() == "src/auth.ts"


def test_memory_and_checkpoints(project):
    p, _ = project
    assert p.recall("anything") == "No relevant memories found." and p.get_checkpoint() == "No checkpoints saved yet."
    a = p.save_learning("use the token", ["auth"])
    p.save_learning("hash twice")
    assert "*(auth)*" in p.recall("token use") and {r["last_seen_at"] for r in p.list_memories().collect()} == {2000}
    assert p.audit_memories() == "Audited 2 memories. Marked 2 as stale."
    assert "*[stale]*" in p.start_task("token")
    assert p.delete_memory(a) and not p.delete_memory(a) and p.list_memories().count() == 1
    p.save_checkpoint("one")
    p.save_checkpoint("two", ["x"])
    assert p.latest_checkpoint()["summary"] == "two" and "- x" in p.get_checkpoint() and p.list_checkpoints().count() == 2


def test_store_reads_older_columns(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("file_meta").count() == 0
    s.write("graph_edges", spark.createDataFrame([("a", "b")], "from_file string, to_file string"))
    s.write("graph_edges", s.read("graph_edges").union(s.read("graph_edges")))
    assert s.read("graph_edges").count() == 2
    old = tmp_path / "file_meta" / "data-0"
    spark.createDataFrame([("a", 1)], "path string, mtime long").write.parquet(str(old))
    (tmp_path / "file_meta" / "version-000000000001").write_text("data-0")
    assert [tuple(r) for r in s.read("file_meta").collect()] == [("a", 1, None)]


def test_store_of_two_writers(spark, tmp_path, monkeypatch):
    edge = lambda *x: spark.createDataFrame(list(x), "from_file string, to_file string")
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.write("graph_edges", edge(("a", "b")))
    old = b.read("graph_edges")
    a.write("graph_edges", a.read("graph_edges").union(edge(("c", "d"))))
    with pytest.raises(Conflict):
        b.write("graph_edges", old.limit(0))
    assert a.read("graph_edges").count() == 2
    b.append("graph_edges", edge(("e", "f")))
    a.append("graph_edges", edge(("g", "h")))
    assert b.read("graph_edges").count() == 4
    b.write("graph_edges", b.read("graph_edges").where("from_file <> 'a'"))
    b.overwrite("graph_edges", edge(("x", "y")))
    a.overwrite("graph_edges", edge(("x", "z")))
    assert [tuple(r) for r in b.read("graph_edges").collect()] == [("x", "z")]
    monkeypatch.setattr(store, "MOST_FOLDERS", 3)
    for i in range(5):
        a.append("graph_edges", edge((f"n{i}", "m")))
    assert len(a.folders("graph_edges", a.latest("graph_edges"))) <= 3 and a.read("graph_edges").count() == 6
    assert a.vacuum() > 3 and a.read("graph_edges").count() == 6 and len(a.versions("graph_edges")) == 1
    (tmp_path / "graph_edges" / f"version-{a.latest('graph_edges') + 1:012d}").touch()  # one that is being written
    assert a.read("graph_edges").count() == 6


def test_files_by_name(spark, tmp_path, monkeypatch):
    names = ["a.ts", "src/[id].tsx", "src/{x}*?.md", "b.py"]
    paths = [write(tmp_path, n, f"text of {n}") for n in names]
    wanted = spark.createDataFrame([(p,) for p in paths[1:3]], "path string")
    for most in (5000, 1):
        monkeypatch.setattr(files, "MOST_NAMED", most)
        got = {r["path"]: r["content"] for r in files.read_files(spark, str(tmp_path), wanted).collect()}
        assert got == {p: f"text of {n}" for p, n in zip(paths[1:3], names[1:3])}
    assert files.read_files(spark, str(tmp_path), wanted.limit(0)).count() == 0


def test_temporary_tables_go(spark):
    def there(df):
        return os.path.exists(df.table_path.removeprefix("file://"))

    with materialize.temporary(spark) as keep:
        a, b = materialize.materialized(spark.range(3)), keep(materialize.materialized(spark.range(4)))
        with materialize.temporary(spark) as inner:
            c, d = materialize.materialized(spark.range(5)), inner(materialize.materialized(spark.range(6)))
        assert not there(c) and there(d)
    assert not there(a) and there(b) and not there(d) and b.count() == 4


def test_malformed_aliases(spark, tmp_path):
    write(tmp_path, "tsconfig.json", "{ // comment\n}")
    assert path_aliases(spark, str(tmp_path)).paths == []


def test_index_stream(project, tmp_path):
    p, root = project
    index_stream(p, str(tmp_path / "ck")).awaitTermination()
    assert p.status()["chunks"] == 4
    write(root, "src/new.ts", "export const n = () => 1\n")
    index_stream(p, str(tmp_path / "ck")).awaitTermination()
    assert p.status()["chunks"] == 5


def test_git_times(spark, tmp_path):
    assert git.parsed_times(["@30\n", "a.ts\n", "\n", "@20\n", "a.ts\n", "b c.ts\n"], "/r") == [("/r/a.ts", 30), ("/r/b c.ts", 20)]
    endless = itertools.chain(["@30", "a.ts", "b.ts"], itertools.repeat("c.ts"))
    assert git.parsed_times(endless, "/r", {"/r/a.ts", "/r/b.ts"}) == [("/r/a.ts", 30), ("/r/b.ts", 30)]
    assert git.git_times(spark, str(tmp_path)).count() == 0


def test_command_line(project):
    p, root = project
    say = lambda *x: run(p, parser().parse_args([str(root), *x]))
    assert say("index") == "Indexed 4 files, 4 chunks." and say("graph") == "Graph rebuilt for 4 files."
    assert "chunks: 4" in say("status") and "# Context: token" in say("search", "token", "--density", "thorough")
    assert "MEDIUM" in say("impact", str(root / "src/u/hash.ts"))
    own = say("memory", "save", "a note")
    assert own in say("memory", "list") and "a note" in say("memory", "recall", "note") and say("memory", "audit").startswith("Audited 1")
    assert say("memory", "delete", own) == "Deleted." and say("memory", "list") == "No memories."
    assert say("checkpoint", "list") == "No checkpoints." and say("checkpoint", "save", "here") in say("checkpoint", "list") and "here" in say("checkpoint", "get")
