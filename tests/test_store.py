"""The store: changes of several tables at once, dead and late writers, layers, lookups; and what an index writes and leaves."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, rerank
from marlstone.plans.materialize import shared_folder
from marlstone.session import Project
from marlstone.sources import git, store
from marlstone.sources.store import Conflict, Store


def edge(spark, *rows):
    return spark.createDataFrame(list(rows), "from_file string, to_file string")


def meta(spark, *rows):
    return spark.createDataFrame([(p, t, None) for p, t in rows], "path string, mtime long, git_updated_at long")


def chunk(spark, *rows):
    return spark.createDataFrame([(f"{p}::{i}", p, i) for p, n in rows for i in range(n)], "id string, file_path string, start_line int").selectExpr("id", "file_path", "'section' kind", "string(null) name", "start_line", "start_line end_line", "'x' content", "array(1D) embedding", "1 sign", "1L updated_at", "1L seq")


def keys(spark, column, *names):
    return spark.createDataFrame([(x,) for x in names], f"{column} string")


def change(spark, files, t):
    """files: path, chunks; of none, the file is gone."""
    there = [(p, n) for p, n in files if n]
    paths = [p for p, _ in files]
    return {"chunks": (chunk(spark, *there), keys(spark, "file_path", *paths)), "file_meta": (meta(spark, *((p, t) for p, _ in there)), keys(spark, "path", *paths))}


def state(s):
    return sorted((r["file_path"], r["id"]) for r in s.read("chunks").collect()), sorted((r["path"], r["mtime"]) for r in s.read("file_meta").collect())


def files_below(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}


class Killed(Exception):
    pass


def dying(spark, root, at):
    """A store whose writer dies before so many files that are made under their name."""

    class Dies(Store):
        left = at

        def _put(self, text, *parts):
            self.left -= 1
            if self.left < 0:
                raise Killed
            return super()._put(text, *parts)

    return Dies(spark, root)


def test_a_dead_writer_stops_nobody(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    (tmp_path / "graph_edges").mkdir()
    (tmp_path / "graph_edges" / "version-000000000001").touch()  # died between making and filling it
    s.append("graph_edges", edge(spark, ("a", "b")))
    s.write("graph_edges", s.read("graph_edges").union(edge(spark, ("c", "d"))))
    s.overwrite("graph_edges", s.read("graph_edges").union(edge(spark, ("e", "f"))))
    assert s.read("graph_edges").count() == 3 and s.versions("graph_edges") == [2, 3, 4]


def test_no_row_is_lost_to_an_older_read(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.write("graph_edges", edge(spark, ("one", "x")))
    read = a.read("graph_edges")
    b.append("graph_edges", edge(spark, ("other", "x")))
    a.append("graph_edges", edge(spark, ("mine", "x")))
    with pytest.raises(Conflict):
        a.write("graph_edges", read)
    assert {r[0] for r in a.read("graph_edges").collect()} == {"one", "other", "mine"}


@pytest.mark.parametrize("at", [0, 1, 2])
def test_a_kill_in_a_change_of_two_tables_leaves_the_old_state(spark, tmp_path, at):
    s = Store(spark, str(tmp_path))
    s.replace(change(spark, [("a", 2), ("b", 1)], 1))
    old = state(s)
    with pytest.raises(Killed):
        dying(spark, str(tmp_path), at).replace(change(spark, [("a", 3), ("c", 1)], 2))
    assert state(s) == old and state(Store(spark, str(tmp_path))) == old
    s.replace(change(spark, [("b", 2)], 3))
    assert state(s) == ([("a", "a::0"), ("a", "a::1"), ("b", "b::0"), ("b", "b::1")], [("a", 1), ("b", 3)])
    s.vacuum()
    assert state(s)[1] == [("a", 1), ("b", 3)] and len(os.listdir(tmp_path / "commits")) == 2  # the record, and its checksum


def test_a_late_writer_changes_nothing(spark, tmp_path):
    """Another writer goes on while a change has made its versions, but not its record."""
    other = Store(spark, str(tmp_path))
    other.replace(change(spark, [("a", 1)], 1))

    class Slow(Store):
        def _put(self, text, *parts):
            if text == "done":
                other.append("file_meta", meta(spark, ("z", 9)))
            return super()._put(text, *parts)

    with pytest.raises(Conflict):
        Slow(spark, str(tmp_path)).replace(change(spark, [("a", 2)], 2))
    assert state(other) == ([("a", "a::0")], [("a", 1), ("z", 9)])


def test_one_of_two_changes_from_one_read_fails(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.replace(change(spark, [("a", 1)], 1))
    a.read("chunks"), a.read("file_meta"), b.read("chunks"), b.read("file_meta")
    a.replace(change(spark, [("a", 2)], 2))
    with pytest.raises(Conflict):
        b.replace(change(spark, [("a", 3)], 3))
    assert state(b)[1] == [("a", 2)]


@pytest.mark.parametrize("most", [32, 3])
def test_layers_give_what_the_last_change_of_each_file_wrote(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(store, "MOST_FOLDERS", most)
    rng, s, want = random.Random(most), Store(spark, str(tmp_path)), {}
    for t in range(1, 9):
        files = [(f"f{i}", rng.randint(0, 3)) for i in rng.sample(range(6), rng.randint(1, 4))]
        s.replace(change(spark, files, t))
        want |= {p: (n, t) for p, n in files}
        assert state(s) == (sorted((p, f"{p}::{i}") for p, (n, _) in want.items() for i in range(n)), sorted((p, t) for p, (n, t) in want.items() if n))
        assert len(s.layers("chunks", s.latest("chunks"))) <= most
        assert {(r["file_path"], r["n"]) for r in s.keys("chunks").collect()} == {(p, n) for p, (n, _) in want.items() if n}
        assert "/data-" not in "".join(s.keys("chunks").inputFiles())
    before = state(s)
    assert (s.vacuum() > 0) == (most == 3) and state(s) == before


def test_keys_of_appended_and_written_rows(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.keys("chunks").count() == 0
    s.write("chunks", chunk(spark, ("a", 2), ("b", 1)))
    assert "/data-" not in "".join(s.keys("chunks").inputFiles())
    s.append("chunks", chunk(spark, ("b", 2), ("c", 1)))
    got = lambda: {(r["file_path"], r["n"]) for r in s.keys("chunks").collect()}
    assert got() == {("a", 2), ("b", 3), ("c", 1)} and s.read("chunks").count() == 6
    s.replace(change(spark, [("b", 0), ("d", 1)], 1))
    assert got() == {("a", 2), ("c", 1), ("d", 1)} and s.read("chunks").count() == 4


def tree(root, names):
    for i, n in enumerate(names):
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"export function f{i}(x) {{\n  return {i};\n}}\n" + "// filler of some length\n" * 20)
        os.utime(p, (1000, 1000))


def test_an_index_writes_what_has_changed(spark, tmp_path):
    root, at = tmp_path / "p", tmp_path / "store"
    tree(root, [f"src/m{i}.ts" for i in range(700)])
    p = Project(spark, str(root), str(at), clock=lambda: 2000)
    assert p.index() == {"files": 700, "chunks": 700}
    first = files_below(at)
    assert p.index() == {"files": 700, "chunks": 0} and files_below(at) == first
    (root / "src/m7.ts").write_text("export function g() {}\nexport function h() {}\n")
    assert p.index() == {"files": 700, "chunks": 2}
    new = {f: n for f, n in files_below(at).items() if f not in first}
    assert 0 < sum(new.values()) < sum(first.values()) / 4
    assert {r["name"] for r in p.store.read("chunks").where("file_path like '%/m7.ts'").collect()} == {"g", "h"} and p.status()["chunks"] == 701
    os.remove(root / "src/m8.ts")
    assert p.index()["files"] == 699 and p.status()["files"] == 700
    assert p.index(prune_deleted=True) == {"files": 699, "chunks": 0} and p.status()["files"] == 699 and p.status()["chunks"] == 700
    assert p.index_file(str(root / "src/m9.ts")) == 1 and p.status()["chunks"] == 700


def test_ranking_of_an_index_that_changes(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.md").write_text(f"# Part {i}\n" + "alpha beta " * i + "gamma\n")
        os.utime(root / f"{i}.md", (1000, 1000))
    p = Project(spark, str(root), str(tmp_path / "store"), clock=lambda: 5, ranked=True)
    p.index()

    def agrees():
        all_ = rerank.bm25_scores(p.store.read("chunks"), "alpha gamma alpha").orderBy(F.desc("bm25"), "id").limit(3).collect()
        got = p.rank("alpha gamma alpha", 3).orderBy(F.desc("bm25"), "id").collect()
        assert [(r["id"], round(r["bm25"], 9)) for r in got] == [(r["id"], round(r["bm25"], 9)) for r in all_]
        return [r["name"] for r in got]

    first = agrees()
    (root / "0.md").write_text("# Part 0\n" + "alpha gamma " * 4)
    os.remove(root / "5.md")
    assert p.index(prune_deleted=True) == {"files": 5, "chunks": 1}
    assert "Part 0" in agrees() and "Part 0" not in first and p.store.read("lengths").count() == 5
    assert p.rank("nowhere", 2).count() == 2  # all score 0: the first by id


def test_tools_leave_no_tables(spark, tmp_path):
    root = tmp_path / "p"
    tree(root, ["src/a.ts", "src/b.ts"])
    (root / "src/c.ts").write_text("import { x } from './a';\nexport const c = () => x;\n")
    p = Project(spark, str(root), str(tmp_path / "store"), clock=lambda: 2000)
    shared = shared_folder(spark).removeprefix("file://")
    p.index()
    p.save_learning("a note")
    p.set_context(str(root / "src/a.ts"))
    before = sorted(os.listdir(shared))
    p.rebuild_graph()
    assert "(12/100)" in p.analyze_impact(str(root / "src/a.ts"), heading="Blast radius of") or p.analyze_impact(str(root / "src/a.ts"))
    p.safe_to_change(str(root / "src/a.ts"))
    p.search_context("filler of a note", 3)
    p.start_task("a note")
    p.recall("a note")
    p.audit_memories()
    p.index()
    assert sorted(os.listdir(shared)) == before


def rows_scanned(df):
    """How many rows the scans of df's last plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_read_the_folders_that_have_the_key(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for i in range(8):
        s.append("chunks", chunk(spark, *((f"f{j:03}", 3) for j in range(i, 800, 8))))
    found = s.read("chunks").where("id = 'f123::1'").coalesce(1)
    assert found.collect()[0]["file_path"] == "f123" and 0 < rows_scanned(found) <= 300  # of 2,400
    none = s.read("chunks").where("id = 'f123::7'")
    assert none.collect() == [] and rows_scanned(none) <= 300
    s.overwrite("graph_edges", edge(spark, *((f"f{i}", f"f{i // 2}") for i in range(1, 2000))))
    assert sorted(r["file"] for r in graph.impact(s.read("graph_edges"), "f400").where("depth = 1").collect()) == ["f800", "f801"]


@pytest.mark.parametrize("pushed", [1000, 0])
def test_reach_of_few_and_many_files(spark, monkeypatch, pushed):
    monkeypatch.setattr(graph, "MOST_PUSHED", pushed)
    e = edge(spark, ("b", "a"), ("c", "a"), ("d", "b"), ("a", "d"), ("e", "c"), ("x", "y"), ("z", None), (None, "a"))
    assert {(r["file"], r["depth"]) for r in graph.impact(e, "a").where("file is not null").collect()} == {("b", 1), ("c", 1), ("d", 2), ("e", 2), ("a", 3)}
    assert {(r["file"], r["distance"]) for r in graph.distances(e, "e").where("file is not null").collect()} == {("e", 0), ("c", 1), ("a", 2), ("b", 3), ("d", 3)}


def test_history_of_a_repository_in_parts(spark, tmp_path):
    call = lambda *x, **env: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.org", *x], check=True, capture_output=True, env=os.environ | env)
    call("init", "-q")
    want = {}
    for k in range(7):
        name = ["a.ts", "src/b c.ts", "ä.md"][k % 3]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(str(k))
        call("add", ".")
        call("commit", "-qm", str(k), GIT_COMMITTER_DATE=f"@{1000 + k} +0000", GIT_AUTHOR_DATE=f"@{1000 + k} +0000")
        want[f"{tmp_path}/{name}"] = 1000 + k
    for size in (1, 2, 5000):
        assert {r["path"]: r["git_updated_at"] for r in git.newest_times(git.history(spark, str(tmp_path), size)).collect()} == want
    assert git.history(spark, str(tmp_path), 2).rdd.getNumPartitions() == 4
    assert git.git_times(spark, str(tmp_path / "nowhere")).count() == 0
