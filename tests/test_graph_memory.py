from pyspark.sql import functions as F

from marlstone.functions.vectors import VectorBackend
from marlstone.operators import graph, imports, memory
from marlstone.schemas import CHECKPOINTS, MEMORIES


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "from_file string, to_file string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_impact_chain(spark):
    e = edges(spark, ("auth", "utils"), ("api", "auth"), ("index", "api"), ("api.test.ts", "api"))
    assert rows(graph.impact(e, "utils").select("file", "depth")) == [("api", 2), ("api.test.ts", 3), ("auth", 1), ("index", 3)]
    assert {r["file"] for r in graph.impact(e, "api").where("is_test").collect()} == {"api.test.ts"}
    assert graph.impact(e, "index").count() == 0
    assert rows(graph.impact(e, "utils", 1).select("file")) == [("auth",)]


def test_impact_lists_root_in_a_cycle(spark):
    assert rows(graph.impact(edges(spark, ("a", "b"), ("b", "a")), "a").select("file", "depth")) == [("a", 2), ("b", 1)]
    assert rows(graph.impact(edges(spark, ("a", "a")), "a").select("file", "depth")) == [("a", 1)]


def test_distance(spark):
    e = edges(spark, ("service", "middleware"), ("middleware", "password"), ("password", "hash"), ("x", "y"))
    files = spark.createDataFrame([(f,) for f in ("hash", "password", "middleware", "service", "x")], "file string")
    assert rows(graph.with_distance(files, e, "hash").select("file", "distance")) == [("hash", 0), ("middleware", 2), ("password", 1), ("service", 3), ("x", 5)]
    assert dict(rows(graph.with_distance(files, e, "service").select("file", "distance")))["hash"] == 3


def test_risk_labels(spark):
    for n, label, score in ((0, "low", 0), (2, "medium", 20), (4, "high", 40), (7, "critical", 70), (100, "critical", 100)):
        i = spark.range(n).select(F.col("id").cast("string").alias("file"), F.lit(1).alias("depth"))
        r = graph.risk(i).first()
        assert (r["label"], r["score"]) == (label, score)


def test_risks_of_many_roots_agree_with_one(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("d", "b"), ("a", "d"), ("e", "z"))
    for r in graph.risks(e, spark.createDataFrame([("a",), ("z",), ("q",)], "file string")).collect():
        want = graph.risk(graph.impact(e, r["file"])).first()
        assert (r["direct"], r["transitive"], r["score"], r["label"]) == tuple(want)


FILES = {
    "/p/src/a.ts": "import { b } from './b';\nimport x from 'react';\nconst c = require('../lib');\n// import '@utils/d'",
    "/p/src/b.ts": "export const b = 1; import { e } from \"./e.js\"",
    "/p/lib/index.ts": "export * from './deep';\nexport { q } from '../src/b';\nexport type { T } from './types';\nexport * as ns from './ns'",
    "/p/lib/deep.tsx": "import self from './deep'",
    "/p/lib/types.ts": "",
    "/p/lib/ns.ts": "",
    "/p/src/utils/d.ts": "import core from '@scope/core/sub'",
    "/p/packages/core/src/index.ts": "",
    "/p/src/e.ts": "",
    "/p/m.py": "import n\nfrom pkg.o import p\n",
    "/p/n.py": "",
}


def test_build_edges(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    aliases = imports.PathAliases("/p", [("@utils/*", ["nowhere/*", "src/utils/*"])])
    got = set(rows(imports.build_edges(files, "/p", aliases)))
    assert got == {
        ("/p/src/a.ts", "/p/src/b.ts"), ("/p/src/a.ts", "/p/lib/index.ts"), ("/p/src/a.ts", "/p/lib/deep.tsx"), ("/p/src/a.ts", "/p/src/utils/d.ts"),
        ("/p/lib/index.ts", "/p/lib/deep.tsx"), ("/p/lib/index.ts", "/p/src/b.ts"), ("/p/lib/index.ts", "/p/lib/types.ts"), ("/p/lib/index.ts", "/p/lib/ns.ts"),
        ("/p/lib/deep.tsx", "/p/lib/deep.tsx"), ("/p/src/utils/d.ts", "/p/packages/core/src/index.ts"),
    }
    more = set(rows(imports.build_edges(files, "/p", aliases, js_to_ts=True)))
    assert more - got == {("/p/src/b.ts", "/p/src/e.ts")}


def test_build_edges_relative_root_and_empty(spark):
    files = spark.createDataFrame([("src/a.ts", "import './x/../b'"), ("src/b.ts", None)], "path string, content string")
    assert rows(imports.build_edges(files)) == [("src/a.ts", "src/b.ts")]
    assert imports.build_edges(files.limit(0)).count() == 0


def notes(spark, *rows_):
    return spark.createDataFrame([(i, c, ["t"], v, s, at, None, n) for n, (i, c, v, s, at) in enumerate(rows_)], MEMORIES)


def test_recall_order_ties_and_stale(spark):
    m = notes(spark, ("a", "x", [1.0, 0.0], False, 1), ("b", "y", [0.0, 1.0], False, 2), ("c", "z", [1.0, 0.0], True, 3), ("d", "w", None, False, 4))
    got = memory.recall(m, VectorBackend([1.0, 0.0]), 2).collect()
    assert [r["id"] for r in got] == ["c", "a"] and got[0]["stale"]
    seen = {r["id"]: r["last_seen_at"] for r in memory.touched(m, memory.recall(m, VectorBackend([1.0, 0.0]), 2), 9).collect()}
    assert seen == {"a": 9, "b": None, "c": 9, "d": None}
    assert [r["id"] for r in memory.newest_first(m).collect()] == ["d", "c", "b", "a"]
    assert {r["id"] for r in memory.deleted(m, "a").collect()} == {"b", "c", "d"}


def test_audit(spark):
    m = notes(spark, ("near", "x", [1.0, 0.1], False, 1), ("far", "y", [-1.0, 0.0], False, 2), ("was", "z", [-1.0, 0.0], True, 3), ("odd", "w", [1.0, 0.0, 0.0], False, 4))
    chunks = spark.createDataFrame([([1.0, 0.0], 1), (None, 2), ([0.0, 0.0], 3)], "embedding array<double>, seq long")
    a = memory.audit(m, chunks)
    assert {r["id"]: r["marked"] for r in a.collect()} == {"near": False, "far": True, "odd": True}
    assert {r["id"]: r["stale"] for r in memory.after_audit(m, a).collect()} == {"near": False, "far": True, "was": True, "odd": True}
    assert all(r["marked"] for r in memory.audit(m, chunks.limit(0)).collect())
    assert memory.audit(m, chunks, limit=0).count() == 3


def test_checkpoints(spark):
    c = spark.createDataFrame([("1", "first", ["a"], 5, 1), ("2", "second", [], 5, 2)], CHECKPOINTS)
    assert memory.latest_checkpoint(c).first()["summary"] == "second"
    assert [r["id"] for r in memory.checkpoint_list(c).collect()] == ["2", "1"]
    assert memory.latest_checkpoint(c.limit(0)).count() == 0
