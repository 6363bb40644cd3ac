"""Queries for what the tools do as their users call them: reports, notes, whole indexing runs, the store and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.vectors import LocalBackend
from ..operators import chunking, feedback, graph, groups, imports, indexing, memory, packing, postings, scoring
from ..schemas import TABLES
from ..session import Project
from ..sources.files import aliases_of
from ..sources.git import newest_times
from ..sources.store import Store
from ..streaming.incremental import index_stream
from .materialize import delete, materialized, shared_folder
from .registry import EDGES, LOG, MEMORIES, META, NOW, QUERY, SCORED, SEARCH, SIGN, STUB, SUMMARY, TEMPORAL, TOPIC, _reach, _search, _signals, checkpoints, chunks, edges, memories, oracle_sql, query, r6, table

NL = "chr(10)"

# reports


def _rendered(top: int, task: str, exclude: str = "") -> str:
    """CTEs that end in ctx: context, shown, dropped, ids."""
    search = SEARCH.replace("LIMIT 30", f"LIMIT {3 * top}").replace("LIMIT 10", f"LIMIT {top}")
    return f"""{search}, p AS (SELECT *, CASE WHEN score >= 0.65 THEN 'full' WHEN score >= 0.4 THEN 'summary' WHEN score >= 0.15 THEN 'stub' ELSE 'dropped' END AS tier FROM res {exclude}),
t AS (SELECT rank, id, tier, CASE WHEN score >= 0.65 THEN 1 WHEN score >= 0.35 THEN 2 ELSE 3 END AS band, '### ' || file_path || ':1' || {NL} || '```' || {NL} || CASE tier WHEN 'full' THEN content WHEN 'summary' THEN {SUMMARY} ELSE {STUB} END || {NL} || '```' || {NL} AS s FROM p WHERE tier <> 'dropped'),
s AS (SELECT 0 AS band, 0 AS rank, '# Context: {task}' || {NL} AS s UNION ALL SELECT band, 0, '## ' || ['High', 'Medium', 'Low'][band] || {NL} FROM t GROUP BY band UNION ALL SELECT band, rank, s FROM t UNION ALL SELECT 9, 0, {NL} || '*' || count(*) || ' lower-scoring chunk(s) omitted — narrow query or increase token_budget to see them.*' || {NL} FROM p WHERE tier = 'dropped' HAVING count(*) > 0),
ctx AS (SELECT string_agg(s, {NL} ORDER BY band, rank) AS context, (SELECT count(*) FROM t) AS shown, (SELECT count(*) FROM p WHERE tier = 'dropped') AS dropped, (SELECT string_agg(id, ', ' ORDER BY rank) FROM t) AS ids FROM s)"""


@query(f"WITH {_rendered(10, QUERY, 'WHERE id NOT IN (' + chr(39) + '1' + chr(39) + ', ' + chr(39) + '2' + chr(39) + ')')} SELECT md5(context || {NL} || '---' || {NL} || '*~' || ceil(length(context) / 4)::BIGINT || ' tokens | ' || shown || ' chunks shown' || CASE WHEN dropped > 0 THEN ' | ' || dropped || ' dropped' ELSE '' END || ' | 2 excluded*' || {NL} || '*chunk_ids: ' || coalesce(ids, '') || '*') AS digest FROM ctx")
def tool_search_context(spark, d):
    packed = packing.compressed(_search(spark, d), exclude=["1", "2"])
    return packing.search_report(packed, QUERY, 2).select(F.md5("text").alias("digest"))


_RECALLED = f"(SELECT *, ({SIGN.format('content')} * {SIGN.format(chr(39) + '{0}' + chr(39))})::DOUBLE AS score FROM {MEMORIES} ORDER BY score DESC, created_at DESC, seq LIMIT {{1}})"
_NOTES = f"string_agg('- [' || printf('%.2f', score) || '] ' || content || CASE WHEN stale THEN ' *[stale]*' ELSE '' END || ' *(user)*', {NL} ORDER BY score DESC, created_at DESC, seq)"


@query(
    f"WITH {_rendered(8, QUERY)}, n AS (SELECT '## Memories from past sessions' || CASE WHEN bool_or(stale) THEN {NL} || '> Some memories are flagged stale — verify before relying on them.' ELSE '' END || {NL} || {NL} || {_NOTES} AS notes, count(*) AS k FROM {_RECALLED.format(QUERY, 3)}), "
    f"b AS (SELECT notes || {NL} || {NL} || context AS body, k, shown, dropped FROM n, ctx) SELECT md5(body || {NL} || {NL} || '---' || {NL} || '*~' || ceil(length(body) / 4)::BIGINT || ' tokens | ' || k || ' memories | ' || shown || ' chunks' || CASE WHEN dropped > 0 THEN ' | ' || dropped || ' dropped' ELSE '' END || '*') AS digest FROM b"
)
def tool_start_task(spark, d):
    found = scoring.search_context(chunks(spark, d), QUERY, NOW, 8, **_signals(spark, d))
    notes = memory.recall(memories(spark, d), LocalBackend(QUERY), 3)
    return packing.task_report(notes, packing.compressed(found), QUERY).select(F.md5("text").alias("digest"))


@query(f"SELECT '**Relevant memories:**' || {NL} || {_NOTES} AS text FROM {_RECALLED.format(TOPIC, 5)}")
def tool_recall(spark, d):
    return memory.recall_report(memory.recall(memories(spark, d), LocalBackend(TOPIC)))


_AUDIT = f"c AS (SELECT {SIGN.format('text')} AS s FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 500)), a AS (SELECT id, greatest(0, (SELECT max(m.s * c.s) FROM c)) < 0.4 AS marked FROM (SELECT id, {SIGN.format('content')} AS s FROM {MEMORIES} WHERE NOT stale) m)"


def _audited(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d).withColumn("embedding", vectors.local_embedding(F.col("content")))
    first = table(spark, d, "documents").orderBy("doc_id").limit(memory.CHUNK_LIMIT).select(F.col("doc_id").alias("seq"), vectors.local_embedding(F.col("text")).alias("embedding"))
    return memory.audit(m, first)


@query(f"WITH {_AUDIT} SELECT 'Audited ' || count(*) || ' memories. ' || CASE WHEN count(*) FILTER (marked) > 0 THEN 'Marked ' || count(*) FILTER (marked) || ' as stale.' ELSE 'All look current.' END AS text FROM a")
def tool_audit(spark, d):
    return memory.audit_report(_audited(spark, d))


@query(f"WITH {_AUDIT} SELECT m.id, m.stale OR coalesce(a.marked, false) AS stale FROM {MEMORIES} m LEFT JOIN a ON a.id = m.id")
def memory_after_audit(spark, d):
    return memory.after_audit(memories(spark, d), _audited(spark, d)).select("id", "stale")


@query(f"SELECT id, content, created_at, seq, {SIGN.format('content')} AS sign FROM (SELECT id, content, created_at, seq FROM {MEMORIES} UNION ALL SELECT 'own', 'a note of the past', {NOW}, max(seq) + 1 FROM {MEMORIES})")
def memory_save(spark, d):
    m = memories(spark, d)
    new = memory.new_memory(spark, "own", "a note of the past", ["x"], NOW, m.agg(F.max("seq")).first()[0] + 1)
    columns = ["id", "content", "created_at", "seq"]
    return m.select(columns).unionByName(new.select(columns)).withColumn("sign", vectors.local_sign(F.col("content")))


@query("SELECT 'last' AS id, 'done so far' AS summary, 2::BIGINT AS tasks")
def checkpoint_save(spark, d):
    c = checkpoints(spark, d).drop("open_tasks").withColumn("open_tasks", F.array(F.lit("next")))
    new = memory.new_checkpoint(spark, "last", "done so far", ["a", "b"], NOW, c.agg(F.max("seq")).first()[0] + 1)
    out = memory.latest_checkpoint(c.unionByName(new, allowMissingColumns=True))
    return out.select("id", "summary", F.size("open_tasks").cast("long").alias("tasks"))


@query(f"SELECT '**Last checkpoint** (' || strftime(make_timestamp(epoch * 1000000), '%-m/%-d/%Y, %-I:%M:%S %p') || ')' || {NL} || {NL} || summary || {NL} || {NL} || '**Open tasks:**' || {NL} || '- next' AS text FROM (SELECT {NOW} + conv_id * 86399 AS epoch, arg_max(text, turn) AS summary FROM conversations GROUP BY conv_id)")
def tool_get_checkpoint(spark, d):
    c = checkpoints(spark, d)
    return memory.checkpoint_report(c.withColumn("created_at", F.lit(NOW) + F.col("seq") * 86399))


@query(f"SELECT '**' || source || ':1**' || {NL} || '```' || {NL} || text || {NL} || '```' AS text FROM documents WHERE doc_id = 7")
def tool_expand_chunk(spark, d):
    return feedback.expand_report(chunks(spark, d), "7")


_IMPACT = _reach("N1", "e.f, w.depth + 1 FROM w JOIN e ON e.t = w.file WHERE true", 5) + ", i AS (SELECT file, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY file), r AS (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS far FROM i), q AS (SELECT *, least(100, direct * 10 + far * 2) AS score FROM r), l AS (SELECT *, CASE WHEN score >= 60 THEN 'critical' WHEN score >= 30 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS label FROM q)"


@query(
    _IMPACT + " SELECT 0 AS part, 0 AS depth, CASE WHEN direct + far = 0 THEN 'No dependents found for `N1`. Safe to change.' ELSE '## Impact of `N1`' END AS line FROM l UNION ALL SELECT 1, 0, '**Risk: ' || upper(label) || ' (' || score || '/100)**' FROM l WHERE direct + far > 0 "
    "UNION ALL SELECT 2, 0, '**Direct dependents (' || direct || '):**' FROM l WHERE direct + far > 0 UNION ALL SELECT 3, 1, '- `' || file || '`' FROM i WHERE depth = 1 UNION ALL SELECT 4, 0, '**Transitive dependents (' || far || '):**' FROM l WHERE far > 0 "
    "UNION ALL SELECT 5, depth, '- `' || file || '` (depth ' || depth || ')' FROM i WHERE depth > 1 UNION ALL SELECT 6, 0, 'No test files affected.' FROM l WHERE direct + far > 0"
)
def tool_analyze_impact(spark, d):
    return graph.impact_report(edges(spark, d), "N1")


@query(_IMPACT + """ SELECT '{"file":"N1","risk":"' || label || '","score":' || score || ',"affected":' || (direct + far) || ',"direct":' || direct || '}' AS report FROM l""")
def tool_safe_to_change(spark, d):
    return graph.change_report(edges(spark, d), "N1")


_NAMES = ["src/m{}.ts", "src/m{}.test.ts", "src/__tests__/m{}.ts", "src/m{}.spec.jsx", "src/m{}.tests.ts", "lib/test/m{}.ts"]


@query("SELECT file, depth, regexp_matches(file, '\\.(test|spec)\\.[jt]sx?$') OR regexp_matches(file, '/__tests__/') AS is_test FROM (SELECT CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{n.split('{}')[0]}' || doc_id || '{n.split('{}')[1]}'" for i, n in enumerate(_NAMES)) + " END AS file, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS depth FROM documents) UNION ALL SELECT 'src/middle.ts', 1, false")
def impact_tests(spark, d):
    """Files of various names that depend on src/core.ts, every other one through src/middle.ts."""
    key = F.col("doc_id")
    name = F.lit(None).cast("string")
    for i, n in enumerate(_NAMES):
        head, tail = n.split("{}")
        name = F.when(key % len(_NAMES) == i, F.concat(F.lit(head), key.cast("string"), F.lit(tail))).otherwise(name)
    own = table(spark, d, "documents").select(name.alias("from_file"), F.when(key % 2 == 0, "src/core.ts").otherwise("src/middle.ts").alias("to_file"))
    return graph.impact(own.union(spark.range(1).select(F.lit("src/middle.ts"), F.lit("src/core.ts"))), "src/core.ts")


_LINKS = "(SELECT DISTINCT source AS f, 'src' || (doc_id % 5) AS t FROM documents)"


@query(
    f"WITH RECURSIVE e AS (SELECT f, t FROM {_LINKS} UNION SELECT t, f FROM {_LINKS}), w(file, depth) AS (SELECT 'src0', 0 UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON e.f = w.file WHERE w.depth < 4), h AS (SELECT file, min(depth) AS depth FROM w GROUP BY file), "
    f"m AS (SELECT * FROM {META}), l AS (SELECT * FROM {LOG}) SELECT d.doc_id::VARCHAR AS id, round(least(1.0::DOUBLE, ({SIGN.format(chr(39) + QUERY + chr(39))} * {SIGN.format('d.text')})::DOUBLE * 0.65::DOUBLE + CASE coalesce(h.depth, 99) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 ELSE 0.0 END::DOUBLE * 0.2::DOUBLE + {TEMPORAL.format('m.git_updated_at')} * 0.15::DOUBLE + least(0.15::DOUBLE, coalesce(l.n, 0) * 0.02::DOUBLE)), 6) AS score "
    "FROM documents d LEFT JOIN m ON m.path = d.source LEFT JOIN l ON l.chunk_id = d.doc_id::VARCHAR LEFT JOIN h ON h.file = d.source"
)
def search_near_file(spark, d):
    """Scores with a context file: what is linked with src0 comes first."""
    links = table(spark, d, "documents").select(F.col("source").alias("from_file"), F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string")).alias("to_file")).distinct()
    return scoring.scored_chunks(chunks(spark, d), QUERY, NOW, edges=links, context_file="src0", **_signals(spark, d)).select("id", r6("score").alias("score"))


# imports


_TSCONFIG = '{"compilerOptions": {"baseUrl": "src", "paths": {"@u/*": ["util/*", "other/*"], "core": ["core/main"], "~*": ["x"]}}}'


@query(
    "SELECT '/p/app/a' || doc_id || '.ts' AS from_file, CASE doc_id % 4 WHEN 0 THEN '/p/src/util/m' || doc_id || '.ts' WHEN 1 THEN '/p/src/other/m' || doc_id || '.tsx' WHEN 2 THEN '/p/src/core/main.ts' ELSE '/p/packages/pkg' || doc_id % 8 || '/src/index.ts' END AS to_file FROM documents WHERE doc_id % 8 <> 7"
)
def resolve_aliases(spark, d):
    """Modules that import by the aliases of a tsconfig, by an exact alias, by package name, and one that isn't there."""
    k = F.col("doc_id")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    spec = F.when(k % 4 < 2, text("@u/m", k)).when(k % 4 == 2, text("core")).otherwise(text("@scope/pkg", k % 8))
    docs = table(spark, d, "documents")
    app = docs.select(text("/p/app/a", k, ".ts").alias("path"), F.concat(F.lit("import { x } from '"), spec, F.lit("';\n")).alias("content"))
    there = docs.where("doc_id % 4 < 2").select(F.when(k % 4 == 0, text("/p/src/util/m", k, ".ts")).otherwise(text("/p/src/other/m", k, ".tsx")).alias("path"), F.lit("").alias("content"))
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ["/p/src/core/main.ts", "/p/packages/pkg3/src/index.ts"]))).alias("path"), F.lit("").alias("content"))
    return imports.build_edges(app.union(there).union(more), "/p", aliases_of(_TSCONFIG, "/p"))


@query("SELECT 'p/m' || doc_id || '.py' AS from_file, 'p/' || CASE WHEN doc_id % 3 = 0 THEN 'sub/n' ELSE 'm' END || (doc_id + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END) || CASE WHEN doc_id % 3 = 0 THEN '.ts' ELSE '.py' END AS to_file FROM documents WHERE doc_id % 3 = 0")
def python_imports(spark, d):
    """Python modules as relative paths; only endings of scripts are tried, so an import of a Python module finds no file."""
    k = F.col("doc_id").cast("string")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("import os\nfrom sub.n"), k, F.lit(" import a, b\n    import hidden\n"))).otherwise(F.concat(F.lit("import m"), (F.col("doc_id") + 1).cast("string"), F.lit("\n")))
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("p/m"), k, F.lit(".py")).alias("path"), body.alias("content")).union(docs.select(F.concat(F.lit("p/sub/n"), k, F.lit(".ts")), F.lit("")))
    return imports.build_edges(files)


# scripts of many kinds

_SCRIPTS = [
    # source, and per chunk: kind, name, first and last line
    ("export class S{k} {{\n  static make = (x: number) => x;\n  get size() {{ return 1 }}\n  constructor(private a: string) {{\n  }}\n  async *run<T>(x: T) {{\n    yield x;\n  }}\n}}", [("class", "S{k}", 1, 9), ("method", "S{k}.constructor", 4, 5), ("method", "S{k}.make", 2, 2), ("method", "S{k}.run", 6, 8), ("method", "S{k}.size", 3, 3)]),
    ("export default async function main{k}(a = {{}}) {{\n  if (a) {{ return /[{{]/.test('x') }}\n}}", [("function", "main{k}", 1, 3)]),
    ("// f{k}\nexport const a{k} = async (x) => {{\n  return x;\n}}, b{k} = 3;\nconst c{k} = function () {{ return '}}' }};", [("function", "a{k}", 2, 4), ("function", "c{k}", 5, 5)]),
    ("export interface I{k} {{\n  f(x: string): void;\n}}\nexport function g{k}(x: I{k}) {{\n  return `${{x.f('`')}}`;\n}}\nfunction g{k}(y) {{}}", [("interface", "I{k}", 1, 3), ("function", "g{k}", 4, 6), ("function", "g{k}", 7, 7)]),
    ("const x{k} = 1;\nlet y = [x{k}];", [("module", None, 1, 2)]),
    ("function broken{k}( {{\n  return 1;\n", [("function", "broken{k}", 1, 3)]),
]


def _script_sql() -> str:
    rows, n = [], len(_SCRIPTS)
    for i, (_, found) in enumerate(_SCRIPTS):
        seen = {}
        for kind, name, a, z in found:
            seen[name] = seen.get(name, 0) + 1
            of = lambda x: "'" + x.replace("{k}", "' || doc_id || '") + "'"
            mark = of(name + ("" if seen[name] == 1 else f"__{seen[name]}")) if name else "'module'"
            rows.append(f"SELECT doc_id || '.ts::' || {mark} AS id, '{kind}' AS kind, {of(name) if name else 'NULL'} AS name, {a} AS start_line, {z} AS end_line FROM documents WHERE doc_id % {n} = {i}")
    return " UNION ALL ".join(rows)


@query(_script_sql())
def chunk_scripts(spark, d):
    """Classes with accessors, arrow properties and generators, default exports, several declarations, repeated names, no declarations, and broken syntax."""
    k, content = F.col("doc_id"), F.lit(None).cast("string")
    for i, (source, _) in enumerate(_SCRIPTS):
        parts = source.replace("{{", "{").replace("}}", "}").split("{k}")
        text = F.concat(*[x for j, p in enumerate(parts) for x in ([k.cast("string")] if j else []) + [F.lit(p)]])
        content = F.when(k % len(_SCRIPTS) == i, text).otherwise(content)
    files = table(spark, d, "documents").select(F.concat(k.cast("string"), F.lit(".ts")).alias("path"), content.alias("content"))
    return chunking.chunk_files(files).select("id", "kind", "name", "start_line", "end_line")


@query("SELECT doc_id || '.js::' || name AS id, kind, name, a AS start_line, z AS end_line FROM documents, (SELECT unnest([{'kind': 'function', 'name': 'f', 'a': 2, 'z': 2}, {'kind': 'class', 'name': 'K', 'a': 3, 'z': 4}, {'kind': 'function', 'name': 'g', 'a': 5, 'z': 5}, {'kind': 'function', 'name': 'h', 'a': 6, 'z': 7}], recursive := true))")
def chunk_script_rules(spark, d):
    """Line rules for scripts whose syntax can't be read."""
    source = "// first\nexport async function f(x) {\nexport abstract class K extends L {\n  m() {}\nconst g = async (x) => x\nexport const h = function (y) {\n"
    files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.lit(source).alias("content"))
    return chunking.chunk_files(files).select("id", "kind", "name", "start_line", "end_line")


def _by_rule(content: str, rule: str, kind: str, group: int, end: str) -> str:
    """Chunks from each line that rule matches to the next, of documents with content as text."""
    name = f"regexp_extract(arg_min(line, i), '{rule}', {group})"
    mark = f"regexp_replace({name}, '\\s+', '_', 'g')" if kind == "section" else name
    return f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split({content}, {NL}) AS x FROM documents)),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{rule}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)
SELECT doc_id || '{end}::' || CASE WHEN k = 0 THEN 'module' ELSE {mark} END AS id, CASE WHEN k = 0 THEN 'module' ELSE '{kind}' END AS kind, CASE WHEN k > 0 THEN {name} END AS name, min(i)::INT AS start_line, max(i)::INT AS end_line, md5(string_agg(line, {NL} ORDER BY i)) AS digest FROM m WHERE k > 0 OR doc_id NOT IN (SELECT doc_id FROM m WHERE k > 0) GROUP BY doc_id, k"""


def _chunked(spark: SparkSession, d: str, mark: str, end: str) -> DataFrame:
    """Documents as files in which what follows a full stop begins a line with mark."""
    content = F.replace("text", F.lit(". "), F.lit(f".\n{mark} "))
    files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(end)).alias("path"), content.alias("content"))
    return chunking.chunk_files(files).select("id", "kind", "name", "start_line", "end_line", F.md5("content").alias("digest"))


@query(_by_rule(f"replace(text, '. ', '.' || {NL} || '## ')", r"^#{1,3}\s+(.+)", "section", 1, ".md"))
def chunk_markdown_texts(spark, d):
    """Whole documents with a heading for each sentence."""
    return _chunked(spark, d, "##", ".md")


@query(_by_rule(f"replace(text, '. ', '.' || {NL} || 'async def ')", r"^(async\s+)?def\s+(\w+)", "function", 2, ".py"))
def chunk_python_texts(spark, d):
    """Whole documents with a function for each sentence."""
    return _chunked(spark, d, "async def", ".py")


# indexing, store, streams


@query(
    f"SELECT doc_id || '.md::' || CASE WHEN doc_id % 5 = 0 THEN 'New_' ELSE 'Old_' END || doc_id AS id, 'section' AS kind, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS updated_at, {SIGN.format('(CASE WHEN doc_id % 5 = 0 THEN ' + chr(39) + 'New ' + chr(39) + ' ELSE ' + chr(39) + 'Old ' + chr(39) + ' END || doc_id || ' + chr(39) + ' ' + chr(39) + ' || left(' + chr(39) + '# ' + chr(39) + ' || CASE WHEN doc_id % 5 = 0 THEN ' + chr(39) + 'New ' + chr(39) + ' ELSE ' + chr(39) + 'Old ' + chr(39) + ' END || doc_id || chr(10) || text, 512))')} AS sign FROM documents"
)
def index_project(spark, d):
    """Two runs over documents as Markdown files: in the second, every fifth is new or changed and replaces its chunks."""
    k = F.col("doc_id").cast("string")
    file = lambda word, mtime: table(spark, d, "documents").select(F.concat(k, F.lit(".md")).alias("path"), F.lit(mtime).cast("long").alias("mtime"), F.concat(F.lit(f"# {word} "), k, F.lit("\n"), F.col("text")).alias("content"), "doc_id")
    old = file("Old", 1).where("doc_id % 10 <> 0")
    first, meta = indexing.chunk_rows(old, 1, 1), indexing.file_rows(old)
    now = file("Old", 1).where("doc_id % 5 <> 0").union(file("New", 2).where("doc_id % 5 = 0"))
    changed = indexing.changed_files(now.drop("doc_id"), meta)
    second = indexing.replaced(first, indexing.chunk_rows(changed, 2, 10**9), changed.select(F.col("path").alias("file_path")))
    return second.select("id", "kind", F.col("updated_at").cast("int").alias("updated_at"), "sign")


def _write_file(spark: SparkSession, path: str, text: str, mtime: int) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.setTimes(at, mtime * 1000, -1)


def _tree(spark: SparkSession, d: str) -> tuple[str, Project]:
    """A project of a script for each nation and each region, beside files that don't count; in the shared folder."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    _write_file(spark, f"{root}/tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@r/*": ["lib/*"]}}}', 1)
    _write_file(spark, f"{root}/node_modules/x/index.ts", "export function no() {}\n", 1)
    _write_file(spark, f"{root}/notes.txt", "no", 1)
    for r in table(spark, d, "region").collect():  # a file a region
        _write_file(spark, f"{root}/lib/r{r['r_regionkey']}.ts", f"export function region{r['r_regionkey']}() {{\n  return '{r['r_name']}';\n}}\n", 1)
    for r in table(spark, d, "nation").collect():  # a file a nation
        _write_file(spark, f"{root}/src/[n]{r['n_nationkey']}.ts", f"import {{ x }} from '@r/r{r['n_regionkey']}';\nexport const nation{r['n_nationkey']} = () => x;\n", 1)
    return root, Project(spark, root.removeprefix("file://"), f"{root}-store", clock=lambda: 5)


def _done(spark: SparkSession, root: str, out: DataFrame) -> DataFrame:
    """out as a table, without the folders that it comes from."""
    out = materialized(out)
    delete(spark, root)
    delete(spark, f"{root}-store")
    return out


@query("SELECT 'lib/r' || r_regionkey || '.ts::region' || CASE WHEN r_regionkey = 1 THEN 'X' ELSE r_regionkey::VARCHAR END AS id, 'function' AS kind, 1 AS start_line, 3 AS end_line FROM region UNION ALL SELECT 'src/[n]' || n_nationkey || '.ts::nation' || n_nationkey, 'function', 2, 2 FROM nation WHERE n_nationkey <> 3")
def index_tree(spark, d):
    """Real files: listed, read, chunked and stored; then one changes and one goes, and only the changed one is read."""
    root, p = _tree(spark, d)
    p.index()
    _write_file(spark, f"{root}/lib/r1.ts", "export function regionX() {\n  return 1;\n}\n", 2)
    delete(spark, f"{root}/src/[n]3.ts")
    done = p.index(prune_deleted=True)
    assert done["chunks"] == 1, done
    own = len(p.root) + 2
    return _done(spark, root, p.store.read("chunks").select(F.substring("id", own, 10_000).alias("id"), "kind", "start_line", "end_line"))


@query("SELECT 'lib/r' || r_regionkey || '.ts::region' || CASE WHEN r_regionkey = 2 THEN 'Y' ELSE r_regionkey::VARCHAR END AS id, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey + 100 END AS git_updated_at FROM region")
def index_file(spark, d):
    """One file again, whose time hasn't changed; a run over the tree leaves it alone, and its git time is forgotten."""
    root, p = _tree(spark, d)
    times = table(spark, d, "region").select(F.concat(F.lit(f"{p.root}/lib/r"), F.col("r_regionkey").cast("string"), F.lit(".ts")).alias("path"), (F.col("r_regionkey") + 100).cast("long").alias("git_updated_at"))
    p.index(times)
    _write_file(spark, f"{root}/lib/r2.ts", "export const regionY = () => 2;\n", 1)
    assert p.index()["chunks"] == 0
    p.index_file(f"{p.root}/lib/r2.ts")
    own = len(p.root) + 2
    meta = p.store.read("file_meta").select(F.col("path").alias("file_path"), "git_updated_at")
    return _done(spark, root, p.store.read("chunks").join(meta, "file_path").select(F.substring("id", own, 10_000).alias("id"), "git_updated_at").where("id like 'lib/%'"))


@query(
    "SELECT 'index' AS command, 'Indexed 30 files, 30 chunks.' AS text UNION ALL SELECT 'graph', 'Graph rebuilt for 30 files.' UNION ALL SELECT 'impact', '## Impact of `/lib/r0.ts`' || chr(10) || '**Risk: ' || CASE WHEN n * 10 >= 60 THEN 'CRITICAL' WHEN n * 10 >= 30 THEN 'HIGH' ELSE 'MEDIUM' END || ' (' || least(100, n * 10) || '/100)**' || chr(10) || '**Direct dependents (' || n || '):**' || chr(10) || files || chr(10) || 'No test files affected.' "
    "FROM (SELECT count(*) AS n, string_agg('- `/src/[n]' || n_nationkey || '.ts`', chr(10) ORDER BY '/src/[n]' || n_nationkey || '.ts`') AS files FROM nation WHERE n_regionkey = 0) UNION ALL SELECT 'memory', 'No relevant memories found.' UNION ALL SELECT 'checkpoint', 'No checkpoints saved yet.'"
)
def command_line(spark, d):
    """What the command line says of a project of real files."""
    from ..__main__ import parser, run

    root, p = _tree(spark, d)
    say = lambda *x: run(p, parser().parse_args([p.root, *x])).replace(p.root, "")
    said = [("index", say("index")), ("graph", say("graph")), ("impact", say("impact", f"{p.root}/lib/r0.ts")), ("memory", say("memory", "recall", "x")), ("checkpoint", say("checkpoint", "get"))]
    return _done(spark, root, spark.createDataFrame(said, "command string, text string"))


@query("SELECT 'src/[n]' || n_nationkey || '.ts' AS from_file, 'lib/r' || n_regionkey || '.ts' AS to_file FROM nation")
def rebuild_graph(spark, d):
    """Edges of real files by the aliases of their tsconfig."""
    root, p = _tree(spark, d)
    p.index()
    p.rebuild_graph()
    own = len(p.root) + 2
    return _done(spark, root, p.store.read("graph_edges").select(F.substring("from_file", own, 10_000).alias("from_file"), F.substring("to_file", own, 10_000).alias("to_file")))


@query("SELECT 'src0' AS file, 'a' AS first, 'query_log' AS log, (SELECT count(*) FROM nation) + 1 AS rows, 3::BIGINT AS versions, 1::BIGINT AS kept")
def store_versions(spark, d):
    """Context set twice, a log appended to, an older folder without a column, and what a vacuum leaves."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    p = Project(spark, "/nowhere", root, clock=lambda: 5)
    p.set_context("a")
    first = p.context_file()
    p.set_context("src0")
    log = table(spark, d, "nation").select(F.col("n_name").alias("query_hash"), F.lit("c").alias("chunk_id"), F.lit("expand").alias("action"))
    log.write.parquet(f"{root}/query_log/data-0")  # as before there was a time
    _write_file(spark, f"{root}/query_log/version-000000000001", "data-0", 1)
    p.store.append("query_log", feedback.expand_event(spark, "h", "c", 5))
    p.store.append("query_log", feedback.expand_event(spark, "h", "c", 6).limit(0))
    n, versions = p.store.read("query_log").select(TABLES["query_log"].names).count(), len(p.store.versions("query_log"))
    p.store.vacuum()
    out = [(p.context_file(), first, "query_log", n, versions, len(p.store.versions("query_log")))]
    delete(spark, root)
    return spark.createDataFrame(out, "file string, first string, log string, rows long, versions long, kept long")


@query("SELECT doc_id || '::module' AS id, md5(text) AS digest FROM documents")
def stream_index(spark, d):
    """Documents that arrive as a stream of files, each batch replacing its files' chunks and times; a second run from the checkpoint finds nothing new."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    p = Project(spark, "/nowhere", f"{root}/store", clock=lambda: 5)
    arriving = spark.readStream.schema(table(spark, d, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parque[t]")
    files = arriving.select(F.col("doc_id").cast("string").alias("path"), F.lit(1).cast("long").alias("mtime"), F.col("text").alias("content"))
    for _ in range(2):
        index_stream(p, f"{root}/checkpoint", files=files).awaitTermination()
    meta = p.store.read("file_meta").where("mtime = 1").select(F.col("path").alias("file_path"))
    return p.store.read("chunks").join(meta, "file_path").select("id", F.md5("content").alias("digest"))


@query(oracle_sql()["vector_topk"])
def vector_topk_groups(spark, d):
    """The nearest vectors from groups around centres, of which those that can't hold one are not read."""
    at = f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}"
    own = table(spark, d, "embeddings").select("vec_id", "embedding")
    groups.write_groups(own, at, 64)
    found, _ = groups.top_k(spark, at, own.where("vec_id = 0").first()["embedding"], 10, "vec_id")
    return found.select("vec_id", r6("score").alias("score"))


@query(f"SELECT doc_id || '::module' AS id, source AS file, bm25 FROM (SELECT id::BIGINT AS doc_id, bm25 FROM ({oracle_sql()['bm25_scores']})) JOIN documents USING (doc_id) ORDER BY bm25 DESC, doc_id || '::module' LIMIT 10")
def index_ranked(spark, d):
    """The best chunks of an index that keeps postings; every ninth document had other words before and was replaced."""
    root = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    p = Project(spark, "/nowhere", f"{root}/store", clock=lambda: 5, ranked=True)
    docs = table(spark, d, "documents")
    ninth = F.col("doc_id") % 9 == 0
    for rows, text in ((docs, F.when(ninth, F.repeat(F.lit(f"{QUERY} "), F.lit(20))).otherwise(F.col("text"))), (docs.where(ninth), F.col("text"))):
        p.store.read("file_meta")
        p._replace(rows.select(F.col("doc_id").cast("string").alias("path"), F.lit(1).cast("long").alias("mtime"), text.alias("content")), None)
    source = docs.select(F.col("doc_id").cast("string").alias("file_path"), F.col("source").alias("file"))
    return p.rank(QUERY, 10).join(source, "file_path").select("id", "file", r6("bm25").alias("bm25"))


class _Dies(Store):
    """A writer that is gone before its change counts."""

    def _put(self, text: str, *parts: str) -> bool:
        if parts[0] == "commits" and text == "done":
            raise InterruptedError
        return super()._put(text, *parts)


@query("SELECT doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN 3 ELSE 1 END::BIGINT AS mtime, md5(CASE WHEN doc_id % 5 = 0 THEN 'new ' WHEN doc_id % 7 = 0 THEN 'newer ' ELSE '' END || text) AS digest FROM documents WHERE doc_id % 11 <> 0")
def store_replace(spark, d):
    """Chunks and times of documents as files, replaced together: every seventh, every fifth, and every eleventh by none; one writer dies before its change counts."""
    root = f"{shared_folder(spark)}/replace-{uuid.uuid4().hex}"
    store, dies = Store(spark, root), _Dies(spark, root)

    def parts(rows: DataFrame, mtime: int, word: str, keep: str = "true") -> dict:
        path = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
        own = rows.select("doc_id", path.alias("file_path"), F.concat(F.lit(word), "text").alias("content"))
        empty = {f.name: F.lit(None).cast(f.dataType) for f in TABLES["chunks"]}
        chunks_ = own.select(*[F.col(c) if c in own.columns else empty[c].alias(c) for c in empty if c != "id"], F.concat("file_path", F.lit("::module")).alias("id"))
        times = own.select(F.col("file_path").alias("path"), F.lit(mtime).cast("long").alias("mtime"), F.lit(None).cast("long").alias("git_updated_at"))
        return {"chunks": (chunks_.where(keep), own.select("file_path")), "file_meta": (times.where(keep), own.select(F.col("file_path").alias("path")))}

    docs = table(spark, d, "documents")
    store.replace(parts(docs, 1, ""))
    store.replace(parts(docs.where("doc_id % 7 = 0"), 3, "newer "))
    for s in (dies, store):
        try:
            s.replace(parts(docs.where("doc_id % 5 = 0"), 2, "new ") if s is store else parts(docs, 9, "lost "))
        except InterruptedError:
            assert s is dies
    store.replace(parts(docs.where("doc_id % 11 = 0"), 0, "", "false"))
    chunks_ = store.read("chunks").select(F.col("file_path").alias("path"), F.md5("content").alias("digest"))
    return chunks_.join(store.read("file_meta"), "path").select("path", "mtime", "digest")


@query(oracle_sql()["bm25_scores"])
def bm25_postings(spark, d):
    """BM25 of all chunks from a table of postings, of which only the query's terms are read, and one of lengths."""
    terms = materialized(postings.postings(chunks(spark, d), "id"))
    lengths = materialized(postings.with_lengths(chunks(spark, d)).select("id", "tokens", "length"))
    return postings.bm25_scores(terms, lengths, QUERY).select("id", F.round("bm25", 6).alias("bm25"))


# backends and history


@query("SELECT doc_id, length(left(text, 8000))::DOUBLE AS n, (length(left(text, 8000)) - length(replace(left(text, 8000), 'e', '')))::DOUBLE AS e FROM documents")
def embed_client(spark, d):
    """Embeddings by a client of the caller's, which sees at most 8,000 characters of a text."""
    embed = vectors.hosted_by(lambda texts: [[len(t), t.count("e")] for t in texts])
    out = table(spark, d, "documents").select("doc_id", embed("text").alias("v"))
    return out.select("doc_id", F.get("v", F.lit(0)).alias("n"), F.get("v", F.lit(1)).alias("e"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'chosen' WHEN r_regionkey = 1 THEN 'hosted' ELSE 'local' END AS backend FROM region")
def backend_choice(spark, d):
    key = F.col("r_regionkey").cast("long")
    return table(spark, d, "region").select(key.alias("r_regionkey"), vectors.backend_choice(F.when(key % 2 == 0, "chosen"), key == 1).alias("backend"))


@query("SELECT '/r/' || r_name AS path, 100 - (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS git_updated_at FROM region")
def git_recency(spark, d):
    """A history in which each nation is a commit, newest first, of the file of its region."""
    key = F.col("n_nationkey").cast("long")
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("/r/"), "r_name").alias("path"))
    return newest_times(table(spark, d, "nation").join(names, "n_regionkey").select("path", key.alias("place"), (100 - key).alias("at")))


@query("SELECT 'n' || l_partkey % 500 || '.ts' AS path, arg_max(epoch(o_orderdate)::BIGINT, o_orderkey) AS git_updated_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def git_recency_of_parts(spark, d):
    """A history in which each order is a commit, the greatest key newest, of the files of its parts."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (-F.col("o_orderkey")).alias("place"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("at"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("n"), (F.col("l_partkey") % 500).cast("string"), F.lit(".ts")).alias("path"))
    return newest_times(lines.join(orders, "l_orderkey"))
