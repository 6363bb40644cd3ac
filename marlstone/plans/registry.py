"""Named queries over a folder of tables, and for each the SQL that states it.

The tables stand in for a project: documents are chunks (source is the file), embeddings are stored vectors, events are
the feedback log (a click expands the chunk named by $.k), user turns of conversations are memories and last turns
checkpoints, and foreign keys are dependency edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.vectors import LocalBackend, VectorBackend
from ..operators import chunking, feedback, graph, imports, indexing, memory, packing, rerank, scoring

QUERY = "the ation of erly thing and"
NOW = 1_000_000_000
DAY = 86_400
TOPIC = "onor the erth of ing"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# the tables as a project, on both sides


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file_path"), F.lit("section").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))


def file_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("path")).agg((F.lit(NOW) - F.count("*") * DAY).alias("git_updated_at"), F.max("n_chars").alias("mtime"))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.lit("").alias("query_hash"), F.get_json_object("props", "$.k").alias("chunk_id"), F.when(F.col("event_type") == "click", "expand").otherwise("returned").alias("action"), F.col("event_id").alias("ts"))


def memories(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").where("role = 'user'")
    order = F.col("conv_id") * 1000 + F.col("turn")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.array("role").alias("tags"), (F.col("turn") % 7 == 0).alias("stale"), (F.col("conv_id") % 50).alias("created_at"), F.lit(None).cast("long").alias("last_seen_at"), order.alias("seq"))


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("summary"), F.max("turn").alias("created_at"))
    return last.select(F.col("conv_id").cast("string").alias("id"), "summary", F.array(F.lit("next")).alias("open_tasks"), "created_at", F.col("conv_id").alias("seq"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    def of(name, a, ka, b, kb):
        return table(spark, d, name).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("from_file"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("to_file"))

    parts = [of("orders", "O", "o_orderkey", "C", "o_custkey"), of("customer", "C", "c_custkey", "N", "c_nationkey"), of("supplier", "S", "s_suppkey", "N", "s_nationkey"), of("nation", "N", "n_nationkey", "R", "n_regionkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


EMBED_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]', ' ', 'g'), ' '), lambda t: length(t) BETWEEN 2 AND 40)"
BM25_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9_]', ' ', 'g'), ' '), lambda t: t <> '')"
SIGN = f"sign(coalesce(list_sum(list_transform({EMBED_TOKENS.format('substring({0}, 1, 4096)')}, lambda t: CASE WHEN length(translate(t, '{vectors.EVEN_CODED}', '')) % 2 = 1 THEN 1 ELSE -1 END)), 0))::INT"
EDGES = "(SELECT 'O' || o_orderkey AS f, 'C' || o_custkey AS t FROM orders UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"
LOG = "(SELECT json_extract_string(props, '$.k') AS chunk_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)"
META = f"(SELECT source AS path, {NOW} - count(*) * {DAY} AS git_updated_at FROM documents GROUP BY source)"
MEMORIES = "(SELECT conv_id || '-' || turn AS id, text AS content, conv_id % 50 AS created_at, turn % 7 = 0 AS stale, conv_id * 1000 + turn AS seq FROM conversations WHERE role = 'user')"
TEMPORAL = "greatest(0.0::DOUBLE, 1 - (CASE WHEN coalesce({0}, 0) = 0 THEN 31536000 ELSE " + str(NOW) + " - {0} END)::DOUBLE / 31536000)"
SCORED = f"""scored AS (SELECT d.doc_id::VARCHAR AS id, d.source AS file_path, d.text AS content, d.doc_id AS seq,
  least(1.0::DOUBLE, ({SIGN.format(f"'{QUERY}'")} * {SIGN.format('d.text')})::DOUBLE * 0.65::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE + {TEMPORAL.format('m.git_updated_at')} * 0.15::DOUBLE + least(0.15::DOUBLE, coalesce(l.n, 0) * 0.02::DOUBLE)) AS score
  FROM documents d LEFT JOIN {META} m ON m.path = d.source LEFT JOIN {LOG} l ON l.chunk_id = d.doc_id::VARCHAR)"""


def _bm25(terms: str, average: str) -> str:
    return f"CASE WHEN len({terms}) = 0 THEN 0 ELSE list_sum(list_transform({BM25_TOKENS.format(f"'{QUERY}'")}, lambda q: (SELECT_F({terms}, q)))) END".replace(f"(SELECT_F({terms}, q))", f"len(list_filter({terms}, lambda x: x = q)) * 2.5::DOUBLE / (len(list_filter({terms}, lambda x: x = q)) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len({terms}) / {average})))")


SEARCH = f"""{SCORED},
cand AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rk FROM scored ORDER BY score DESC, seq LIMIT 30),
cut AS (SELECT *, {BM25_TOKENS.format("content")} AS t FROM cand),
terms AS (SELECT *, avg(len(t)) OVER () AS mean FROM cut),
bm AS (SELECT *, {_bm25('t', 'mean')} AS bm25 FROM terms),
norm AS (SELECT *, greatest(max(bm25) OVER (), 1e-9) AS hi, min(bm25) OVER () AS lo FROM bm),
comb AS (SELECT * REPLACE (least(1.0::DOUBLE, 0.7::DOUBLE * score + (1 - 0.7::DOUBLE) * ((bm25 - lo) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END)) AS score) FROM norm),
res AS (SELECT id, file_path, content, score, row_number() OVER (ORDER BY score DESC, rk) AS rank FROM comb ORDER BY score DESC, rk LIMIT 10)"""
LINES = "string_split({0}, chr(10))"
STUB = "(string_split(content, chr(10))[1] || chr(10) || '  // … (chunk_id: ' || id || ')')"
SUMMARY = "array_to_string(list_concat(list_concat([string_split(content, chr(10))[1]], list_filter(string_split(content, chr(10))[2:], lambda l: regexp_matches(l, '^\\s*(//|\\*|#)'))[1:3]), ['  // … ' || len(string_split(content, chr(10))) || ' lines  (chunk_id: ' || id || ')']), chr(10))"


def _signals(spark: SparkSession, d: str) -> dict:
    return {"meta": file_meta(spark, d), "log": query_log(spark, d)}


def _search(spark: SparkSession, d: str) -> DataFrame:
    return scoring.search_context(chunks(spark, d), QUERY, NOW, 10, **_signals(spark, d))


# vectors and text


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)) DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    backend = VectorBackend(e.where("vec_id = 0").first()["embedding"])
    return e.where(backend.embedded()).select("vec_id", backend.similarity().alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", r6("s").alias("score"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", r6(vectors.cosine(F.col("embedding"), F.col("next"))).alias("sim"))


@query("SELECT vec_id, len(v::VARCHAR[]) AS n, round(list_sum(v), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def embedding_json(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.from_json(vectors.to_json(F.col("embedding").cast("array<double>"))).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("n"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"SELECT doc_id, len({EMBED_TOKENS.format('text')}) AS n, md5(array_to_string({EMBED_TOKENS.format('text')}, ' ')) AS digest FROM documents")
def tokenize_embed(spark, d):
    return _tokens(spark, d, text.embed_tokens)


@query(f"SELECT doc_id, len({BM25_TOKENS.format('text')}) AS n, md5(array_to_string({BM25_TOKENS.format('text')}, ' ')) AS digest FROM documents")
def tokenize_bm25(spark, d):
    return _tokens(spark, d, text.bm25_tokens)


def _tokens(spark, d, cut):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array(cut(F.col("text")))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, {SIGN.format('text')} AS sign FROM documents")
def local_embed_sign(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.local_sign(F.col("text")).alias("sign"))


@query(f"SELECT item_id, {SIGN.format('text')} * 0.0625 * 2::DOUBLE AS ends, 256::BIGINT AS n FROM benchmark")
def local_embedding(spark, d):
    t = table(spark, d, "benchmark").select("item_id", vectors.local_embedding(F.col("text")).alias("v"))
    return t.select("item_id", (F.get("v", F.lit(0)) - F.get("v", F.lit(255))).alias("ends"), F.size("v").cast("long").alias("n"))


@query(f"SELECT doc_id, ({SIGN.format('text')} * {SIGN.format(chr(39) + QUERY + chr(39))})::DOUBLE AS sim FROM documents")
def semantic_local(spark, d):
    return table(spark, d, "documents").select("doc_id", LocalBackend(QUERY, "text").similarity().alias("sim"))


@query("SELECT item_id, left(sha256(text), 16) AS hash FROM benchmark")
def query_hash(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.query_hash(F.col("text")).alias("hash"))


@query("SELECT page_id, nullif(regexp_extract(q, '(?:^|\\s)([\\w./\\-@]+\\.(?:ts|tsx|js|jsx|py|md|go|rs))', 1), '') AS path FROM (SELECT page_id, 'fix src/a' || page_id || CASE WHEN page_id % 3 = 0 THEN '.tsx now' WHEN page_id % 3 = 1 THEN '.json now' ELSE ' now' END AS q FROM pages)")
def mentioned_path(spark, d):
    end = F.when(F.col("page_id") % 3 == 0, ".tsx now").when(F.col("page_id") % 3 == 1, ".json now").otherwise(" now")
    return table(spark, d, "pages").select("page_id", text.mentioned_path(F.concat(F.lit("fix src/a"), F.col("page_id").cast("string"), end)).alias("path"))


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, 'section') || ' ' || substring(text, 1, 512)) AS digest FROM documents")
def embed_text(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.embed_text(name, F.lit("section"), F.col("text"))).alias("digest"))


# feedback and signals


@query(f"SELECT chunk_id, n FROM {LOG}")
def expand_counts(spark, d):
    return feedback.expand_counts(query_log(spark, d))


@query(f"SELECT chunk_id, round(least(0.15, n * 0.02), 6)::DOUBLE AS boost FROM {LOG}")
def chunk_boost(spark, d):
    return feedback.chunk_boosts(query_log(spark, d)).select("chunk_id", r6("boost").alias("boost"))


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'expand' ELSE 'returned' END AS action FROM events UNION ALL SELECT 'expand' UNION ALL SELECT unnest(['returned', 'returned'])) GROUP BY action")
def append_feedback(spark, d):
    log = query_log(spark, d).unionByName(feedback.expand_event(spark, "h", "7", NOW)).unionByName(feedback.returned_events(spark, "h", ["1", "2"], NOW))
    return log.groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(greatest(0.0::DOUBLE, 1 - (978307200 - date_diff('second', TIMESTAMP '1970-01-01', o_orderdate))::DOUBLE / 31536000), 6) AS temporal FROM orders")
def temporal_score(spark, d):
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    return table(spark, d, "orders").select("o_orderkey", r6(scoring.temporal_score(at, 978_307_200)).alias("temporal"))


# graph


def _reach(start: str, step: str, most: int) -> str:
    return f"WITH RECURSIVE e AS (SELECT DISTINCT f, t FROM {EDGES}), w(file, depth) AS (SELECT '{start}', 0 UNION SELECT {step} AND w.depth < {most})"


_BACK = "e.f, w.depth + 1 FROM w JOIN e ON e.t = w.file WHERE true"
IMPACT = _reach("R0", _BACK, 5) + ", i AS (SELECT file, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY file)"
HOPS = f"WITH RECURSIVE e AS (SELECT f, t FROM {EDGES} UNION SELECT t, f FROM {EDGES}), w(file, depth) AS (SELECT 'N0', 0 UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON e.f = w.file WHERE w.depth < 4), h AS (SELECT file, min(depth) AS depth FROM w GROUP BY file)"


@query(IMPACT + " SELECT file, depth, regexp_matches(file, '\\.(test|spec)\\.[jt]sx?$') AS is_test FROM i")
def impact_region(spark, d):
    return graph.impact(edges(spark, d), "R0")


@query(IMPACT + " SELECT file, depth FROM i WHERE depth = 1")
def impact_depth1(spark, d):
    return graph.impact(edges(spark, d), "R0", 1).select("file", "depth")


@query(IMPACT + " SELECT direct, transitive, least(100, direct * 10 + transitive * 2) AS score, CASE WHEN direct * 10 + transitive * 2 >= 60 THEN 'critical' WHEN direct * 10 + transitive * 2 >= 30 THEN 'high' WHEN direct * 10 + transitive * 2 >= 10 THEN 'medium' ELSE 'low' END AS label FROM (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive FROM i)")
def risk_region(spark, d):
    return graph.risk(graph.impact(edges(spark, d), "R0"))


@query("WITH c AS (SELECT 'N' || n_nationkey AS file, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS direct, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS transitive FROM nation) SELECT *, least(100, direct * 10 + transitive * 2) AS score, CASE WHEN direct * 10 + transitive * 2 >= 60 THEN 'critical' WHEN direct * 10 + transitive * 2 >= 30 THEN 'high' WHEN direct * 10 + transitive * 2 >= 10 THEN 'medium' ELSE 'low' END AS label FROM c")
def risk_per_nation(spark, d):
    roots = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("file"))
    return graph.risks(edges(spark, d), roots)


@query(HOPS + " SELECT s AS file, coalesce(depth, 5) AS distance FROM (SELECT 'S' || s_suppkey AS s FROM supplier) LEFT JOIN h ON h.file = s")
def graph_distance(spark, d):
    files = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("file"))
    return graph.with_distance(files, edges(spark, d), "N0")


@query(HOPS + " SELECT s AS file, CASE coalesce(depth, 5) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 ELSE 0.0 END::DOUBLE AS structural FROM (SELECT 'C' || c_custkey AS s FROM customer) LEFT JOIN h ON h.file = s")
def structural_score(spark, d):
    files = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("file"))
    return graph.with_distance(files, edges(spark, d), "N0").select("file", scoring.structural_score(F.col("distance")).alias("structural"))


@query(f"SELECT f AS file FROM {EDGES} WHERE t = 'N1'")
def direct_dependents(spark, d):
    return graph.direct_dependents(edges(spark, d), "N1")


@query(f"SELECT t AS file FROM {EDGES} WHERE f = 'C1'")
def dependencies(spark, d):
    return graph.dependencies(edges(spark, d), "C1")


@query("SELECT 'n' || s_nationkey AS from_file, 'p' || l_partkey % 50 AS to_file FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def distinct_edges(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return graph.distinct_edges(t.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("from_file"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("to_file")))


@query("SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY ALL")
def extract_links(spark, d):
    t = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return t.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, '/p/src/' || CASE WHEN doc_id % 10 = 0 THEN 'g' || doc_id || '/index' ELSE 'm' || doc_id END || '.ts' AS path FROM documents),
e AS (SELECT a.path AS f, b.path AS t, b.doc_id AS k FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT f AS from_file, t AS to_file FROM e UNION SELECT e.f, x.t FROM e JOIN e x ON x.f = e.t WHERE e.k % 10 = 0""")
def build_graph(spark, d):
    """Each document as a module that re-exports the next one; every tenth is an index file in a folder of its own."""
    key = F.col("doc_id")
    folder = lambda k: F.when(k % 10 == 0, F.concat(F.lit("g"), k.cast("string"))).otherwise(F.concat(F.lit("m"), k.cast("string")))
    path = F.concat(F.lit("/p/src/"), folder(key), F.when(key % 10 == 0, "/index").otherwise(""), F.lit(".ts"))
    up = F.when(key % 10 == 0, "../").otherwise("./")
    content = F.concat(F.lit("export { x } from '"), up, folder(key + 1), F.lit("';\nimport y from 'outside';\n"))
    return imports.build_edges(table(spark, d, "documents").select(path.alias("path"), content.alias("content")), "/p")


# retrieval and packing


@query(f"WITH {SCORED} SELECT id, round(score, 6) AS score FROM scored")
def search_scored(spark, d):
    return scoring.scored_chunks(chunks(spark, d), QUERY, NOW, **_signals(spark, d)).select("id", r6("score").alias("score"))


@query(f"WITH terms AS (SELECT doc_id, {BM25_TOKENS.format('text')} AS t FROM documents), a AS (SELECT avg(len(t)) AS avg FROM terms) SELECT doc_id::VARCHAR AS id, round({_bm25('t', 'avg')}, 6)::DOUBLE AS bm25 FROM terms, a")
def bm25_scores(spark, d):
    return rerank.bm25_scores(chunks(spark, d), QUERY).select("id", r6("bm25").alias("bm25"))


@query(f"WITH {SEARCH} SELECT id, file_path, rank, round(score, 6) AS score FROM res")
def search_context(spark, d):
    return _search(spark, d).select("id", "file_path", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


def _preset(name: str):
    full, short = packing.DENSITIES[name]

    def run(spark, d):
        return packing.compressed(_search(spark, d), name).where("tier <> 'dropped'").select("id", "tier", F.md5("content").alias("digest"))

    run.__name__ = f"compress_{name}"
    tier = f"CASE WHEN score >= {full} THEN 'full' WHEN score >= {short} THEN 'summary' WHEN score >= 0.15 THEN 'stub' ELSE 'dropped' END"
    query(f"WITH {SEARCH}, p AS (SELECT *, {tier} AS tier FROM res) SELECT id, tier, md5(CASE tier WHEN 'full' THEN content WHEN 'summary' THEN {SUMMARY} ELSE {STUB} END) AS digest FROM p WHERE tier <> 'dropped'")(run)


for _name in packing.DENSITIES:
    _preset(_name)


@query(f"WITH {SEARCH} SELECT id, CASE WHEN score >= 0.65 THEN 'full' WHEN score >= 0.4 THEN 'summary' WHEN score >= 0.15 THEN 'stub' ELSE 'dropped' END AS tier FROM res WHERE id NOT IN ('1', '2', '3', '5', '8')")
def compress_exclude(spark, d):
    return packing.compressed(_search(spark, d), exclude=["1", "2", "3", "5", "8"]).select("id", "tier")


@query(f"WITH {SEARCH} SELECT count(*) FILTER (score < 0.15) AS dropped FROM res")
def compress_dropped(spark, d):
    return packing.dropped_count(packing.compressed(_search(spark, d), "minimal"))


@query(f"WITH {SEARCH} SELECT id, CASE WHEN score >= 0.65 THEN 'High' WHEN score >= 0.35 THEN 'Medium' ELSE 'Low' END AS band FROM res")
def relevance_bands(spark, d):
    return _search(spark, d).select("id", packing.band(F.col("score")).alias("band"))


HEADER = "(length('### ' || file_path || ':1') + 10)"
BUDGET = 1500


@query(
    f"WITH RECURSIVE {SEARCH}, z AS (SELECT rank, id, length(content) + {HEADER} AS a, length({SUMMARY}) + {HEADER} AS b, length({STUB}) + {HEADER} AS c FROM res), "
    f"w(rank, id, tier, rest) AS (SELECT 0::BIGINT, '', '', {BUDGET * 4 - 200}::BIGINT UNION ALL SELECT z.rank, z.id, CASE WHEN a <= rest THEN 'full' WHEN b <= rest THEN 'summary' WHEN c <= rest THEN 'stub' ELSE 'dropped' END, rest - CASE WHEN a <= rest THEN a WHEN b <= rest THEN b WHEN c <= rest THEN c ELSE 0 END FROM w JOIN z ON z.rank = w.rank + 1) "
    "SELECT id, tier FROM w WHERE rank > 0"
)
def compress_budget(spark, d):
    return packing.compressed(_search(spark, d), token_budget=BUDGET).select("id", "tier")


@query(
    f"WITH {SEARCH}, p AS (SELECT *, CASE WHEN score >= 0.65 THEN 'full' WHEN score >= 0.4 THEN 'summary' WHEN score >= 0.15 THEN 'stub' ELSE 'dropped' END AS tier FROM res), "
    f"t AS (SELECT rank, tier, CASE WHEN score >= 0.65 THEN 1 WHEN score >= 0.35 THEN 2 ELSE 3 END AS band, '### ' || file_path || ':1' || chr(10) || '```' || chr(10) || CASE tier WHEN 'full' THEN content WHEN 'summary' THEN {SUMMARY} ELSE {STUB} END || chr(10) || '```' || chr(10) AS s FROM p WHERE tier <> 'dropped'), "
    f"s AS (SELECT 0 AS band, 0 AS rank, '# Context: {QUERY}' || chr(10) AS s UNION ALL SELECT band, 0, '## ' || ['High', 'Medium', 'Low'][band] || chr(10) FROM t GROUP BY band UNION ALL SELECT band, rank, s FROM t UNION ALL SELECT 9, 0, chr(10) || '*' || count(*) || ' lower-scoring chunk(s) omitted — narrow query or increase token_budget to see them.*' || chr(10) FROM p WHERE tier = 'dropped' HAVING count(*) > 0) "
    "SELECT md5(string_agg(s, chr(10) ORDER BY band, rank)) AS digest, (SELECT count(*) FROM t) AS shown FROM s"
)
def render_context(spark, d):
    out = packing.rendered(packing.compressed(_search(spark, d)), QUERY)
    return out.select(F.md5("context").alias("digest"), F.col("shown").cast("long").alias("shown"))


@query(f"SELECT id, md5({STUB}) AS digest FROM (SELECT doc_id::VARCHAR AS id, text AS content FROM documents)")
def make_stub(spark, d):
    return chunks(spark, d).select("id", F.md5(packing.stub(F.col("content"), F.col("id"))).alias("digest"))


@query(f"SELECT id, md5({SUMMARY}) AS digest FROM (SELECT doc_id::VARCHAR AS id, replace(text, '. ', '.' || chr(10) || ' # ') AS content FROM documents)")
def make_summary(spark, d):
    c = chunks(spark, d).select("id", F.replace("content", F.lit(". "), F.lit(".\n # ")).alias("content"))
    return c.select("id", F.md5(packing.summary(F.col("content"), F.col("id"))).alias("digest"))


@query("SELECT doc_id::VARCHAR AS id, source AS file_path, md5(text) AS digest FROM documents WHERE doc_id = 7")
def expand_chunk(spark, d):
    return chunks(spark, d).where("id = '7'").select("id", "file_path", F.md5("content").alias("digest"))


# memory


@query(f"SELECT id, created_at, stale FROM {MEMORIES}")
def memory_list(spark, d):
    return memory.newest_first(memories(spark, d)).select("id", "created_at", "stale")


RECALL = f"(SELECT *, ({SIGN.format('content')} * {SIGN.format(chr(39) + TOPIC + chr(39))})::DOUBLE AS score FROM {MEMORIES} ORDER BY score DESC, created_at DESC, seq LIMIT 5)"


@query(f"SELECT id, score, stale FROM {RECALL}")
def memory_recall(spark, d):
    return memory.recall(memories(spark, d), LocalBackend(TOPIC)).select("id", "score", "stale")


@query(f"SELECT id, CASE WHEN id IN (SELECT id FROM {RECALL}) THEN {NOW} END::BIGINT AS last_seen_at FROM {MEMORIES}")
def memory_touch(spark, d):
    m = memories(spark, d)
    return memory.touched(m, memory.recall(m, LocalBackend(TOPIC)), NOW).select("id", "last_seen_at")


@query(f"SELECT id FROM {MEMORIES} WHERE id <> '1-1'")
def memory_delete(spark, d):
    return memory.deleted(memories(spark, d), "1-1").select("id")


@query(f"WITH c AS (SELECT {SIGN.format('text')} AS s FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 500)), m AS (SELECT id, {SIGN.format('content')} AS s FROM {MEMORIES} WHERE NOT stale), b AS (SELECT id, greatest(0, (SELECT max(m.s * c.s) FROM c))::DOUBLE AS best FROM m) SELECT id, best, best < 0.4 AS marked FROM b")
def memory_audit(spark, d):
    m = memories(spark, d).withColumn("embedding", vectors.local_embedding(F.col("content")))
    first = table(spark, d, "documents").orderBy("doc_id").limit(memory.CHUNK_LIMIT).select(F.col("doc_id").alias("seq"), vectors.local_embedding(F.col("text")).alias("embedding"))
    return memory.audit(m, first).select("id", r6("best").alias("best"), "marked")


@query("SELECT conv_id::VARCHAR AS id, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 1")
def checkpoint_latest(spark, d):
    return memory.latest_checkpoint(checkpoints(spark, d)).select("id", F.md5("summary").alias("digest"))


@query("SELECT conv_id::VARCHAR AS id, md5(arg_max(text, turn)) AS digest, max(turn) AS created_at FROM conversations GROUP BY conv_id")
def checkpoint_list(spark, d):
    return memory.checkpoint_list(checkpoints(spark, d)).select("id", F.md5("summary").alias("digest"), "created_at")


# chunking and indexing

RULE = r"^(\S+( \S+){0,2})\.$"
_HITS = f"""l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{RULE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)"""


@query(f"WITH {_HITS} SELECT doc_id::VARCHAR AS file_path, CASE WHEN k = 0 THEN 'module' ELSE 'section' END AS kind, CASE WHEN k > 0 THEN regexp_extract(arg_min(line, i), '{RULE}', 1) END AS name, min(i)::INT AS start_line, max(i)::INT AS end_line, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM m WHERE k > 0 OR doc_id NOT IN (SELECT doc_id FROM m WHERE k > 0) GROUP BY doc_id, k")
def chunk_regex(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return chunking.chunks_by_rules(files, ((RULE, "section", 1),)).select("file_path", "kind", "name", "start_line", "end_line", F.md5("content").alias("digest"))


@query("SELECT doc_id || '::module' AS id, len(string_split(text, chr(10)))::INT AS end_line, md5(text) AS digest FROM documents")
def chunk_module(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return chunking.chunks_as_module(files).select("id", "end_line", F.md5("content").alias("digest"))


_SOURCES = {
    ".md": ("concat('intro', chr(10), '# Doc ', {k}, chr(10), 'body', chr(10), '## part two', chr(10), 'end')", "SELECT k || '.md::Doc_' || k AS id, 'section' AS kind, 'Doc ' || k AS name, 2 AS a, 3 AS b FROM d UNION ALL SELECT k || '.md::part_two', 'section', 'part two', 4, 5 FROM d"),
    ".py": ("concat('import os', chr(10), 'async def f', {k}, '(x):', chr(10), '    return x', chr(10), 'class K:', chr(10), '    def m(self): pass')", "SELECT k || '.py::f' || k AS id, 'function' AS kind, 'f' || k AS name, 2 AS a, 3 AS b FROM d UNION ALL SELECT k || '.py::K', 'class', 'K', 4, 5 FROM d"),
    ".ts": ("concat('export function f', {k}, '(a: string) {{', chr(10), '  return `}}`;', chr(10), '}}', chr(10), 'class K {{', chr(10), '  run() {{ return 1 }}', chr(10), '}}')", "SELECT k || '.ts::f' || k AS id, 'function' AS kind, 'f' || k AS name, 1 AS a, 3 AS b FROM d UNION ALL SELECT k || '.ts::K', 'class', 'K', 4, 6 FROM d UNION ALL SELECT k || '.ts::K.run', 'method', 'K.run', 5, 5 FROM d"),
}


def _sources(end: str, name: str):
    content, wanted = _SOURCES[end]

    def run(spark, d):
        files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(end)).alias("path"), F.expr(content.format(k="doc_id").replace("chr(10)", "'\\n'")).alias("content"))
        return chunking.chunk_files(files).select("id", "kind", "name", F.col("start_line").alias("a"), F.col("end_line").alias("b"))

    run.__name__ = name
    query(f"WITH d AS (SELECT doc_id AS k FROM documents) {wanted}")(run)


for _end, _name in ((".md", "chunk_markdown"), (".py", "chunk_python"), (".ts", "chunk_typescript")):
    _sources(_end, _name)


def _files(spark, d):
    """Documents as files, and what an earlier run knew of them: some have changed, some are new."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("mtime"), "text", "doc_id")
    meta = files.where("doc_id % 11 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    return files, meta


@query("SELECT doc_id::VARCHAR AS path, n_chars AS mtime FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0")
def incremental_diff(spark, d):
    files, meta = _files(spark, d)
    return indexing.changed_files(files, meta).select("path", "mtime")


@query("SELECT doc_id || '::module' AS id, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def keyed_replace(spark, d):
    files, meta = _files(spark, d)
    old = files.where("doc_id % 11 <> 0").select(F.concat("path", F.lit("::module")).alias("id"), F.col("path").alias("file_path"), F.lit("old").alias("state"))
    changed = indexing.changed_files(files, meta).select(F.col("path").alias("file_path"))
    new = changed.select(F.concat("file_path", F.lit("::module")).alias("id"), "file_path", F.lit("new").alias("state"))
    return indexing.replaced(old, new, changed).select("id", "state")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_by_key(spark, d):
    return indexing.last_by_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT doc_id, source || '::' || lang || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def unique_ids(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), F.concat("source", F.lit("::"), "lang").alias("id"))
    return indexing.with_unique_ids(t, order="doc_id").select("doc_id", "id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def prune_deleted(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_path"))
    return indexing.pruned(t, t.where("doc_id % 3 <> 0").select(F.col("file_path").alias("path"))).select("doc_id")


@query("SELECT DISTINCT source AS file_path FROM documents")
def distinct_files(spark, d):
    return chunks(spark, d).select("file_path").distinct()


@query(f"SELECT 'chunks' AS name, count(*) AS n FROM documents UNION ALL SELECT 'memories', count(*) FROM {MEMORIES} UNION ALL SELECT 'stale', count(*) FROM {MEMORIES} WHERE stale UNION ALL SELECT 'files', count(DISTINCT source) FROM documents UNION ALL SELECT 'edges', count(*) FROM {EDGES} UNION ALL SELECT 'checkpoints', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'expands', count(*) FROM events WHERE event_type = 'click'")
def index_stats(spark, d):
    return indexing.stats(chunks(spark, d), memories(spark, d), file_meta(spark, d), edges(spark, d), checkpoints(spark, d), query_log(spark, d))
