"""The jobs as queries over a folder of tables: each run twice into a new folder, and its whole output read back; and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import packing
from marlstone.plans.materialize import shared_folder
from marlstone.plans.registry import BM25_TOKENS, LOG, META, QUERY, SEARCH, SIGN, STUB, SUMMARY

from . import context_packs, text_index


def settings(job) -> dict:
    return json.loads(job.CONFIG.read_text())


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks and the postings of the index, as rows of two parts."""
    out = new_folder(spark, "text-index")
    for _ in range(2):
        text_index.run(spark, f"{sf_dir}/documents.parquet", out, settings(text_index))
    chunks, terms = text_index.index(spark, out)
    columns = ["chunk_id", "doc_id", "source", "kind", "name", "start_line", "end_line", "content", "sign", "tokens", "length"]
    return chunks.select(F.lit("chunk").alias("part"), *columns).unionByName(terms.select(F.lit("posting").alias("part"), "chunk_id", "doc_id", "term", "frequency"), allowMissingColumns=True)


def job2_context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed texts and the reports of the tasks, as rows of two parts."""
    out = new_folder(spark, "context-packs")
    for _ in range(2):
        context_packs.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "events", "conversations")), out, settings(context_packs))
    packs, reports = context_packs.output(spark, out)
    packs = packs.withColumn("score", F.round("score", 6)).withColumnRenamed("content", "text")
    return packs.select(F.lit("pack").alias("part"), "task", "rank", "id", "file_path", "tier", "score", "tokens", "text").unionByName(reports.select(F.lit("report").alias("part"), "task", "text"), allowMissingColumns=True)


NL = "chr(10)"
_HEADING = r"^#{1,3}\s+(.+)"

JOB1 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(coalesce(text, '')) DESC, coalesce(text, '') DESC, coalesce(source, '') DESC) = 1),
l AS (SELECT doc_id, source, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, source, string_split(text, {NL}) AS x FROM d)),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_HEADING}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k, bool_or(regexp_matches(line, '{_HEADING}')) OVER (PARTITION BY doc_id) AS headed FROM l),
c AS MATERIALIZED (SELECT doc_id || ':' || min(i) AS chunk_id, doc_id, any_value(source) AS source, CASE WHEN k = 0 THEN 'module' ELSE 'section' END AS kind, CASE WHEN k > 0 THEN regexp_extract(arg_min(line, i), '{_HEADING}', 1) END AS name, min(i)::INT AS start_line, max(i)::INT AS end_line, string_agg(line, {NL} ORDER BY i) AS content FROM m WHERE k > 0 OR NOT headed GROUP BY doc_id, k),
t AS MATERIALIZED (SELECT *, {BM25_TOKENS.format("coalesce(name, '')")} AS a, {BM25_TOKENS.format('content')} AS b FROM c)
SELECT 'chunk' AS part, chunk_id, doc_id, source, kind, name, start_line, end_line, content, {SIGN.format("(coalesce(name, kind) || ' ' || substring(content, 1, 512))")} AS sign, len(b)::INT AS tokens, (len(a) + len(b))::INT AS length, NULL AS term, NULL AS frequency FROM t
UNION ALL SELECT 'posting', chunk_id, doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, term, count(*) FROM (SELECT chunk_id, doc_id, unnest(list_concat(a, b)) AS term FROM t) GROUP BY chunk_id, doc_id, term"""


def _task_sql(task: dict, notes: int) -> str:
    q, top = task["query"], task["top_k"]
    search = SEARCH.replace(META, "(SELECT NULL::VARCHAR AS path, NULL::BIGINT AS git_updated_at)").replace("d.source AS file_path", "coalesce(d.source, '') AS file_path")
    search = search.replace(QUERY, q).replace("LIMIT 30", f"LIMIT {3 * top}").replace("LIMIT 10", f"LIMIT {top}")
    if budget := task.get("token_budget"):
        header = "(length('### ' || file_path || ':1') + 10)"
        tiers = f"""z AS (SELECT rank, length(content) + {header} AS a, length({SUMMARY}) + {header} AS b, length({STUB}) + {header} AS c FROM res),
w(rank, tier, rest) AS (SELECT 0::BIGINT, '', {budget * 4 - 200}::BIGINT UNION ALL SELECT z.rank, CASE WHEN a <= rest THEN 'full' WHEN b <= rest THEN 'summary' WHEN c <= rest THEN 'stub' ELSE 'dropped' END, rest - CASE WHEN a <= rest THEN a WHEN b <= rest THEN b WHEN c <= rest THEN c ELSE 0 END FROM w JOIN z ON z.rank = w.rank + 1),
p0 AS (SELECT res.*, w.tier FROM res JOIN w USING (rank))"""
    else:
        full, short = packing.DENSITIES[task.get("density", "balanced")]
        tiers = f"p0 AS (SELECT *, CASE WHEN score >= {full} THEN 'full' WHEN score >= {short} THEN 'summary' WHEN score >= {packing.LEAST_STUB} THEN 'stub' ELSE 'dropped' END AS tier FROM res)"
    return f"""SELECT * FROM (WITH RECURSIVE {search}, {tiers},
p AS (SELECT rank, id, file_path, score, tier, CASE tier WHEN 'summary' THEN {SUMMARY} WHEN 'stub' THEN {STUB} ELSE content END AS content FROM p0),
t AS (SELECT rank, CASE WHEN score >= 0.65 THEN 1 WHEN score >= 0.35 THEN 2 ELSE 3 END AS band, '### ' || file_path || ':1' || {NL} || '```' || {NL} || content || {NL} || '```' || {NL} AS s FROM p WHERE tier <> 'dropped'),
s AS (SELECT 0 AS band, 0 AS rank, '# Context: {q}' || {NL} AS s UNION ALL SELECT band, 0, '## ' || ['High', 'Medium', 'Low'][band] || {NL} FROM t GROUP BY band UNION ALL SELECT band, rank, s FROM t UNION ALL SELECT 9, 0, {NL} || '*' || count(*) || ' lower-scoring chunk(s) omitted — narrow query or increase token_budget to see them.*' || {NL} FROM p WHERE tier = 'dropped' HAVING count(*) > 0),
x AS (SELECT string_agg(s, {NL} ORDER BY band, rank) AS context, (SELECT count(*) FROM t) AS shown, (SELECT count(*) FROM p WHERE tier = 'dropped') AS dropped FROM s),
m AS (SELECT text AS content, conv_id AS created_at, conv_id * 1000 + turn AS seq, ({SIGN.format('text')} * {SIGN.format(f"'{q}'")})::DOUBLE AS score FROM conversations WHERE role = 'user' AND text IS NOT NULL ORDER BY score DESC, created_at DESC, seq LIMIT {notes}),
n AS (SELECT '## Memories from past sessions' || {NL} || {NL} || string_agg('- [' || printf('%.2f', score) || '] ' || content || ' *(user)*', {NL} ORDER BY score DESC, created_at DESC, seq) AS notes, count(*) AS k FROM m),
b AS (SELECT notes || {NL} || {NL} || context AS body, k, shown, dropped FROM n, x)
SELECT 'pack' AS part, '{task["name"]}' AS task, rank, id, file_path, tier, round(score, 6) AS score, ceil(length(content) / 4)::BIGINT AS tokens, content AS text FROM p WHERE tier <> 'dropped'
UNION ALL SELECT 'report', '{task["name"]}', NULL, NULL, NULL, NULL, NULL, NULL, body || {NL} || {NL} || '---' || {NL} || '*~' || ceil(length(body) / 4)::BIGINT || ' tokens | ' || k || ' memories | ' || shown || ' chunks' || CASE WHEN dropped > 0 THEN ' | ' || dropped || ' dropped' ELSE '' END || '*' FROM b)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_text_index, job2_context_packs)}


def oracle_sql() -> dict[str, str]:
    own = settings(context_packs)
    return {"job1_text_index": JOB1, "job2_context_packs": " UNION ALL ".join(_task_sql(t, own["notes"]) for t in own["tasks"])}
