"""The queries opN_<name> of this subpackage over a folder of tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, langid, license_scan, mixing, ngram_join, pii, run_detection, spiece, substring_dedup, toxicity, url_filter


LICENSES = license_scan.license_texts() | license_scan.TEMPLATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"), LICENSES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_likeness(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encoded(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op12_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_detection.run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard_join, op2_source_mixing, op3_language_id, op4_license_scan, op5_toxicity, op6_url_filter, op7_fingerprints, op8_exact_dedup, op9_pii, op10_sentencepiece, op11_substring_dedup, op12_run_detection)
    return {f.__name__: f for f in found}


UPPER, LOWER = url_filter.UPPER, url_filter.LOWER

OP8 = f"""SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)"""

OP2 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, coalesce('s' || source, '') AS key FROM documents),
s AS (SELECT source, key, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS i FROM d GROUP BY source, key),
w AS (SELECT *, CASE i WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS w, source_size * {mixing.MOST_COPIES} AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS w_left, sum(source_size) OVER () AS total FROM w WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before)::DOUBLE / w_left AS level FROM o),
f AS (SELECT *, level * w >= cap AS stops FROM l),
t AS (SELECT key, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (SELECT arg_min(level, (cap / w, -level)) FROM f WHERE NOT stops) * w END AS target FROM f),
r AS (SELECT doc_id, key, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY key ORDER BY size, coalesce(substr(md5(doc_id::VARCHAR), 1, 2), ''), doc_id) AS place,
  ('0x' || substr(md5('{mixing.SEED}:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d JOIN t USING (key)),
c AS (SELECT *, least(floor(place * rate + u) - floor((place - 1) * rate + u), {mixing.MOST_COPIES})::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""


OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {ngram_join.SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {ngram_join.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {ngram_join.SHINGLE - 1}], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= {ngram_join.PERCENT} * (len(x.s) + len(y.s) - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, (SELECT min(b) FROM r WHERE r.a = doc_id)) AS component_id FROM s"""

OP11 = f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT r, i, sha256(array_to_string(w[i:i + {substring_dedup.WORDS - 1}], ' ')) AS t FROM (SELECT r, w, unnest(range(1, len(w) - {substring_dedup.WORDS - 2})) AS i FROM w)),
d AS (SELECT t FROM x GROUP BY t HAVING count(*) > 1),
g AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + {substring_dedup.WORDS})) AS i FROM x SEMI JOIN d USING (t)),
u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN g USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r) LEFT JOIN n USING (r)"""

_CUT = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_ROLL = f"list_transform(range(1, greatest(len(w) - {license_scan.SHINGLE - 2}, 1)), lambda i: array_to_string(w[i:i + {license_scan.SHINGLE - 1}], ' '))"
_TEMPLATES = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in sorted(LICENSES.items()))
_SCALE = "CASE " + " ".join(f"WHEN n <= {x} THEN {x}" for x in license_scan.SCALES) + " END"
OP4 = f"""WITH t AS MATERIALIZED (SELECT name, n, t, {_SCALE} AS scale FROM (SELECT name, len(w) AS n, list_distinct({_ROLL}) AS t FROM (SELECT name, {_CUT.format('text')} AS w FROM (VALUES {_TEMPLATES}) v(name, text)))),
d AS (SELECT doc_id, {_ROLL} AS s FROM (SELECT doc_id, {_CUT.format('text')} AS w FROM documents)),
c AS (SELECT doc_id, name, s, t, scale, coalesce(2 * scale, {license_scan.PIECE}) - {license_scan.SHINGLE - 1} AS long, coalesce(scale, {license_scan.APART}) AS step FROM d JOIN t ON list_has_any(s, t)),
x AS (SELECT doc_id, name, scale, t, unnest(list_transform(range(0, len(s), step), lambda i: list_distinct(s[i + 1:i + long]))) AS x, unnest(list_transform(range(0, len(s), step), lambda i: least(long, len(s) - i))) AS n FROM c),
m AS (SELECT DISTINCT doc_id, name FROM x WHERE CASE WHEN scale IS NULL THEN n >= {license_scan.FEWEST} AND len(list_intersect(x, t)) * 100 >= {license_scan.TEXT_CONTAINED} * least(n, len(t)) ELSE len(list_intersect(x, t)) * 100 >= {license_scan.CONTAINED} * len(t) END)
SELECT doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id"""


#: The patterns of each kind.
_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _matches(rows: str, pattern: str, columns: str) -> str:
    """Of rows (columns, text): each match m of pattern with its place k and start, from the lengths of what lies before it."""
    cut = f"SELECT {columns}, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM {rows}"
    each = f"SELECT {columns}, unnest(range(1, len(m) + 1)) AS k, m, p FROM ({cut})"
    return f"SELECT {columns}, k, m[k] AS m, (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a FROM ({each})"


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT WHEN {_DIGITS}[i]::INT > 4 THEN 2 * {_DIGITS}[i]::INT - 9 ELSE 2 * {_DIGITS}[i]::INT END)) % 10 = 0"
_VALID = {"email": "true", "ip": "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255", "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 9 AND 15"}
_SPANS = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, a, a + length(m) AS b FROM ({_matches('t', _PATTERNS[k], 'doc_id')}) WHERE {_VALID[k]}" for i, k in enumerate(pii.KINDS))
_KNOWN = ", ".join(f"'{w}'" for w in pii.FUNCTION_WORDS)
OP9 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({_SPANS}),
w AS MATERIALIZED (SELECT doc_id, k - 1 AS k, m, a, a + length(m) AS b FROM ({_matches('(SELECT * FROM t WHERE doc_id IN (SELECT doc_id FROM s))', _TERM, 'doc_id')})),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = w.doc_id AND s.a < w.b AND s.b > w.a)),
x AS (SELECT s.doc_id, s.kind, s.a, s.b, count(*) FILTER (w.b <= s.a) AS i, count(*) FILTER (w.a < s.b) AS j FROM s JOIN w ON w.doc_id = s.doc_id GROUP BY ALL),
n AS MATERIALIZED (SELECT DISTINCT f.doc_id, unnest([x.kind, {pii.ANY}]) AS kind, translate(f.m, '{UPPER}', '{LOWER}') AS term FROM f JOIN x ON x.doc_id = f.doc_id AND (f.k BETWEEN x.i - {pii.NEAR_WORDS} AND x.i - 1 OR f.k BETWEEN x.j AND x.j + {pii.NEAR_WORDS - 1})),
c AS (SELECT kind, term, count(*) AS near FROM n WHERE term NOT IN ({_KNOWN}) GROUP BY ALL HAVING count(*) >= {pii.SUPPORT}),
o AS (SELECT kind, count(DISTINCT doc_id)::DOUBLE AS of_kind FROM (SELECT doc_id, unnest([kind, {pii.ANY}]) AS kind FROM s) GROUP BY kind),
v AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}'))) AS term FROM t),
z AS (SELECT term, count(*) AS total FROM v SEMI JOIN c USING (term) GROUP BY term),
g AS MATERIALIZED (SELECT DISTINCT term FROM (SELECT *, (SELECT count(*)::DOUBLE FROM t) AS docs FROM c JOIN o USING (kind) JOIN z USING (term)) WHERE log2(near * docs / (total * of_kind)) >= {pii.ALPHA}::DOUBLE * log2(docs / of_kind)),
y AS (SELECT doc_id, m, a, a + length(m) AS b FROM ({_matches('(SELECT * FROM t WHERE doc_id IN (SELECT doc_id FROM v SEMI JOIN g USING (term)))', _TERM, 'doc_id')})),
h AS (SELECT doc_id, a, b FROM y WHERE translate(m, '{UPPER}', '{LOWER}') IN (SELECT term FROM g) AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = y.doc_id AND s.a < y.b AND s.b > y.a)),
q AS (SELECT doc_id, kind, a, b FROM s UNION ALL SELECT doc_id, 4, a, b FROM h),
r AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(pii.KINDS))},
  coalesce(string_agg({list(pii.KINDS)}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY kind, a) FILTER (kind < 4), '') AS base,
  string_agg({[*pii.KINDS, pii.TERM]}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY kind, a, b) AS spans FROM q GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op2_source_mixing": OP2, "op4_license_scan": OP4, "op6_url_filter": url_filter.oracle(), "op8_exact_dedup": OP8, "op9_pii": OP9, "op11_substring_dedup": OP11}
