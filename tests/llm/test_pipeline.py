import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import exact_dedup, mixing, ngram_join, queries, spiece, toxicity
from tests.llm.test_mixing_urls_licenses import water_filled
from tests.llm.test_models import plain_features
from tests.llm.test_near_and_exact import lower, shingles
from tests.test_queries import duck, plain  # noqa: F401


def plain_toxic(rows, labels):
    """Scores of an FTRL learner over dictionaries, learnt as the stage learns."""
    texts = dict(rows)
    learnt = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    order = [learnt[i] for i in np.random.default_rng(7).permutation(len(learnt))]
    z, n = {}, {}

    def weight(f):
        return 0.0 if abs(z.get(f, 0)) <= toxicity.L1 else -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.RATE + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in order:
            x = plain_features(texts[i]) | {"one"}
            w = {f: weight(f) for f in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
            for f in x:
                was = n.get(f, 0)
                z[f] = z.get(f, 0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / toxicity.RATE * w[f]
                n[f] = was + g * g
    return lambda t: 1 / (1 + math.exp(-sum(weight(f) for f in plain_features(t or "") | {"one"})))


def plain_pipeline(docs, labels):
    """doc_id and ids of run(), stage by stage in plain Python, for rows (doc_id, text, source) of distinct doc_ids."""
    from sentencepiece import SentencePieceProcessor

    score = plain_toxic([(i, t) for i, t, _ in docs if t], labels)
    docs = [d for d in docs if score(d[1]) < 0.5]
    last = {lower(t): max(i for i, u, _ in docs if lower(u) == lower(t)) for _, t, _ in docs}
    docs = [d for d in docs if last[lower(d[1])] == d[0]]
    sets = {i: shingles(t) for i, t, _ in docs}
    group = {i: i for i in sets}
    for _ in sets:  # until no label falls
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    docs = [d for d in docs if group[d[0]] == d[0]]
    sizes, out = {}, []
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + count(t)
    goal = water_filled(sizes)
    for s in sizes:
        u = int(hashlib.md5(f"{mixing.SEED}:{'s' + s if s is not None else ''}".encode()).hexdigest()[:8], 16) / 2**32
        rate = goal[s] / sizes[s] if sizes[s] else 0
        own = sorted((count(t), hashlib.md5(str(i).encode()).hexdigest()[:2], i, t) for i, t, x in docs if x == s)
        for k, (_, _, i, t) in enumerate(own, 1):
            out += [(i, t)] * min(3, math.floor(k * rate + u) - math.floor((k - 1) * rate + u))
    library = SentencePieceProcessor(model_file=spiece.default_model())
    return sorted((i, tuple(library.encode(t or ""))) for i, t in out)


def test_run_against_a_plain_pipeline(spark, tmp_path):
    rng = random.Random(31)
    words = [f"w{chr(97 + i % 26)}{i}é"[: 4 + i % 3] for i in range(60)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels = [], {}
    for i in range(140):
        w = prose(rng.randint(6, 60))
        labels[i] = int(i % 4 == 0)
        rows.append((i, " ".join(w + ["nasty", "stuff", "so", "bad"] * labels[i]), rng.choice(["a", "b", "c", None])))
    for i in range(140, 170):
        rows.append((i, rows[i - 100][1].upper() if i % 2 else rows[i - 100][1] + " tail", "b"))
    rows += [(170, "", "a"), (171, None, "d"), (172, "nasty stuff so bad unlabelled", "a")]
    docs = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain_pipeline(rows, labels)
    assert got == want and 20 < len(want) and not any(i in (4, 172) for i, _ in want)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_run_on_odd_tables(spark, tmp_path, kind):
    """An empty table, and one with null and repeated ids, clashing names, null and empty texts."""
    rows = [(1, "a"), (1, "z"), (2, "a"), (None, "a"), (None, "n o p q r s t"), (None, "n o p q r s t"), (5, None), (6, ""), (7, "n o p q r s t u v w x y"), (7, "n o p q r s t u v w x y")]
    schema = "doc_id long, text string, source string, row long, k1 long, copies int, hash string, component_id int"
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3, "h", 4) for i, t in rows] if kind == "odd" else [], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    left = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
    if kind == "odd":
        assert left == [(-1, "n o p q r s t")] * 2 + [(1, "z"), (2, "a"), (6, "")] + [(7, rows[8][1])] * 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not out if kind == "empty" else {r["doc_id"] for r in out} <= {None, 1, 2, 6, 7}


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "exact_dedup":
            want = {r["doc_id"] for r in exact_dedup.exact_groups(before).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "ngram_jaccard_join":
            want = {r["component_id"] for r in ngram_join.ngram_jaccard_join(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "source_mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.mixed(before).where("copies > 0").collect()}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == want
    assert docs.where("not round_trip").count() == 0 and docs.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert corpus_pipeline.run(spark, small).count() == sizes[-1]


def test_queries_against_sql(spark, small, duck):  # noqa: F811
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, small)
        columns = sorted(df.columns)
        want = duck.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
