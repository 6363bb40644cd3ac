import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.vectors import VectorBackend
from marlstone.operators import groups


def scanned(df, query, k):
    b = VectorBackend(query)
    return [(r["id"], round(r["s"], 9)) for r in df.where(b.embedded()).select("id", b.similarity().alias("s")).orderBy(F.desc("s"), "id").limit(k).collect()]


@pytest.mark.parametrize("centres", [1, 16, 256])
def test_equal_to_a_scan(spark, tmp_path, centres):
    rng = np.random.default_rng(centres)
    middles = rng.normal(size=(12, 16))
    v = [(i, (middles[i % 12] + 0.15 * rng.normal(size=16)).tolist(), "x") for i in range(600)]
    v += [(900, [0.0] * 16, "x"), (901, None, "x"), (902, [1.0, 2.0], "x"), (903, [], "x"), (904, v[3][1], "x"), (905, v[3][1], "x")]
    df = spark.createDataFrame(v, "id long, embedding array<double>, n string")
    groups.write_groups(df, str(tmp_path / "g"), centres)
    read = []
    for q in (v[0][1], v[3][1], rng.normal(size=16).tolist(), [-x for x in v[5][1]], [0.0] * 16, [1.0, 2.0]):
        for k in (1, 10, 700):
            found, n = groups.top_k(spark, str(tmp_path / "g"), q, k, "id")
            got = [(r["id"], round(r["score"], 9)) for r in found.collect()]
            if got != scanned(df, q, k):  # of rows that are tied but for rounding any order is right
                assert [s for _, s in got] == [s for _, s in scanned(df, q, k)]
            read.append(n)
    assert found.columns == ["id", "embedding", "n", "score"]
    if centres == 16:
        assert min(read) < 120  # of 605


def test_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    groups.write_groups(df, str(tmp_path / "g"))
    assert groups.top_k(spark, str(tmp_path / "g"), [1.0], 3, "id")[0].count() == 0
