import math

import duckdb
import numpy as np
import pytest

from quarry.llm.queries import ORACLES, op9_exact_top_k
from quarry.llm.topk import nearest, search

TABLES = "/root/testdata/sf0.01"


def brute(rows, k=5, every=50):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % every == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_equals_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op9_exact_top_k']})").fetchall()
    assert got(op9_exact_top_k(spark, TABLES)) == sorted(want)


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(10)]  # ties
    rows += [(None, [1.0] * 4), (500, None), (501, [1.0, None, 0.0, 0.0]), (550, [float("nan")] * 4), (502, [float("inf")] * 4), (600, [0.0] * 4), (650, []), (700, [1.0, 2.0]), (701, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    assert got(nearest(df)) == brute(rows)
    assert got(nearest(df.limit(0))) == []


def test_huge_components_and_few_rows(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 3.0]), (2, [1e18, 2.0]), (3, [-1e300, 0.0]), (50, [5.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(nearest(df)) == brute(rows)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_pruning_loses_nothing(spread):
    rng = np.random.default_rng(7)
    v = np.floor(256 * rng.normal(size=(6000, 8)) * np.exp(spread * rng.normal(size=(6000, 1))))
    v[3000:3040] = v[:40]
    ids = rng.permutation(6000)
    seen = []
    best = search(ids[:60], v[:60], ids, v, 5, lambda a, b: seen.append(a.shape[0] * b.shape[0]) or a @ b.T)
    for i in range(60):
        want = sorted((-s, d) for s, d in zip((v @ v[i]).tolist(), ids.tolist(), strict=True) if d != ids[i])[:5]
        assert [(-s, d) for s, d in zip(best.score[i].tolist(), best.id[i].tolist(), strict=True)] == want
    assert sum(seen) < 60 * 6000


def test_waves_and_repeated_vectors(spark):
    """Lengths that differ by far, one vector that is a third of all rows, and more than one wave."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(4000, 6)) * np.exp(1.5 * rng.normal(size=(4000, 1)))
    rows = [(i, v[i].tolist()) for i in range(4000)] + [(10_001, v[7].tolist())] * 2000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    whole = np.floor(256 * np.array([r[1] for r in rows]))
    ids = np.array([r[0] for r in rows])
    for i in range(0, 4000, 50):
        s = whole @ whole[i]
        best = sorted((-a, d) for a, d in zip(s.tolist(), ids.tolist(), strict=True) if d != i)[:5]
        want += [(i, r, d, int(-a)) for r, (a, d) in enumerate(best, 1)]
    assert got(nearest(df)) == want
