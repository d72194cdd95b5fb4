from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from quarry.llm.queries import op12_embedding_whitening
from quarry.llm.whitening import LARGEST, whitened

TABLES = "/root/testdata/sf0.01"


def brute(rows, components=16, weight="one"):
    """(vec_id, component) to (n, deviation, whitened, explained), by whole numbers and fractions up to the eigenvectors."""
    fine = [(i, tuple(floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    copies = {}
    for _, x in fine:
        copies[x] = copies.get(x, 0) + 1
    weights = {x: k if weight == "count" else 1 for x, k in copies.items()}
    n = sum(weights.values())
    d = len(fine[0][1])
    s = [sum(w * x[j] for x, w in weights.items()) for j in range(d)]
    y = {x: np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)]) for x in weights}
    v = sum(w * np.outer(y[x], y[x]) for x, w in weights.items()) / n
    value, vector = np.linalg.eigh(v)
    out = []
    for i, x in fine:
        for k in range(min(components, d)):
            e, u = value[d - 1 - k], vector[:, d - 1 - k]
            out.append((i, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), float(y[x] @ u / np.sqrt(e)), e / np.trace(v)))
    return out


def same(got, want):
    got = [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    for k in {g[1] for g in got}:
        g, w = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-6


def test_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    got = op12_embedding_whitening(spark, TABLES).collect()
    same(got, brute(rows))
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 < got[0].identity_error < 1e-9
    assert len(got) == 16 * len(rows)


@pytest.mark.parametrize("weight", ["one", "count"])
def test_copies_and_bad_rows(spark, weight):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(None, rows[8][1]), (5, rows[9][1]), (5, rows[9][1])]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows + bad], "vec_id long, embedding array<double>, x string, copies int")
    same(whitened(df, components=4, weight=weight).collect(), brute(rows, 4, weight))


def test_widths_and_flat_components(spark):
    rng = np.random.default_rng(4)
    three = [(i, [*rng.normal(size=2).tolist(), 1.0]) for i in range(50)]
    two = [(100 + i, rng.normal(size=2).tolist()) for i in range(50)]
    df = spark.createDataFrame([*three, *two, (500, []), (501, [1.0] * 4)], "vec_id long, embedding array<double>")
    got = whitened(df).collect()
    # a dimension without variance gives no component, and neither does a single vector
    same([r for r in got if r.vec_id < 100], [w for w in brute(three) if w[1] < 3])
    same([r for r in got if r.vec_id >= 100], brute(two))
    assert whitened(df.limit(0)).count() == 0 and whitened(df.where("vec_id = 501")).count() == 0


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and max(r.deviation for r in got) == 2**63 - 1
    assert all(isfinite(r.whitened) for r in got) and LARGEST == 2**40
