import hashlib
from math import floor, isfinite

import duckdb
import numpy as np

from quarry.llm.clusters import Centroids, begun, carried_on, clustered, grouped, squares
from quarry.llm.queries import ORACLES, op13_centroid_clustering

TABLES = "/root/testdata/sf0.01"
LONG = 2**63 - 1
COLUMNS = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()


def brute(rows, clusters=40, rounds=5, width=64):
    """Every distance in every round, by whole numbers."""
    fine = [(i, [floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and isfinite(c) for c in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(fine, key=lambda r: (r[0] is None, digest(r[0]), r[0] or 0, r[1]))[:clusters]]
    for turn in range(rounds + 1):
        found = []
        for i, x in fine:
            d, j = min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
            found.append((i, x, j, d))
        if turn < rounds:
            for j in {f[2] for f in found}:
                own = [x for _, x, k, _ in found if k == j]
                centroids[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    sums = {j: sum(d for *_, k, d in found if k == j) for j in range(len(centroids))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i is None, i or 0, j, min(LONG, d), min(LONG, sums[j]), min(LONG, sum(sums.values())), text[j]) for i, _, j, d in found])


def got(df):
    return sorted((r.vec_id is None, r.vec_id or 0, *(r[c] for c in COLUMNS[1:])) for r in df.collect())


def test_equals_brute_force_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    want = brute(rows)
    df = op13_centroid_clustering(spark, TABLES)
    assert got(df) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    sql = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_centroid_clustering']})").fetchall()
    assert sorted((False, *r) for r in sql) == want


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.round(rng.normal(size=3), 1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(None, rows[8][1]), (5, rows[9][1]), (5, rows[9][1]), (5, rows[10][1])]
    bad = [(2000, None), (2001, [1.0, None, 0.0]), (2002, [float("nan")] * 3), (2003, [float("inf"), 0.0, 0.0]), (2004, [1.0]), (2005, [])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows + bad], "vec_id long, embedding array<double>, cluster string, x int")
    assert got(clustered(df, clusters=12, width=3)) == brute(rows, 12, width=3)
    few = df.where("vec_id < 5")
    assert got(clustered(few, clusters=12, width=3)) == brute([r for r in rows if r[0] is not None and r[0] < 5], 12, width=3)
    assert got(clustered(df.limit(0), clusters=12, width=3)) == []


def test_huge_components(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (np.exp(rng.normal(size=2) * 9) * 1e3).tolist()) for i in range(60)] + [(100, [1e15, -1e15]), (101, [1e15, 3.0]), (102, [-1e15, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(clustered(df, clusters=6, width=2)) == brute(rows, 6, width=2)
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert max(r.distance for r in clustered(far, clusters=1, width=2).collect()) == LONG


def test_bounds_hold_and_save_work():
    """Against all distances, round by round; and a bound loosened by the total displacement is never looser than by summed drifts."""
    rng = np.random.default_rng(8)
    x = np.floor(256 * (rng.normal(size=(3000, 8)) + 4 * rng.integers(0, 3, (3000, 8))))
    history = Centroids([[int(v) for v in row] for row in x[:30]])
    state = begun(x, history)
    for _ in range(8):
        cluster = state[0]
        history.add({j: (int((cluster == j).sum()), [int(v) for v in x[cluster == j].sum(0)]) for j in np.unique(cluster).tolist()})
        state = carried_on(x, *state, history, history.moved())
        every = np.stack([squares(x, c) for c in history.now()], 1)
        assert (state[0] == every.argmin(1)).all()
        moved, roots = history.moved(), np.sqrt(every)
        at = np.arange(len(x))
        assert (state[1] + moved[state[2], state[0]] >= roots[at, state[0]]).all()
        assert (state[3] - moved[state[4], np.arange(30)] <= roots).all()
        drift = np.array([np.sqrt(((np.array(a, float) - np.array(b, float)) ** 2).sum(1)) for a, b in zip(history.rounds, history.rounds[1:], strict=False)])
        summed = np.stack([drift[t:].sum(0) for t in range(len(history.rounds))])
        assert (moved <= summed * (1 + 1e-5) + 1e-9).all()
    assert state[5].mean() < 0.5 * 9 * 30


def test_superseded_tables_are_removed(spark):
    import glob

    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{at}/clusters-*"))
    rows = [(i, [float(i), 1.0]) for i in range(50)]
    state, _ = grouped(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=3, width=2)
    assert len(set(glob.glob(f"{at}/clusters-*")) - before) == 1 and state.count() == 50
