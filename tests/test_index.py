"""Searches by the stored indexes against all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators.cells import NONE, Cells
from quarry.operators.postings import Index
from quarry.operators.search import similar

WORDS = [f"w{i}x" for i in range(60)]


def texts(rng, n, long):
    weights = 1 / np.arange(1, 61)
    out = []
    for _ in range(n):
        size = int(rng.integers(0, 400 if rng.random() < long else 12))
        out.append(" ".join(rng.choice(WORDS, size, p=weights / weights.sum())))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    docs = [*enumerate(texts(rng, 400, 0.1)), (1000, None), (1001, ""), (1002, "W0X 17 the w0x")]
    queries = [*enumerate(texts(rng, 30, 0.0)), (100, None), (101, "zzz"), (102, "w0x w0x w59x zzz")]
    return dict(docs), dict(queries), spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")


def terms(text):
    return Counter(w for w in (text or "").lower().split() if w != "the" and not w.isdigit())


def pairs(docs, queries):
    for q, a in queries.items():
        for d, b in docs.items():
            x, y = terms(a), terms(b)
            both = x.keys() & y.keys()
            if both:
                yield q, d, len(both), sum(x[w] * y[w] for w in both), len(x)


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_best_equals_all_pairs(corpus, k):
    docs, queries, d, q = corpus
    want = []
    for item in queries:
        rows = sorted((-s, doc) for i, doc, _, s, _ in pairs(docs, queries) if i == item)[:k]
        want += [(item, doc, -s, r) for r, (s, doc) in enumerate(rows, 1)]
    index = Index(d)
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in index.best(q, "item_id", k).collect())
    assert got == sorted((i, r, doc, s) for i, doc, s, r in want)
    assert sum(n for _, n in index.bands) == sum(len(terms(t)) for t in docs.values())


def test_sharing_equals_all_pairs(corpus):
    docs, queries, d, q = corpus
    for share in (0.3, 0.6, 1.0):
        got = sorted((r.item_id, r.doc_id, r.n, r.score, r.size) for r in Index(d).sharing(q, "item_id", share).collect())
        assert got == sorted((i, doc, n, s, size) for i, doc, n, s, size in pairs(docs, queries) if n >= share * size)


def test_empty_index(corpus):
    _, _, d, q = corpus
    assert Index(d.limit(0)).best(q, "item_id", 3).count() == 0 and Index(d).best(q.limit(0), "item_id", 3).count() == 0
    assert Index(d.limit(0)).sharing(q, "item_id", 0.5).count() == 0


def test_few_postings_are_read(spark):
    """Of a corpus with few long documents: less than a fifth of the asked terms' postings for the best ten of each item."""
    at = "/root/testdata/sf0.01"
    index = Index(spark.read.parquet(f"{at}/documents.parquet"))
    rows = index.best(spark.read.parquet(f"{at}/benchmark.parquet"), "item_id", 10)
    assert rows.count() and 0 < index.read()[0] < 0.2 * sum(n for _, n in index.bands) and index.read()[1] > 0


def test_cells_equal_all_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16)) * 3
    rows = [(i % 3, i, (centre[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(3000)]
    rows += [(0, 5000, None), (0, 5001, [0.0] * 16), (1, 5002, [1.0] * 8), (2, 5003, [1.0, None] * 8)] + [(1, 6000 + i, rows[1][2]) for i in range(30)] + [(7, 7000, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "team long, vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, centre[0].tolist()), (1, (centre[1] + centre[4]).tolist()), (2, rng.normal(size=16).tolist()), (7, centre[2].tolist()), (8, centre[2].tolist())], "team long, query array<double>")
    cells = Cells(vectors, "team", cells=24)
    want = sorted(map(tuple, similar(queries, vectors, "team", 12).select("team", "vec_id", "score", "rank").collect()))
    assert sorted(map(tuple, cells.similar(queries, 12).select("team", "vec_id", "score", "rank").collect())) == want
    asked = cells.bounds.where("team in (0, 1, 2, 7)").agg(F.count("*"), F.sum("n")).head()
    assert cells.visited[0] < asked[0] and cells.visited[1] < asked[1]
    assert {r.vec_id for r in cells.vectors.where(F.col("cell") == NONE).collect()} == {5000, 5001, 5002, 5003, 7000}
    # a query of another width finds what has that width
    odd = spark.createDataFrame([(1, [1.0] * 8)], "team long, query array<double>")
    assert cells.similar(odd, 1).head().vec_id == 5002
    assert Cells(vectors.limit(0), "team").similar(queries, 3).count() == 0


def test_hops_have_plans_of_one_size(spark):
    edges = spark.createDataFrame([(f"n{i}", "to", f"n{i + 1}") for i in range(8)] + [("hub", "to", f"x{i}") for i in range(50)] + [("n2", "to", "hub")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    scans = []
    for hops in (1, 3, 6):
        df = G.k_hop(seeds, edges, hops)
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        depth = {r.node: r.depth for r in df.collect()}
        assert depth == {f"n{i}": i for i in range(hops + 1)} | ({"hub": 3} if hops > 2 else {}) | ({f"x{i}": 4 for i in range(50)} if hops > 3 else {})
    assert scans == [1, 1, 1]


def test_hubs_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 4)
    edges = spark.createDataFrame([("hub", "to", f"x{i}") for i in range(50)] + [(f"x{i}", "to", f"y{i}") for i in range(50)], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([("y7",)], "node string")
    got = Counter(r.depth for r in G.k_hop(seeds, edges, 4).collect())
    assert got == {0: 1, 1: 1, 2: 1, 3: 49, 4: 49}
    assert math.ceil(50 / 4) > 1
