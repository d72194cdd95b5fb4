import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality as Q
from quarry.llm.queries import op11_quality_classifier

from .conftest import OWN

TABLES = "/root/testdata/sf0.1"
MARKS, STOPS = set("#$%&*+/<=>@[\\]^_`{|}~"), set(".,;:!?'\"()-")


def slow(text):
    """The statistics of a short text, letter by letter."""
    data = (text or "").encode()
    seen = [b for b in data if b not in b" \t\n\v\f\r" and not 128 <= b < 192]
    words = [w for w in data.split() if w]
    kind = lambda b: "high" if b >= 192 else "inner" if b >= 128 else "upper" if 65 <= b < 91 else "lower" if 97 <= b < 123 else "digit" if 48 <= b < 58 else "stop" if chr(b) in STOPS else "mark"
    n = lambda k: sum(kind(b) == k for b in seen)
    share = lambda a, b: a / max(b, 1)
    of = lambda f: share(sum(map(f, words)), len(words))
    marked = lambda b: kind(b) in ("stop", "mark")
    low = [w.decode("latin1").translate({i: i + 32 for i in range(65, 91)}) for w in words]
    blocks = [low[i : i + Q.BLOCK] for i in range(0, len(low), Q.BLOCK)]
    lines, blanks = data.count(b"\n"), sum(b in b" \t\v\f\r" for b in data)
    return [
        math.log1p(len(seen) + lines + blanks) / 5, math.log1p(len(words)) / 5, math.log1p(share(sum(map(len, words)), len(words))),
        share(n("upper"), n("upper") + n("lower")), share(n("digit"), len(seen)), share(n("stop"), len(seen)), share(n("mark"), len(seen)), share(n("high"), len(seen)),
        of(lambda w: kind(w[0]) == "upper"), of(lambda w: sum(kind(b) == "upper" for b in w) > 1 and not any(kind(b) == "lower" for b in w)),
        of(lambda w: not any(kind(b) in ("upper", "lower", "high") for b in w)), of(lambda w: len(w) > 2 and marked(w[-1]) and marked(w[-2])),
        of(lambda w: kind(w[-1]) == "stop"), of(lambda w: kind(w[-1]) == "mark"), share(sum(a == b for a, b in zip(low, low[1:], strict=False)), len(words)),
        share(sum(len(set(b)) for b in blocks), len(words)), of(lambda w: len(w) > 12) + share(lines, len(words)),
    ]


def test_statistics():
    texts = ["One two TWO  two, three!!\nfour | | 55 #$", "", None, "ünï çÖdé 😀\nA", " \n ", "word " * 300 + "end.", "a\tb\r\nc" * 40, "Déjà*** vu&&& 12% LOUD!! loud!!"]
    assert np.allclose(Q.statistics(pa.array(texts, pa.string())), [slow(t) for t in texts])
    # whatever stands before it in a batch
    assert np.allclose(Q.statistics(pa.array(["before all", *texts]).slice(1)), Q.statistics(pa.array(texts)))


def test_long_texts_are_read_whole():
    text = "Plain words here.\n" * 300_000 + "#$ %& | " * 100_000
    one = Q.statistics(pa.array([text]))[0]
    words = 900_000 + 300_000
    assert one[13] == pytest.approx(300_000 / words, rel=1e-4) and one[12] == pytest.approx(300_000 / words, rel=1e-4)


def brute_isotonic(y, w):
    """By the formula of greatest lower and least upper means."""
    n = len(y)
    mean = lambda a, b: Fraction(sum(y[i] for i in range(a, b + 1)), sum(w[i] for i in range(a, b + 1)))
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_pooling_is_isotonic_regression():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        w = rng.integers(1, 5, n)
        y = np.array([rng.integers(0, k + 1) for k in w])
        score = np.sort(rng.choice(1000, n, replace=False)).astype(float)
        scores, rates = Q.pooled(score, w.astype(float), y.astype(float))
        want = brute_isotonic(y.tolist(), w.tolist())
        assert sorted(set(map(float, want))) == pytest.approx(sorted(set(rates.tolist())))
        assert (np.diff(scores) > 0).all() and (np.diff(rates) > 0).all()


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = Q.statistics_of(docs).cache()
    return docs, labels, stats, Q.fit(stats, labels)


def test_equations_summed_by_partitions_equal_one_regression(spark, small):
    docs, labels, stats, model = small
    good = {r.doc_id: int(r.quality > 0) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(r.doc_id, r.stats) for r in stats.where("doc_id is not null").collect() if r.doc_id in good]
    x, y = np.array([r[1] for r in rows]), np.array([good[r[0]] for r in rows], float)
    every = np.array([r.stats for r in stats.collect()])
    assert np.allclose(model.mean, every.mean(0)) and np.allclose(model.deviation, np.maximum(every.std(0), 1e-6))
    f = model.features(x)
    shrink = np.full(f.shape[1], Q.RIDGE * len(x))
    shrink[-1] = 1e-9
    assert np.allclose(f @ np.linalg.solve(f.T @ f + np.diag(shrink), f.T @ y), model.raw(x), atol=1e-6)


def test_features_approximate_a_gaussian_kernel(spark, small):
    model = small[3]
    rng = np.random.default_rng(1)
    wide = Q.Model(model.mean, model.deviation, rng.normal(size=(Q.NUMBERS, 40_000)) / Q.WIDTH, rng.uniform(0, 2 * np.pi, 40_000))
    z = rng.normal(size=(20, Q.NUMBERS))
    f = wide.features(z * model.deviation + model.mean)[:, :-1]
    want = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * Q.WIDTH**2))
    assert np.abs(f @ f.T - want).max() < 0.05


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op11_quality_classifier(spark, TABLES).collect()}
    labels = [r for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect() if r.quality is not None]
    out = [(rows[r.doc_id].score, rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in list(rows)[:500])
    bad, fine = [s for s, _, q in out if not q], [s for s, _, q in out if q]
    assert len(bad) > 100 and len(fine) > 600
    assert sum(p == q for _, p, q in out) / len(out) > 0.98
    assert sum(f > b for f in fine for b in bad) / (len(fine) * len(bad)) > 0.99
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p, _ in out)


def test_labels_of_held_out_rows_are_not_learned(spark, small):
    docs, labels, stats, model = small
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit(stats, turned)
    assert np.allclose(again.weights, model.weights) and np.allclose(again.rates, model.rates)


def test_defined_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (6, 1), (7, 0), (8, 1), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    rows = Q.judged(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id is None).held_out
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert {r.score for r in Q.judged(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.judged(no_docs, labels).count() == 0
    kept = Q.with_quality(docs, labels, least=0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    one = labels.where("quality = 1")
    assert {r.predicted for r in Q.judged(docs, one).collect()} == {1}


def test_columns_of_any_name_pass(spark, crowded):
    kept = Q.with_quality(crowded, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), least=0.0)
    assert sorted(map(str, kept.select(*map(lambda c: f"`{c}`", OWN)).collect())) == sorted(map(str, crowded.select(*map(lambda c: f"`{c}`", OWN)).collect()))


def test_memory_of_a_very_long_text():
    import tracemalloc

    texts = pa.array(["Some words, and more of them here.\n" * 600_000, "short"])  # 21 MB
    tracemalloc.start()
    try:
        Q.statistics(texts)
        assert tracemalloc.get_traced_memory()[1] < 300_000_000
    finally:
        tracemalloc.stop()
