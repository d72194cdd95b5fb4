import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.queries import op7_toxicity
from quarry.llm.toxicity import Model, judged, label_model, logistic, mined, terms_in, training, without_toxic


def corpus(spark, n=600):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("ra", "to", "lis")]
    bad = ["idiot", "vequeur", "vequan", "lowei", "scum", "loser"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        text = [rng.choice(words) for _ in range(rng.choice([30, 80, 400]))]
        for _ in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = judged(docs, labels).collect()
    want = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == 600
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert without_toxic(docs, labels).columns == docs.columns


def test_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = corpus(spark, 200)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(judged(docs, labels).collect()) == sorted(judged(docs, flipped).collect())


def auc(scores, truth):
    pos, neg = scores[truth], scores[~truth]
    return (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2


def test_tables_held_out(spark):
    rows = op7_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    truth, scores = np.array([labels[r.doc_id] > 0 for r in held]), np.array([r.score for r in held])
    hits = int((truth & (scores >= 0.5)).sum())
    assert hits >= 0.9 * truth.sum() and hits >= 0.95 * (scores >= 0.5).sum() and auc(scores, truth) >= 0.95


def test_no_row_votes_on_itself(spark):
    """Votes on a fold come from the other folds: labels of a fold's own rows don't change its lists."""
    docs, labels = corpus(spark)
    sample = training(docs, labels, 12_000)
    other = sample.withColumn("toxic", F.when(F.col("fold") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    lists = [{t for t, strong in mined(s) if strong[2]} for s in (sample, other)]
    assert lists[0] == lists[1] and "idiot" in lists[0]


def test_terms():
    assert terms_in("Réeuxa réeuxb, to") == {"réeuxa", "réeuxb", "to", "^réeu", "^réeux", "2^réeu", "2^réeux"}
    model = Model(terms={t: i for i, t in enumerate(sorted(terms_in("réeuxa réeuxb to")))})
    assert [sorted(model.terms)[i] for i in model.terms_of("RÉEUXB to", {})] == sorted(["^réeu", "^réeux", "réeuxb", "to"])
    assert set(model.terms_of("to réeuxb réeuxa", {})) == set(model.terms.values())


def expected(votes, prior, rounds):
    """The same model by densities of two multivariate normals, row by row."""
    v = [list(map(float, row)) for row in votes]
    n, m = len(v), len(v[0])
    spread = [np.std([row[j] for row in v]) for j in range(m)]
    alike = np.eye(m)
    for i in range(m):
        for j in range(m):
            if i != j:
                mean_i, mean_j = np.mean([r[i] for r in v]), np.mean([r[j] for r in v])
                alike[i, j] = sum((r[i] - mean_i) * (r[j] - mean_j) for r in v) / (n - 1) / np.sqrt((spread[i] ** 2 + 1e-9) * (spread[j] ** 2 + 1e-9))
    voice = [1 / sum(alike[i, j] ** 4 for j in range(m)) for i in range(m)]
    q = [1 / (1 + np.exp(-2 * (sum(x * w for x, w in zip(row, voice)) + 0.25))) for row in v]
    for _ in range(rounds):
        one, two = sum(q), n - sum(q)
        means = [np.array([sum(p * r[j] for p, r in zip(ps, v)) / total for j in range(m)]) for ps, total in ((q, one), ([1 - p for p in q], two))]
        cov = sum(p * np.outer(r - means[0], r - means[0]) + (1 - p) * np.outer(r - means[1], r - means[1]) for p, r in zip(q, np.array(v))) / n + 0.02 * np.eye(m)
        inverse = np.linalg.inv(cov)
        density = lambda r, mean: np.exp(-((r - mean) @ inverse @ (r - mean)) / 2)
        q = [prior * density(r, means[0]) / (prior * density(r, means[0]) + (1 - prior) * density(r, means[1])) for r in np.array(v)]
    return np.array(q)


def test_label_model_equals_normal_densities():
    rng = np.random.default_rng(5)
    y = rng.random(120) < 0.3
    votes = np.column_stack([np.where(rng.random(120) < 0.8, np.where(y, 1, -1), 0) for _ in range(4)] + [np.where(y & (rng.random(120) < 0.5), 1, 0)])
    for rounds in (1, 5):
        assert label_model(votes, 0.3, rounds)[0] == pytest.approx(expected(votes, 0.3, rounds), abs=1e-4)


def test_classifier_is_at_its_optimum():
    """The gradient of the loss, term by term, is nearly 0."""
    rng = np.random.default_rng(2)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(200)]
    y = np.array([0.9 if 0 in r else 0.2 for r in rows])
    dense = rng.integers(-1, 2, (200, 2)).astype(float)
    starts = np.cumsum([0, *map(len, rows)])
    w, b = logistic(np.concatenate(rows), starts, dense, y, 6, rounds=3000)
    error = [1 / (1 + np.exp(-(sum(w[t] for t in r) + d @ w[6:] + b))) - p for r, d, p in zip(rows, dense, y)]
    slopes = [sum(e for e, r in zip(error, rows) if t in r) / 200 for t in range(6)]
    assert max(map(abs, slopes)) < 2e-3 and abs(sum(error)) / 200 < 2e-3


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    def voter(right):
        return np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1)) * (rng.random(4000) < 0.8)
    copy = voter(0.7)
    votes = np.column_stack([voter(0.9), voter(0.85), voter(0.8), copy, copy])
    posterior, accuracy, correlation = label_model(votes, 0.3)
    assert np.mean((posterior > 0.5) == y) > 0.9
    assert accuracy == pytest.approx([0.9, 0.85, 0.8, 0.7, 0.7], abs=0.06)
    assert correlation[3, 4] > 0.9 and abs(correlation[0, 1]) < 0.2


def test_defined_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 1), (9, 0)], "doc_id long, toxic int")
    assert judged(docs, labels).count() == 10
    assert {r.score for r in judged(docs, labels.limit(0)).collect()} == {0.0}
    assert judged(no_docs, labels).collect() == []
    kept = without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 10
