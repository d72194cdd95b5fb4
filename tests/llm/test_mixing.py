import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.mixing import drawn, even, split, taken, targets


def mix(docs, **options):
    rows, columns = drawn(docs, **options)
    return rows.select(*columns)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shared(sizes, weights, ceiling):
    """Targets by bisection of the price that those below their ceiling share."""
    if not sum(sizes):
        return [0.0] * len(sizes)
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, ceiling * s) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (low, mid)
    return [min(high * w, ceiling * s) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = (rng.integers(0, 40, 30) ** 2).tolist()
    df = spark.createDataFrame([("" if i == 29 else f"=s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long").repartition(3)
    got = {r.rank: r for r in targets(df, (1, 2, 3), 3).collect()}
    assert [got[i].source for i in range(30)] == [*(f"=s{i:02d}" for i in range(29)), ""]
    assert [got[i].target for i in range(30)] == pytest.approx(shared(sizes, [i % 3 + 1 for i in range(30)], 3), rel=1e-6, abs=1e-6)


def test_tree_keeps_quotas_and_totals():
    quotas, totals = [100, 1, 57, 0, 400], even(558, 7)
    got = split(quotas, totals, 3)
    assert got.sum(1).tolist() == quotas and got.sum(0).tolist() == totals and (got >= 0).all()
    assert max(totals) - min(totals) <= 1 and (got == split(quotas, totals, 3)).all()
    # the mean over seeds is that of hypergeometric draws
    mean = np.mean([split(quotas, totals, s)[4] for s in range(300)], 0)
    assert mean == pytest.approx([400 * t / 558 for t in totals], abs=1)


def test_words_by_source_and_shard(spark):
    """Shards hold equal numbers of blocks, and each source's words in a shard follow the tree's quota."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 40))), f"s{i % 7}" if i % 3 else "hot") for i in range(6000)]
    got = taken(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4).collect()
    by = defaultdict(int)
    for r in got:
        assert r.taken == sum(r.shard_words) and r.taken <= 3 * r.size
        for k, n in zip(r.shards, r.shard_words, strict=True):
            by[rows[r.doc_id][2], k] += n
    for s in {r[2] for r in rows}:
        target = next(r.target for r in got if rows[r.doc_id][2] == s)
        words = [by[s, k] for k in range(4)]
        assert abs(sum(words) - target) <= 1
        assert all(abs(w - target / 4) <= 0.15 * target for w in words)
    all_words = [sum(n for (_, k), n in by.items() if k == j) for j in range(4)]
    assert max(all_words) <= 1.05 * min(all_words)


def test_whole_table(spark, docs):
    rows = taken(docs, shards=4).collect()
    texts, of = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.source for r in docs.collect()}
    size, took, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and 0 <= r.taken <= 3 * r.size
        size[of[r.doc_id]] += r.size
        took[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    for r in rows:
        assert r.source_size == size[of[r.doc_id]]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in names] == pytest.approx(shared([size[s] for s in names], [1, 2, 3, 1], 3))
    assert all(abs(took[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, rows)) == sorted(map(str, taken(docs, shards=4).collect()))


def test_draws_are_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(1 + i % 9)) + "\n", f"s{i % 4 if i > 30 else 0}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.doc_id: r.taken for r in taken(docs).collect()}
    got = defaultdict(int)
    for r in mix(docs).collect():
        assert words(rows[r.doc_id][1])[: len(words(r.text))] == words(r.text)
        got[r.doc_id] += len(words(r.text))
    assert got == {k: n for k, n in want.items() if n}


def test_empty(no_docs):
    assert taken(no_docs).collect() == [] and mix(no_docs).collect() == []


def test_leading_blanks(spark):
    docs = spark.createDataFrame([(i, "  a b\tc d ", str(i)) for i in range(3)], "doc_id long, text string, source string")
    assert mix(docs).agg(F.count("*")).head()[0] == 4 and {r.text for r in mix(docs).collect()} == {"  a b\t", "  a b\tc d "}
