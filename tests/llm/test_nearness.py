import random

import numpy as np
import pytest

from quarry.llm.nearness import collisions, near_groups, threshold


def shingles(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, size, percent):
    """Row number to smallest doc_id reachable."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(d), len(sets[i]), str(least[find(i)]), d == least[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([2, 30, 90, 200]))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 14])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 % 601, " ".join(copy).title() if rng.random() < 0.2 else " ".join(copy)))
    # a family whose members are near to its origin only
    origin = [rng.choice(vocabulary) for _ in range(300)]
    for _ in range(40):
        copy = list(origin)
        for _ in range(5):
            copy[rng.randrange(len(copy))] = "x" + str(rng.random())
        rows.append((len(rows) + 1000, " ".join(copy)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_groups(docs, size, percent)) == brute(rows, size, percent)


def test_defined_cases(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_groups(docs, 3, 85)) == brute(rows, 3, 85)


def test_empty(no_docs):
    assert near_groups(no_docs).collect() == []


def test_threshold():
    assert threshold(85, 32) == 16 and threshold(85, 256) == 188 and threshold(80, 256) == 172 and threshold(100, 64) == 64


def edited(rng, words, target, size):
    """A copy whose shingle similarity lies just at or above the target."""
    copy = list(words)
    own = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    while True:
        other = list(copy)
        other[rng.randrange(len(other))] = f"x{rng.random()}"
        sets = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)}
        if 100 * len(own & sets) < target * len(own | sets):
            return copy
        copy = other


def test_recall_just_above_the_similarity(spark):
    """Pairs at 85 to 87 percent: all 400 are found."""
    rng, rows = random.Random(8), []
    for i in range(400):
        words = [f"a{rng.randrange(50_000)}" for _ in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, 85, 3)))]
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) == 400


def test_template_pages_below_the_similarity(spark):
    """Pages that share half their words: no links, and neither pairs nor texts of them in numbers."""
    rng = random.Random(5)
    frame = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(frame + [f"p{rng.randrange(10**9)}" for _ in range(60)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_groups(docs, 3, 85).where("kept").count() == 3000


@pytest.mark.parametrize("seed", range(3))
def test_collisions(seed):
    rng = np.random.default_rng(seed)
    left = rng.integers(0, 3, (40, 256)).astype(np.uint8)
    right = np.concatenate((left[:20], rng.integers(0, 3, (30, 256)).astype(np.uint8)))
    right[:20][rng.random((20, 256)) < 0.2] = 9
    want = {(i, j, int((a == b).sum())) for i, a in enumerate(left) for j, b in enumerate(right) if (a == b).sum() >= 188}
    assert set(zip(*(x.tolist() for x in collisions(left, right, 188)))) == want and want
