import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm.packing import cut, pack, patterns
from quarry.llm.queries import vocabulary
from quarry.llm.tokens import Encoder


def test_ids_equal_those_of_whole_texts():
    encoder, rng = Encoder(vocabulary(), memo=8), random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "1", ".", "'s", "\x1c", "\x85", "<|endoftext|>", "\U0001f600", " x", "\r\n", "　", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.many(texts)] == [encoder.raw(t) for t in texts]
    assert encoder.many([]) == [] and encoder.many([None, "", "one"])[:2] == [b"", b""]


def test_cut():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)] and cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def best_fit(counts, size):
    """Sequences of plain best-fit decreasing."""
    gaps = []
    for k in sorted(counts.elements(), reverse=True):
        fits = [g for g in gaps if g >= k]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else size) - k)
    return len(gaps)


@pytest.mark.parametrize("seed", range(20))
def test_patterns_use_every_piece_once(seed):
    rng, size = random.Random(seed), 64
    counts = Counter(rng.randint(1, size) for _ in range(rng.randint(0, 400)))
    used = Counter()
    found = patterns(counts, size)
    for n, pattern in found:
        assert n > 0 and sum(pattern) <= size
        for k in pattern:
            used[k] += n
    assert used == counts
    assert sum(n for n, _ in found) <= best_fit(counts, size)


def test_exact_fills():
    assert patterns({6: 3, 4: 3}, 10) == [(3, [6, 4])]
    assert patterns({5: 4}, 10) == [(2, [5, 5])]
    assert sum(n for n, _ in patterns({4: 2, 3: 2, 2: 2, 1: 2}, 10)) == 2


def test_whole_table(spark, docs):
    encoder = Encoder(vocabulary())
    want = []
    for r in docs.collect():
        ids = np.array([*encoder.raw(r.text or ""), 0], "<u4")
        for k, (s, n) in enumerate(cut(len(ids), 16)):
            want.append((r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    rows = pack(docs, vocabulary(), 16).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 16


def test_empty(no_docs):
    assert pack(no_docs, vocabulary()).collect() == []
