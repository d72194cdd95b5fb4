import zlib

import numpy as np
import pytest

from quarry.llm.queries import vocabulary
from quarry.llm.tokens import Encoder
from quarry.llm.wavelet import WaveletMatrix, dumped, loaded, read_shards, write_shards


@pytest.mark.parametrize("n,top", [(1, 1), (5, 3), (3000, 50_257), (1500, 2), (700, 200_000)])
def test_access_count_select(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    _, _, m = loaded(dumped([1, None], [n - 1, 1], ids))
    assert m.decode().tolist() == ids.tolist()
    for i in rng.integers(0, n, 40).tolist():
        assert m.access(i) == ids[i]
    for v in [*np.unique(ids)[:20].tolist(), top + 5]:
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        at = np.flatnonzero(ids == v).tolist()
        assert m.count(v, a, b) == sum(a <= i < b for i in at)
        assert [m.select(v, k) for k in range(min(4, len(at)))] == at[:4]
        assert m.select(v, len(at)) == -1


def test_empty_matrix():
    assert WaveletMatrix.build(np.array([], np.uint32)).decode().tolist() == []


def test_round_trip(spark, docs):
    encoder = Encoder(vocabulary())
    files = write_shards(docs, vocabulary(), shard=20)
    assert files.count() > 3
    got = sorted(read_shards(files).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, [*encoder.raw(r.text or ""), 0]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty(no_docs):
    assert read_shards(write_shards(no_docs, vocabulary())).collect() == []
