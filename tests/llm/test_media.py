import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm.media import GEAR, LEAST, MOST, WINDOW, chunked, gear, media, read_store, stored_media, write_store


def test_gear_hash():
    data = np.random.default_rng(0).integers(0, 256, 300, np.uint8)
    h, got = 0, gear(data)
    for i, b in enumerate(data.tolist()):
        h = (2 * h + int(GEAR[b])) % 2**32
        if i >= WINDOW:  # the 32-bit hash forgets what is older
            assert got[i] == h


def test_chunks():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(60_000))
    parts = chunked(data)
    assert b"".join(parts) == data and all(LEAST <= len(p) <= MOST for p in parts[:-1])
    shifted = set(chunked(b"something else" + data))
    assert sum(p in shifted for p in parts) >= len(parts) - 3
    assert max(map(len, chunked(b"\0" * 20_000))) <= MOST


def want(text):
    data = (text or "").encode()
    samples = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
    return len(data), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), hashlib.sha256(media(text)).hexdigest()


def test_round_trip(spark, docs, no_docs):
    rng = random.Random(2)
    long_ = "".join(rng.choice("abcdefgh \n") for _ in range(40_000))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, long_[: 39_000 - i] + str(i)) for i in range(5)] + [(200, long_), (201, long_), (300, "x" * 576)]
    both = spark.createDataFrame(rows, "doc_id long, text string")
    got = stored_media(both).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got) == sorted((str(d), *want(t)) for d, t in rows)
    _, store = write_store(both)
    kept = store.selectExpr("sum(aggregate(own, 0, (s, x) -> s + coalesce(length(x), 0)))").head()[0]
    assert kept < 320_000  # near copies share most chunks
    assert stored_media(no_docs).collect() == []


def test_damage_is_found(spark):
    _, store = write_store(spark.createDataFrame([(1, "abc")], "doc_id long, text string"))
    bad = store.selectExpr("media", "sha256", "digests", "transform(own, x -> cast('zzz' as binary)) as own", "borrowed")
    with pytest.raises(Exception, match="isn't what was stored"):
        read_store(bad).collect()


def test_bitmap_has_all_keys(spark):
    import xxhash
    from quarry.llm.media import BITS, bitmap

    keys = [bytes([i % 256, i // 256, 7]) for i in range(3000)]
    bits = bitmap(spark.createDataFrame([(k,) for k in keys], "key binary"))
    assert all(bits[(h := xxhash.xxh64_intdigest(k, seed=42) % BITS) >> 3] >> (h & 7) & 1 for k in keys)
    assert 2990 <= int(np.bitwise_count(bits).sum()) <= 3000
