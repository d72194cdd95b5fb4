import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm.sharding import Blocks, minimax_shards


def smallest(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        for s in sizes:
            if room + s > mid:
                used, room = used + 1, 0
            room += s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 7])
def test_capacity_is_the_smallest(n):
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        blocks = Blocks([(f"{i:03x}", s, 1) for i, s in enumerate(sizes)])
        best = smallest(sizes, n)
        assert blocks.smallest(max(sizes), lambda c: blocks.cuts(c, n) is not None) == best
        ends = blocks.even(best, n)
        assert ends[-1] == len(sizes) and ends == sorted(ends)
        assert max(blocks.edges[b] - blocks.edges[a] for a, b in zip([0, *ends], ends, strict=False)) <= best


def test_whole_table(spark, docs):
    n = 3
    rows = minimax_shards(docs, n).collect()
    assert len(rows) == 10
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    slots, groups, load = defaultdict(list), {}, defaultdict(int)
    for r in rows:
        text = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert groups.setdefault(text, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = defaultdict(int)
    for r in rows:
        by[r.group] += r.size
    assert max(load.values()) == smallest([by[k] for k in sorted(by)], n)
    assert set(slots) <= set(range(n))


def test_refined_prefixes(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 90) + str(i // 2)) for i in range(20_000)]
    out = minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    by, load = defaultdict(int), defaultdict(int)
    for r in out:
        by[r.group] += r.size
        load[r.shard] += r.size
    assert max(load.values()) == smallest([by[k] for k in sorted(by)], 24)
    assert min(load.values()) > 0.98 * max(load.values())


def test_empty(no_docs):
    assert minimax_shards(no_docs).collect() == []
