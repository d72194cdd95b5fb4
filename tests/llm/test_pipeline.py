import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm.nearness import one_of_each
from quarry.llm.queries import vocabulary
from quarry.llm.staging import stored
from quarry.llm.tokens import Encoder
from quarry.llm.toxicity import judged

from .test_lines import brute as brute_lines
from .test_lines import hashed
from .test_mixing import shared
from .test_nearness import shingles

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SMALL), "test-" + name.replace(" ", "-")))
    assert all(k.columns == docs.columns for k in kept[:-1])
    raw, clean, lines, near, mix, packed = (k.collect() for k in kept)
    toxic = {r.doc_id for r in judged(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.predicted}
    assert toxic and sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in raw if r.doc_id not in toxic)
    hashed(kept[1])
    want = brute_lines([(r.doc_id, r.text) for r in clean], spare=85)
    assert sorted((r.doc_id, r.text) for r in lines) == sorted((d, t) for (d, _), t in want.items())
    # one document of each group: the first in order of ids of those that are linked
    sets = {r.doc_id: shingles(r.text, 5) for r in lines}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in near) == sorted(d for d in root if root[d] == d)
    size, took = Counter(), Counter()
    for r in near:
        size[r.source] += len(words(r.text))
    for r in mix:
        took[r.source] += len(words(r.text))
    names = sorted(size)
    assert [took[s] for s in names] == [round(t) for t in shared([size[s] for s in names], [i % 3 + 1 for i in range(len(names))], 3)]
    encoder, tokens, by = Encoder(vocabulary()), Counter(), defaultdict(list)
    for r in mix:
        ids = np.array([*encoder.raw(r.text or ""), 0], "<u4")
        first = len(ids) % 2048 or 2048
        for s in [0, *range(first, len(ids), 2048)]:
            tokens[r.doc_id, zlib.crc32(ids[s : first if s == 0 else s + 2048].tobytes())] += 1
    assert tokens == Counter((r.doc_id, r.ids_crc32) for r in packed)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048


def test_near_stage_defined_cases(spark, docs, no_docs):
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["1", "3", "4", "None", "6", "7", "8", "9"])
    assert one_of_each(no_docs).collect() == []


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_pass_whatever_their_names(spark, crowded, tmp_path, name, stage):
    spark.createDataFrame([(1, 0), (9, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, crowded, str(tmp_path))
    assert got.columns == crowded.columns
    want = {(r.doc_id, r.key): r for r in crowded.collect()}
    rows = got.collect()
    assert rows
    for r in rows:
        assert all(r[c] == want[r.doc_id, r.key][c] for c in crowded.columns if c != "text")


def test_run_on_hard_and_empty_tables(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 0), (9, 1)], "doc_id long, toxic int")
    for name, table in (("hard", docs), ("none", no_docs)):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "hard")
