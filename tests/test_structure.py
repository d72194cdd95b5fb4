"""Trees, layouts, table functions, paged sources and observed stages."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunks as C
from quarry.operators import tablefns, trees
from quarry.sources import layout as L
from quarry.sources import paged
from quarry.streaming.observed import Progress, Stages

TREE = [{"id": 1, "title": 'a "b"', "text": "x", "nodes": [{"id": 2, "text": "y", "nodes": [{"id": 3, "text": None}]}, {"id": 4, "tags": ["p", {"text": 1}]}]}, {"id": 5, "text": "z"}]


def removed(tree, field):
    return [{k: removed(v, field) if k == "nodes" else v for k, v in node.items() if k != field} for node in tree]


def test_fields_go_at_every_depth(spark):
    rows = [(1, json.dumps(TREE)), (2, json.dumps(TREE[1])), (3, None), (4, "no json"), (5, "[]"), (6, '[{"id": 7, "nodes": []}, 8]')]
    df = spark.createDataFrame(rows, "doc_id long, tree string")
    got = {r.doc_id: json.loads(r.tree) for r in trees.without(df, ["text"]).collect()}
    assert got == {1: removed(TREE, "text"), 2: removed([TREE[1]], "text"), 6: [{"id": 7}]}
    back = {r.doc_id: json.loads(r.tree) for r in trees.trees_of(trees.fields_of(df)).collect()}
    assert back[1] == TREE
    assert trees.without(df.where("doc_id = 3"), ["text"]).count() == 0


def test_nodes_nest(spark):
    rows = [(1, 10, None, 1, "a"), (1, 20, 10, 2, "b"), (1, 15, 10, 2, "c"), (1, 16, 15, 3, 'd "q"'), (1, 30, None, 1, "e"), (2, 1, None, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, position long, parent long, depth int, title string")
    got = {r.doc_id: json.loads(r.tree) for r in trees.nested(df, ["position", "title"]).collect()}
    d = {"position": 16, "title": 'd "q"'}
    assert got[1] == [{"position": 10, "title": "a", "nodes": [{"position": 15, "title": "c", "nodes": [d]}, {"position": 20, "title": "b"}]}, {"position": 30, "title": "e"}]
    assert got[2] == [{"position": 1}] and trees.nested(df.limit(0), ["title"]).count() == 0


def test_layout_orders_boxes_and_drops_furniture(spark):
    rows = [
        (1, 1, 100.0, 5, 4.0, 0, "Annual Report"), (1, 2, 100.0, 5, 4.0, 0, " Annual Report\n"), (1, 1, 100.0, 50, 30.0, 1, "right of it"), (1, 1, 100.0, 5, 30.0, 2, "left of a bro-\nken ﬁ line"),
        (1, 1, 100.0, 5, 20.0, 3, "THE TITLE"), (1, 2, 100.0, 5, 95.0, 1, "Page 2 of 9"), (1, 2, 100.0, 5, 50.0, 2, "17"), (1, 2, 100.0, 5, 50.0, 3, "for internal use only"),
        (1, 2, 100.0, 5, 93.0, 4, "stands once"), (1, 3, 100.0, 5, 50.0, 0, "Annual Report"), (1, 3, 100.0, 5, 60.0, 1, "  "), (1, 3, 100.0, 5, 60.0, 2, None), (2, 1, 100.0, 5, 4.0, 0, "Annual Report"),
    ]
    found = L.elements(spark.createDataFrame(rows, "doc_id long, page int, height double, x0 int, y0 double, block int, content string"))
    got = [(r.doc_id, r.position, r.page, r.element_type, r.content) for r in found.orderBy("doc_id", "position").collect()]
    assert got == [
        (1, 0, 1, "header", "THE TITLE"), (1, 1, 1, "paragraph", "left of a broken fi line"), (1, 2, 1, "paragraph", "right of it"),
        (1, 3, 2, "paragraph", "stands once"), (1, 4, 3, "header", "Annual Report"), (2, 0, 1, "header", "Annual Report"),
    ]
    assert {r.doc_id: r.title for r in L.titles(found, F.lit("name")).collect()} == {1: "THE TITLE", 2: "Annual Report"}


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    heads = F.concat(F.lit("# One\n"), F.replace("text", F.lit(". "), F.lit(".\n## Two\n")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, heads).otherwise(F.col("text")))
    docs.createOrReplaceTempView("structure_texts")
    tablefns.register(spark)
    return docs


@pytest.mark.parametrize("strategy", ["fixed", "recursive", "structure_aware", "hierarchical", "late", "other"])
def test_table_function_equals_the_chunker(spark, texts, strategy):
    sql = spark.sql(f"SELECT d.doc_id, c.* FROM structure_texts d, LATERAL chunk(text => d.text, strategy => '{strategy}') c")
    want = C.chunked(texts, strategy)
    both = [c for c in want.columns if c in sql.columns]
    assert {"doc_id", "chunk_index", "content"} <= set(both)
    assert sorted(map(str, sql.select(*both).collect())) == sorted(map(str, want.select(*both).collect()))


def test_table_function_passes_title_and_five_headings(spark, texts):
    headings = "array('1', '2', '3', '4', '5', '6')"
    rows = spark.sql(f"SELECT d.doc_id, c.* FROM structure_texts d, LATERAL chunk(d.text, 'recursive', d.source, {headings}) c").collect()
    assert rows and all(r.content.split("\n")[0].endswith("] [Section: 1 > 2 > 3 > 4 > 5]") for r in rows)
    want = C.chunked(texts, "recursive", title=F.col("source"), headings=F.expr(headings))
    assert sorted((r.doc_id, r.chunk_index, r.content) for r in rows) == sorted((r.doc_id, r.chunk_index, r.content) for r in want.collect())
    one = spark.sql("SELECT * FROM chunk(CAST(NULL AS STRING), 'fixed')")
    assert one.count() == 0 and one.columns[-1] == "content"
    assert spark.sql("SELECT content FROM chunk('a b', 'fixed', NULL, NULL)").head()[0] == "a b"


def test_gathering_by_document(spark, texts):
    rows = C.sentences(texts).select("doc_id", "position", "sentence")
    rows.createOrReplaceTempView("structure_sentences")
    got = spark.sql("SELECT * FROM gather(TABLE(SELECT * FROM structure_sentences) PARTITION BY doc_id ORDER BY position)")
    want = C.late(texts)
    assert sorted((r.doc_id, r.chunk_index, r.n_words) for r in got.collect()) == sorted((r.doc_id, r.chunk_index, r.n_words) for r in want.collect())


def client(rows, calls):
    """A client over files of one row each in a folder; calls: where each request leaves a line."""

    def fetch(low, high, after, limit):
        import os

        with open(calls, "a") as out:
            out.write(f"{low} {high} {after} {limit}\n")
        keys = sorted(int(k) for k in os.listdir(rows))
        found = [k for k in keys if (low is None or k >= low) and (high is None or k < high) and (after is None or k > after)]
        return [(k, open(f"{rows}/{k}").read()) for k in found[:limit]], len(found) > limit

    return fetch, lambda: max(map(int, os_list(rows)), default=-1)


def os_list(path):
    import os

    return os.listdir(path)


def test_paged_source(spark, tmp_path):
    rows, calls = tmp_path / "rows", tmp_path / "calls"
    rows.mkdir()
    for k in range(50):
        (rows / str(k)).write_text(f"v{k}")
    fetch, last = client(str(rows), str(calls))
    paged.register(spark, paged.paged_source("pages_of_test", "k long, v string", fetch, bounds=[20, 40], last=last))
    df = spark.read.format("pages_of_test").option("page", 7).load()
    assert df.rdd.getNumPartitions() == 3 and sorted((r.k, r.v) for r in df.collect()) == [(k, f"v{k}") for k in range(50)]
    lines = calls.read_text().splitlines()
    assert "20 40 None 7" in lines and "20 40 26 7" in lines and len(lines) == 3 + 3 + 2
    calls.write_text("")
    some = df.where("k >= 15 AND k < 25 AND v != 'v17'")
    assert sorted(r.k for r in some.collect()) == [k for k in range(15, 25) if k != 17]
    assert {x.split()[0] + " " + x.split()[1] for x in calls.read_text().splitlines()} == {"15 20", "20 25"}
    assert [r.k for r in df.where("k = 30").collect()] == [30] and df.where("k > 60").count() == 0
    assert spark.read.format("pages_of_test").option("limit", 5).load().limit(5).count() == 5


def test_paged_stream_goes_on_from_its_offset(spark, tmp_path):
    rows, calls = tmp_path / "rows", tmp_path / "calls"
    rows.mkdir()
    fetch, last = client(str(rows), str(calls))
    paged.register(spark, paged.paged_source("pages_of_stream", "k long, v string", fetch, bounds=[5], last=last))

    def run():
        stream = spark.readStream.format("pages_of_stream").load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.k for r in spark.read.schema("k long, v string").parquet(f"{tmp_path}/out").collect())

    for k in range(8):
        (rows / str(k)).write_text("v")
    assert run() == list(range(8))
    (rows / "8").write_text("v")
    calls.write_text("")
    assert run() == list(range(9))
    assert all(int(x.split()[0]) >= 8 for x in calls.read_text().splitlines())


def test_observed_stages(spark):
    stages = Stages()
    df = stages.mark(spark.createDataFrame([(1, "ab"), (2, None), (3, "cde")], "id long, text string"), "read", "text")
    df = stages.mark(df.where("text is not null"), "kept", "text")
    assert df.count() == 2
    assert sorted(map(tuple, stages.rows(spark).collect())) == [("kept", 2, 0, 5), ("read", 3, 1, 5)]
    with pytest.raises(ValueError):
        stages.mark(df, "kept", "text")


def test_observed_stream(spark, tmp_path):
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        for n in (1, 2):
            spark.range(n * 10).selectExpr("id", "CAST(id AS STRING) AS text").write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
            stream = stream.observe("read", F.count(F.lit(1)).alias("n_rows")).where("id % 2 = 0").observe("even", F.count(F.lit(1)).alias("n_rows"))
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if len(progress.ended) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    counts = {(b, s): m["n_rows"] for _, b, s, m in progress.batches if m["n_rows"]}
    assert counts == {(0, "read"): 10, (0, "even"): 5, (1, "read"): 20, (1, "even"): 10} and all(ms >= 0 for *_, ms in progress.took)
