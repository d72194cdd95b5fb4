import pytest
from pyspark.sql import functions as F

from quarry.functions import models as M
from quarry.sources import tables as S


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(M.embedder()("t").alias("v")).collect()
    assert rows[0].v == rows[1].v != rows[2].v and sum(x * x for x in rows[0].v) == pytest.approx(1)


def test_replies(spark):
    rows = spark.createDataFrame([('say {"optimized_query": "x"} end',), ("nothing",)], "r string")
    intent = M.from_reply(F.col("r"), "optimized_query string")
    assert [r[0] for r in rows.select(M.with_fallback(intent, F.lit("raw"))).collect()] == ["x", "raw"]
    reply = spark.createDataFrame([("REASONING: because\nPAGES: 5-7, 12\nCONFIDENCE: 7",), ("no",)], "r string").select(M.navigation(F.col("r")).alias("n")).collect()
    assert tuple(reply[0].n) == ("because", "5-7, 12", 1.0) and tuple(reply[1].n) == ("", "", 0.5)
    three = spark.createDataFrame([('[{"subject":"a","predicate":"r","object":"b"}]',), ("x",)], "r string").select(F.size(M.triplets_from(F.col("r")))).collect()
    assert [r[0] for r in three] == [1, 0]


def test_two_passes_and_compression(spark):
    rows = spark.createDataFrame([(1, 1, "q", "b"), (1, 0, "q", "a"), (2, 0, "q", "none")], "query_id int, position int, question string, content string")
    facts = lambda c: F.when(c.contains("none"), "NO_RELEVANT_CONTENT").otherwise(F.upper(c))
    got = M.two_pass(rows, "question", facts, lambda c: F.concat(F.lit("A: "), c)).collect()
    assert len(got) == 1 and got[0].answer == "A: q\n\nQ\n\nA\nQ\n\nB"
    short = lambda c: F.when(c == "none", "NO_RELEVANT_CONTENT").when(c == "a", None).otherwise("s")
    assert sorted(r.content for r in M.compressed(rows, short).collect()) == ["a", "s"]


def test_cascade_context_and_words(spark):
    a = spark.createDataFrame([(1, "x")], "q int, item string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "q int, item string")
    assert sorted(map(tuple, M.cascade([a, b], "q").collect())) == [(1, "x"), (2, "z")]
    parts = spark.createDataFrame([(1, "source", 0, "s"), (1, "memory", 0, "m"), (1, "background", 0, "b")], "q int, kind string, position int, content string")
    assert M.context_of(parts, "q").head().context == "b\n\nm\n\ns"
    assert [r.word for r in M.streamed_words(spark.createDataFrame([(1, "one two")], "q int, answer string"), "q").collect()] == ["one", "two"]
    assert M.tool_lines('{"a": 1, "_b": 2}') == "a: 1" and M.tool_lines("plain") == "plain"


def test_stores_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "t1", "x"), ("d2", "t2", "y")], "doc_id string, team_id string, text string")
    S.store(rows, str(tmp_path / "docs"))
    assert [r.doc_id for r in S.load(spark, str(tmp_path / "docs"), "t1").collect()] == ["d1"]
    with pytest.raises(ValueError):
        S.load(spark, str(tmp_path / "docs"), "")
    assert S.register_views(spark, S.filled({"docs_view": {"path": "${BASE:none}/docs"}}, {"BASE": str(tmp_path)})) == ["docs_view"]
    assert S.run_sql(spark, "SELECT count(*) AS n FROM docs_view").head().n == 2
    with pytest.raises(ValueError):
        S.run_sql(spark, "DROP TABLE docs_view")
    left = S.delete_document({"docs": rows}, spark.createDataFrame([("d1",)], "doc_id string"))
    assert left["docs"].count() == 1
    given = spark.createDataFrame([("t1", "d1", 1), ("t1", "d2", 1), ("t2", None, -1)], "team_id string, document_id string, score int")
    assert S.feedback(given, rows).count() == 2
    assert spark.range(1).select(S.capped(F.lit("abcdef"), 3)).head()[0].startswith("abc\n\n[TRUNCATED")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("hello")
    (tmp_path / "files" / "b.bin").write_text("hello")
    assert [r.text for r in S.objects(spark, str(tmp_path / "files"), "*.txt").collect()] == ["hello"]
