"""Cases beyond the test tables."""

import hashlib

from quarry.functions import text as T
from quarry.operators import search as S
from quarry.operators.postings import Index
from quarry.plans.registry import QUERIES


def test_terms_after_100000_characters(spark):
    text = "early " * 20_000 + "tail tail"
    docs = spark.createDataFrame([(1, text), (2, "tail")], "doc_id long, text string")
    ids = {r.token: r.id for r in spark.createDataFrame([("early",), ("tail",)], "token string").withColumn("id", T.token_id("token")).collect()}
    got = {(r.doc_id, r.token_id): r.tf for r in S.term_frequencies(docs).collect()}
    assert got == {(1, ids["early"]): 20_000, (1, ids["tail"]): 2, (2, ids["tail"]): 1}
    queries = spark.createDataFrame([(7, "tail")], "item_id long, text string")
    assert [(r.doc_id, r.score) for r in Index(docs).best(queries, "item_id", 10).orderBy("rank").collect()] == [(1, 2), (2, 1)]


MARKED = "﻿The oﬃce  of “A”—it’s​ here…  \n１２\nmail bob＠example.com now."
PLAIN = "The office  of \"A\"-it's here...  \n12\nmail bob@example.com now."
CLEAN = "The office of \"A\"-it's here...\nmail [REDACTED_EMAIL] now."


def test_marks_are_plain_before_other_cleaning(spark, tmp_path):
    spark.createDataFrame([(1, MARKED), (2, PLAIN), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {r.doc_id: (r.n_original, r.n_clean, r.clean_md5) for r in QUERIES["clean_pipeline"](spark, str(tmp_path)).collect()}
    assert got == {1: (len(MARKED), len(CLEAN), md5(CLEAN)), 2: (len(PLAIN), len(CLEAN), md5(CLEAN)), 3: (None, None, None)}
    got = {r.doc_id: (r.n_plain, r.plain_md5) for r in QUERIES["clean_nfkc"](spark, str(tmp_path)).collect()}
    assert got == {1: (len(PLAIN), md5(PLAIN)), 2: (len(PLAIN), md5(PLAIN)), 3: (None, None)}


def test_all_rows_of_a_table_tool(spark, tmp_path):
    rows = [(i, "F" if i % 3 else "O", i / 4) for i in range(300)] + [(300, None, None), (301, "F", None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(QUERIES["table_tool"](spark, str(tmp_path)).collect(), key=lambda r: r.o_orderkey)
    assert [tuple(r) for r in got] == [(i, p) for i, s, p in rows if s == "F"]
