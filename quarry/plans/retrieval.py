"""Search, fusion and reranking over whole tables. The tenant of a vector is its label; a tenant's query is the mean of its vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T
from ..functions import vector as V
from ..operators import search as S
from ..operators.cells import Cells
from ..operators.postings import index_of
from .base import query, read, sql_list

CENTROIDS = """
    parts AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos),
    queries AS (SELECT label, list(x ORDER BY pos) AS query FROM means GROUP BY label),
    pairs AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, query FROM embeddings JOIN queries USING (label))
"""
COSINE = "round(list_cosine_similarity(e, query), 6)"
L2 = "round(list_distance(e, query), 6)"


def ranked(score: str, order: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT label, vec_id, {score} AS score, row_number() OVER (PARTITION BY label ORDER BY {score} {order}, vec_id) AS rank FROM pairs) WHERE rank <= {k})"


def both(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return S.centroids(vectors, "label"), vectors


@query(f"WITH {CENTROIDS}, {ranked(COSINE, 'DESC', 10, 'r')} SELECT * FROM r")
def vec_topk_tenant(spark, sf_dir):
    return S.similar(*both(spark, sf_dir), "label", 10)


@query(f"WITH {CENTROIDS}, {ranked(COSINE, 'DESC', 10, 'r')} SELECT * FROM r")
def vec_cells_topk(spark, sf_dir):
    """The same from an index in cells, which reads the cells that can still hold one of the best."""
    queries, vectors = both(spark, sf_dir)
    return Cells(vectors, "label", cells=32).similar(queries, 10)


@query(f"WITH {CENTROIDS} SELECT label, vec_id, {COSINE} AS score FROM pairs WHERE {COSINE} >= 0.2")
def vec_threshold(spark, sf_dir):
    queries, vectors = both(spark, sf_dir)
    scored = vectors.join(queries, "label").select("label", "vec_id", F.round(V.cosine(F.col("query"), F.col("embedding")), 6).alias("score"))
    return scored.where("score >= 0.2")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS unit_first FROM embeddings")
def vec_normalise(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(V.unit(F.col("embedding")), F.lit(0)), 6).alias("unit_first"))


@query(f"""
    WITH {CENTROIDS}, {ranked(COSINE, 'DESC', 50, 'a')}, {ranked(L2, 'ASC', 50, 'b')},
    f AS (SELECT label, vec_id, round(sum(1 / (60.0::DOUBLE + rank)), 8) AS score, string_agg(source, ',' ORDER BY source) AS sources
          FROM (SELECT *, 'cosine' AS source FROM a UNION ALL SELECT *, 'l2' AS source FROM b) GROUP BY label, vec_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= 10
""")
def rrf_fusion(spark, sf_dir):
    queries, vectors = both(spark, sf_dir)
    near = vectors.join(queries, "label").select("label", "vec_id", F.round(V.distance(F.col("query"), F.col("embedding")), 6).alias("score"))
    lists_ = {"cosine": S.similar(queries, vectors, "label", 50), "l2": S.top(near, ["label"], ["score", "vec_id"], 50)}
    return S.fuse_ranks(lists_, "label", "vec_id", 60, 10)


HALF = "list_cosine_similarity(e[{a}:{b}], query[{a}:{b}])"


@query(f"""
    WITH {CENTROIDS}, {ranked(COSINE, 'DESC', 20, 'c')}, {ranked(f"round({HALF.format(a=1, b=32)}, 6)", 'DESC', 20, 's')}, {ranked(f"round({HALF.format(a=33, b=64)}, 6)", 'DESC', 20, 'k')},
    f AS (SELECT label, vec_id, round(sum(score), 8) AS score FROM (SELECT label, vec_id, score * 1.0::DOUBLE AS score FROM c UNION ALL SELECT label, vec_id, score * 1.5::DOUBLE FROM s UNION ALL SELECT label, vec_id, score * 1.2::DOUBLE FROM k) GROUP BY label, vec_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= 10
""")
def facet_fusion(spark, sf_dir):
    queries, vectors = both(spark, sf_dir)
    part = lambda a: lambda q, e: V.cosine(F.slice(q, a, 32), F.slice(e, a, 32))
    facets = {"content": (None, 1.0), "summary": (part(1), 1.5), "keywords": (part(33), 1.2)}
    return S.fuse_scores({n: (S.similar(queries, vectors, "label", 20, f), w) for n, (f, w) in facets.items()}, "label", "vec_id")


TOKENS = f"""list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda t: NOT list_contains({sql_list(lists.SPARSE_STOP)}, t) AND NOT regexp_full_match(t, '[0-9]+'))"""
TOKEN_ID = "CAST(CAST(concat('0x', left(sha256(token), 16)) AS UBIGINT) % 1000000007 AS BIGINT)"


def frequencies(table: str, key: str) -> str:
    return f"(SELECT {key}, {TOKEN_ID} AS token_id, count(*) AS tf FROM (SELECT {key}, unnest({TOKENS}) AS token FROM {table}) GROUP BY ALL)"


@query(f"SELECT * FROM {frequencies('documents', 'doc_id')}")
def tf_sparse(spark, sf_dir):
    return S.term_frequencies(read(spark, sf_dir, "documents"))


@query(f"""
    WITH q AS {frequencies('benchmark', 'item_id')}, d AS {frequencies('documents', 'doc_id')},
    s AS (SELECT item_id, doc_id, CAST(sum(q.tf * d.tf) AS BIGINT) AS score FROM d JOIN q USING (token_id) GROUP BY item_id, doc_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
""")
def sparse_score(spark, sf_dir):
    return index_of(read(spark, sf_dir, "documents")).best(read(spark, sf_dir, "benchmark"), "item_id", 10)


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query(f"""
    WITH q AS {frequencies('benchmark', 'item_id')}, d AS {frequencies('documents', 'doc_id')},
    s AS (SELECT item_id, doc_id, sum(q.tf * d.tf) AS s FROM d JOIN q USING (token_id) GROUP BY item_id, doc_id),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM s) WHERE rank <= 15),
    t AS (SELECT c.item_id, c.doc_id, c.rank, {WORDS.format('b.text')} AS qw, {WORDS.format('x.text')} AS dw, count(*) OVER (PARTITION BY c.item_id) AS n
          FROM c JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id)),
    r AS (SELECT item_id, doc_id, rank, round(CASE WHEN len(dw) = 0 THEN 0 ELSE least(1.0, least(1.0, len(list_intersect(qw, dw))::DOUBLE / greatest(len(qw), 1)) + 0.1::DOUBLE * (1 - (rank - 1)::DOUBLE / n)) END, 4) AS score FROM t),
    p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS position FROM r),
    g AS (SELECT item_id, doc_id, score, position, score >= 0.5 AS is_confident, max(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id) AS any_sure FROM p WHERE position <= 5)
    SELECT item_id, doc_id, score, position, is_confident FROM g WHERE is_confident OR any_sure = 0 AND position <= 3
""")
def overfetch_rerank(spark, sf_dir):
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    candidates = index_of(docs).best(items, "item_id", 15).select("item_id", "doc_id", "rank")
    texts = candidates.join(items.select("item_id", F.col("text").alias("query_text")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return S.rerank(texts, "item_id", 5).select("item_id", "doc_id", "score", "position", "is_confident")


def reranked_sql(n: int, items: str) -> str:
    """Candidates of items (item_id, text), reranked for the texts of benchmark, with whether any is confident."""
    return f"""q{n} AS {frequencies(items, 'item_id')},
    s{n} AS (SELECT item_id, doc_id, sum(q{n}.tf * d.tf) AS s FROM d JOIN q{n} USING (token_id) GROUP BY item_id, doc_id),
    c{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM s{n}) WHERE rank <= 15),
    t{n} AS (SELECT c.item_id, c.doc_id, c.rank, {WORDS.format('b.text')} AS qw, {WORDS.format('x.text')} AS dw, count(*) OVER (PARTITION BY c.item_id) AS n
          FROM c{n} c JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id)),
    r{n} AS (SELECT item_id, doc_id, rank, round(CASE WHEN len(dw) = 0 THEN 0 ELSE least(1.0, least(1.0, len(list_intersect(qw, dw))::DOUBLE / greatest(len(qw), 1)) + 0.1::DOUBLE * (1 - (rank - 1)::DOUBLE / n)) END, 4) AS score FROM t{n}),
    p{n} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS position FROM r{n}),
    g{n} AS (SELECT item_id, doc_id, score, position, score >= 0.5 AS is_confident, max(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id) AS any_sure FROM p{n} WHERE position <= 5),
    h{n} AS (SELECT item_id, doc_id, score, position, is_confident, any_sure FROM g{n} WHERE is_confident OR any_sure = 0 AND position <= 3)"""


@query(f"""WITH d AS {frequencies('documents', 'doc_id')}, {reranked_sql(1, 'benchmark')},
    again AS (SELECT item_id, array_to_string(list_filter({TOKENS}, lambda t: length(t) > 6), ' ') AS text FROM benchmark WHERE item_id IN (SELECT item_id FROM h1 WHERE any_sure = 0)),
    {reranked_sql(2, 'again')}
    SELECT item_id, doc_id, score, position, is_confident, false AS retried FROM h1 WHERE item_id NOT IN (SELECT item_id FROM h2) UNION ALL SELECT item_id, doc_id, score, position, is_confident, true FROM h2""")
def corrective_retrieval(spark, sf_dir):
    """Items that find nothing confident ask again in their long words, which stand for a model's rewriting."""
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    index = index_of(docs)
    long = lambda text: F.array_join(F.filter(T.sparse_tokens(text), lambda t: F.length(t) > 6), " ")
    return S.corrected(items, docs, lambda q: index.best(q, "item_id", 15), "item_id", "doc_id", long)


@query("SELECT vec_id, label FROM embeddings WHERE NOT coalesce(label = 3, false)")
def filter_must_not(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where(S.matches(must_not={"label": 3})).select("vec_id", "label")


CLASS = f"""
    (SELECT turn, conv_id, len(list_filter({sql_list(lists.STRUCTURED)}, lambda k: list_contains(w, k))) AS s, len(list_filter({sql_list(lists.FACTUAL)}, lambda k: contains(low, k))) AS f, w, low, len(regexp_extract_all(low, '\\S+')) AS n
     FROM (SELECT conv_id, turn, lower(text) AS low, regexp_split_to_array(lower(text), '\\s+') AS w FROM conversations))
"""


@query(f"""SELECT conv_id, turn, CASE WHEN s > f THEN 'structured' WHEN f > s THEN 'factual' ELSE 'complex' END AS query_class,
    CASE WHEN n > 30 OR list_has_any(w, {sql_list(lists.MULTI_HOP)}) THEN 'complex' WHEN n < 8 AND NOT list_has_any(w, {sql_list(lists.INVOLVED)}) THEN 'simple' ELSE 'moderate' END AS complexity FROM {CLASS}""")
def query_class(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_class(F.col("text")).alias("query_class"), T.complexity(F.col("text")).alias("complexity"))


@query(f"""SELECT conv_id, turn, CASE WHEN d.doc_id IS NULL OR NOT d.n_chars > 2000 THEN 'vector' WHEN d.lang = 'de' THEN 'pageindex'
    WHEN s > f THEN 'pageindex' WHEN f > s THEN 'vector' ELSE 'hybrid' END AS path FROM {CLASS} c LEFT JOIN documents d ON d.doc_id = c.conv_id""")
def route(spark, sf_dir):
    """Requests aim at the document of their number; long documents have trees and all but German ones vectors."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("tree"), (F.col("lang") != "de").alias("vectors"))
    rows = read(spark, sf_dir, "conversations").join(docs, F.col("doc_id") == F.col("conv_id"), "left")
    chosen = T.path(F.lit("auto"), F.col("doc_id"), F.col("tree"), F.col("vectors"), T.query_class(F.col("text")))
    return rows.select("conv_id", "turn", chosen.alias("path"))
