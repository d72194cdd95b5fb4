"""Tenant-filtered search, rank fusion and reranking over whole tables of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V


def for_tenant(df: DataFrame, tenant: str | None, column: str = "team_id") -> DataFrame:
    """The tenant's rows; refuses to plan without one."""
    if not tenant:
        raise ValueError("a tenant is required")
    return df.where(F.col(column) == tenant)


def matches(must: dict | None = None, must_not: dict | None = None) -> Column:
    """Equality conditions; a missing value never equals, and isn't excluded."""
    wanted = [F.coalesce(F.col(k) == v, F.lit(False)) for k, v in (must or {}).items()]
    banned = [~F.coalesce(F.col(k) == v, F.lit(False)) for k, v in (must_not or {}).items()]
    return reduce(lambda a, b: a & b, wanted + banned, F.lit(True))


def top(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked; Spark limits each partition's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def centroids(vectors: DataFrame, tenant: str) -> DataFrame:
    """Each tenant's mean vector: a query that stands for the tenant."""
    parts = vectors.select(tenant, F.posexplode(V.doubles("embedding"))).groupBy(tenant, "pos").agg(F.avg("col").alias("x"))
    return parts.groupBy(tenant).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("query"))


def similar(queries: DataFrame, vectors: DataFrame, tenant: str, k: int, score=None, threshold: float | None = None) -> DataFrame:
    """Top k of each query among its tenant's vectors: an equi-join on the tenant, never a cross join."""
    score = V.cosine if score is None else score
    scored = vectors.join(queries, tenant).select(tenant, "vec_id", F.round(score(F.col("query"), F.col("embedding")), 6).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return top(scored, [tenant], [F.col("score").desc(), "vec_id"], k)


def fuse_ranks(lists: dict[str, DataFrame], query: str, item: str, k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over the lists, with the lists that an item came from."""
    every = reduce(DataFrame.unionByName, (df.select(query, item, "rank", F.lit(name).alias("source")) for name, df in lists.items()))
    fused = every.groupBy(query, item).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return top(fused, [query], [F.col("score").desc(), item], limit)


def fuse_scores(lists: dict[str, tuple[DataFrame, float]], query: str, item: str, limit: int = 10) -> DataFrame:
    """Weighted sum of scores over the lists."""
    every = reduce(DataFrame.unionByName, (df.select(query, item, (F.col("score") * weight).alias("score")) for df, weight in lists.values()))
    fused = every.groupBy(query, item).agg(F.round(F.sum("score"), 8).alias("score"))
    return top(fused, [query], [F.col("score").desc(), item], limit)


def term_frequencies(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, token_id, tf of the sparse vectors."""
    counts = T.sparse_words(docs, doc).groupBy(doc, "token").agg(F.count("*").alias("tf"))
    return counts.groupBy(doc, T.token_id(F.col("token")).alias("token_id")).agg(F.sum("tf").alias("tf"))


#: Query terms up to so many rows are broadcast; more are joined by shuffle.
FEW = 200_000


def postings(queries: DataFrame, query: str) -> DataFrame:
    """token, query and its tf there."""
    return T.sparse_words(queries, query).groupBy(query, "token").agg(F.count("*").alias("q_tf"))


def near(df: DataFrame) -> DataFrame:
    """A table that is broadcast if a look at its first rows says that it is small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def fuse_results(lists: dict[str, DataFrame], query: str, doc: str, content: str = "content", k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of rows: equal documents with equal first 100 characters are one result, which keeps the row that was seen first (lists in their order, then rank)."""
    rows = [df.select(query, doc, F.left(content, F.lit(100)).alias("head"), "rank", F.lit(i).alias("place"), F.lit(n).alias("source"), F.struct(*(c for c in df.columns if c not in (query, doc, "rank"))).alias("row")) for i, (n, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, rows)
    first = F.min_by("row", F.struct("place", "rank"))
    fused = every.groupBy(query, doc, "head").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 8).alias("rrf_score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), first.alias("row"), F.min(F.struct("place", "rank")).alias("seen"))
    return top(fused, [query], [F.col("rrf_score").desc(), "seen", doc], limit).select(query, doc, "rrf_score", "sources", "rank", "row.*")


def hybrid(dense: DataFrame, sparse: DataFrame, query: str, item: str, k: int = 10) -> DataFrame:
    """Dense and sparse branches (query, item, rank), each with twice the results asked for, fused by rank."""
    return fuse_ranks({"dense": dense.where(F.col("rank") <= 2 * k), "sparse": sparse.where(F.col("rank") <= 2 * k)}, query, item, limit=k)


def merged_filter(team: dict, extracted: dict | None = None, given: dict | None = None, namespace: str | None = None) -> Column:
    """Conditions of the team, then those extracted from the question, then those of the request, then the namespace: all must hold."""
    return reduce(lambda a, b: a & b, (matches(m) for m in (team, extracted, given, {"namespace": namespace} if namespace else None) if m), F.lit(True))


def rerank(candidates: DataFrame, query: str, n: int, confident: float = 0.5, fallback: int = 3) -> DataFrame:
    """Keyword-overlap rerank of candidates (query_text, text, rank), then the confidence gate: confident rows, or the first few if a query has none."""
    words = lambda c: F.array_distinct(T.split_words(F.lower(c)))
    w = Window.partitionBy(query)
    share = F.size(F.array_intersect(words("query_text"), words("text"))) / F.greatest(F.size(words("query_text")), F.lit(1))
    bonus = 0.1 * (1 - (F.col("rank") - 1) / F.count("*").over(w))
    scored = candidates.withColumn("score", F.round(F.when(F.size(words("text")) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), share) + bonus)), 4))
    ranked = top(scored, [query], [F.col("score").desc(), "rank"], n, "position")
    sure = F.col("score") >= confident
    return ranked.withColumn("is_confident", sure).withColumn("any_confident", F.max(sure).over(w)).where("is_confident OR (NOT any_confident AND position <= %d)" % fallback).drop("any_confident")


def corrected(queries: DataFrame, docs: DataFrame, retrieve, query: str, doc: str, rewrite, n: int = 5, fallback: int = 3) -> DataFrame:
    """Retrieval that corrects itself: candidates of each query (query, text) are reranked, and a query without a confident one asks again in the words that rewrite makes of its text; what comes back is reranked for the query as it was. Where that finds nothing, the first few of the first try stay. retrieve gives query, doc, rank of such queries."""
    from ..sources.stored import stored

    asked = queries.select(query, F.col("text").alias("query_text"))
    texts = docs.select(doc, "text")

    def reranked(found: DataFrame) -> DataFrame:
        rows = found.select(query, doc, "rank").join(asked, query).join(texts, doc)
        return stored(rerank(rows, query, n, fallback=fallback).select(query, doc, "score", "position", "is_confident"), "corrected")

    first = reranked(retrieve(queries))
    sure = first.groupBy(query).agg(F.max("is_confident").alias("sure"))
    weak = stored(sure.where("not sure").select(query), "corrected-weak")
    again = queries.join(weak, query, "left_semi").select(query, rewrite(F.col("text")).alias("text"))
    second = reranked(retrieve(again))
    kept = first.join(second.select(query).distinct(), query, "left_anti").withColumn("retried", F.lit(False))
    return kept.unionByName(second.withColumn("retried", F.lit(True)))
