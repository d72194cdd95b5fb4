"""What a service shows of its results, keeps of them and records about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from . import search as S


def shown(results: DataFrame, chars: int, digits: int, most: int | None = None) -> DataFrame:
    """Results with shortened content and rounded scores, the first few of each query."""
    rows = results if most is None else results.where(F.col("rank") <= most)
    return rows.withColumns({"content": F.left("content", F.lit(chars)), "relevance_score": F.round("relevance_score", digits)})


def by_position(reranked: DataFrame, results: DataFrame, query: str) -> DataFrame:
    """Reranked rows (query, index, relevance_score) with the columns of the results that they point to by position."""
    return reranked.join(results.withColumnRenamed("position", "index").drop("relevance_score"), [query, "index"])


def cached(queries: DataFrame, vectors: DataFrame, answers: DataFrame, tenant: str, key: str, threshold: float = 0.95) -> DataFrame:
    """The answer cached for the nearest earlier query of a tenant, where it is near enough: top 1 by cosine, then the value by key."""
    nearest = S.similar(queries, vectors, tenant, 1).select(tenant, F.when(F.col("score") >= threshold, F.col(key)).alias(key))
    return nearest.join(answers, key, "left").select(tenant, F.col(key).alias("cached_id"), "answer")


def composites(scores: DataFrame, case: list[str]) -> DataFrame:
    """A case's mean score, 0 without scores, and whether it passes."""
    mean = F.coalesce(F.avg("score"), F.lit(0.0))
    return scores.groupBy(*case).agg(F.round(mean, 4).alias("composite"), (F.round(mean, 12) >= 0.5).alias("passed"))


def doubtful(scores: DataFrame, asked: DataFrame, case: list[str], least: float = 0.7) -> DataFrame:
    """Cases whose mean score is too low, but for simple questions."""
    rows = scores.groupBy(*case).agg(F.avg("score").alias("mean")).join(asked, case).where(F.col("complexity") != "simple")
    return rows.where(F.round("mean", 12) < least).select(*case, F.round("mean", 6).alias("mean_score"), "complexity")


def by_model(calls: DataFrame) -> DataFrame:
    """Calls, tokens and dollars of each model; a model without a price costs nothing."""
    price = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for m, p in lists.MODEL_PRICES.items() for x in (m, float(p[i])))), F.col("model")), F.lit(0.0))
    rows = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("input_tokens"), F.sum("tokens_out").alias("output_tokens"))
    return rows.withColumn("cost_usd", F.round((F.col("input_tokens") * price(0) + F.col("output_tokens") * price(1)) / 1_000_000, 6))


def counters(events: DataFrame, group: str) -> DataFrame:
    """Counter and gauge of each group: how many events there were, and the last value."""
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id")))
    return events.groupBy(group).agg(F.count("*").alias("total"), F.count("value").alias("n_values"), last.alias("latest"))


def slow(operations: DataFrame, duration: str, most: float = 50.0) -> DataFrame:
    """Operations that took longer than so many milliseconds."""
    return operations.where(F.col(duration) > most)


def status(tree: Column, error: Column) -> Column:
    return F.when(tree, "ready").when(error.isNull(), "partial").otherwise("failed")


def picked(cases: DataFrame, difficulty: list[str] | None = None, tag: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Cases of a difficulty, with a tag, of these ids."""
    if difficulty:
        cases = cases.where(F.col("difficulty").isin(difficulty))
    if tag:
        cases = cases.where(F.array_contains("tags", tag))
    return cases.where(F.col("id").isin(ids)) if ids else cases


def members(sets: DataFrame, tools: DataFrame) -> DataFrame:
    """Tools of each set (toolset, names); names without a tool are skipped."""
    return sets.select("toolset", F.explode("names").alias("name")).join(tools.select("name"), "name").select("toolset", "name")



def stand_in(contexts: DataFrame, query: str, prompt: str) -> DataFrame:
    """An answer without a model: the first five sources (query, prompt, position, content) by position, 200 characters of each."""
    part = F.concat(F.lit("[Source "), F.col("position").cast("string"), F.lit("]: "), F.left("content", F.lit(200)))
    lines = F.array_sort(F.collect_list(F.when(F.col("position") <= 5, F.struct("position", part.alias("line")))))
    rows = contexts.groupBy(query).agg(F.first(prompt).alias(prompt), F.count("content").alias("n"), lines.alias("lines"))
    a, b, c = map(F.lit, lists.STAND_IN)
    said = F.concat(a, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), b, F.col("n").cast("string"), c, F.left(prompt, F.lit(100)))
    return rows.select(query, F.when(F.col("n") > 0, said).otherwise(F.lit(lists.NO_CONTEXT)).alias("answer"))


def with_fallback(scored: dict[str, DataFrame], candidates: DataFrame, query: str, item: str) -> DataFrame:
    """Scores of the first reranker in order that has any for a query; a query that none scores keeps its order at one half, and a blank query scores 0."""
    out = None
    for name, df in scored.items():
        own = df.select(query, item, "score", F.lit(name).alias("reranker"))
        out = own if out is None else out.unionByName(own.join(out.select(query).distinct(), query, "left_anti"))
    rest = candidates.join(out.select(query).distinct(), query, "left_anti").select(query, item, F.when(F.length(F.trim("query_text")) == 0, 0.0).otherwise(0.5).alias("score"), F.lit("none").alias("reranker"))
    return out.unionByName(rest)


def limited(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each tool call, and whether there were more of them or as many as it may return."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = rows.withColumn("_n", n).where(F.col("_n") <= most + 1)
    many = F.max("_n").over(Window.partitionBy(*by))
    return kept.withColumn("truncated", many >= most).where(F.col("_n") <= most).drop("_n")


def queued(jobs: DataFrame, bound: int = 100) -> DataFrame:
    """Status of jobs that arrive at a queue of so many places in one batch: those behind the bound fail, the others wait."""
    place = F.row_number().over(Window.partitionBy("batch").orderBy("ts", "event_id"))
    return jobs.withColumn("status", F.when(place <= bound, "pending").otherwise("failed"))
