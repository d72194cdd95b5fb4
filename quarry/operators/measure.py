"""Ranking metrics, reports, costs and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists


def ranking(retrieved: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Precision, recall, F1 and NDCG at k, and the reciprocal rank, of each query that has relevant items."""
    hits = retrieved.join(relevant.select(query, item).distinct().withColumn("hit", F.lit(1)), [query, item], "left").where("hit = 1")
    inside = F.col("rank") <= k
    found = hits.groupBy(query).agg(
        F.sum(F.when(inside, 1).otherwise(0)).alias("n_hits"),
        F.min("rank").alias("first"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    size = relevant.select(query, item).distinct().groupBy(query).agg(F.count("*").cast("int").alias("n_relevant"))
    rows = size.join(found, query, "left").na.fill(0, ["n_hits"]).na.fill(0.0, ["gain"])
    return _metrics(rows, query, k)


def ranking_of(rows: DataFrame, query: str, k: int) -> DataFrame:
    """The same from one table of pairs: rank (null if not retrieved) and relevant; one pass, no joins."""
    hit = F.col("relevant") & F.col("rank").isNotNull()
    inside = hit & (F.col("rank") <= k)
    found = rows.groupBy(query).agg(
        F.sum(inside.cast("int")).alias("n_hits"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"), F.sum(F.col("relevant").cast("int")).alias("n_relevant"),
    ).where("n_relevant > 0")
    return _metrics(found, query, k)


def _metrics(rows: DataFrame, query: str, k: int) -> DataFrame:
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant").cast("int"), F.lit(k))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    precision, recall = F.col("n_hits") / k, F.col("n_hits") / F.col("n_relevant")
    f1 = F.when(F.col("n_hits") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    r4 = lambda c: F.round(c, 4)
    return rows.select(query, r4(precision).alias("precision"), r4(recall).alias("recall"), r4(f1).alias("f1"), r4(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), r4(F.col("gain") / best).alias("ndcg"))


def report(scores: DataFrame) -> DataFrame:
    """Counts, mean scores and pass rates overall, by difficulty, by judge and by both: one pass with grouping sets."""
    return scores.cube("difficulty", "judge").agg(F.count("*").alias("n_scores"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg((F.col("score") >= 0.5).cast("double")), 4).alias("pass_rate"))


def compared(results: DataFrame, path: str, dimensions: list[str]) -> DataFrame:
    """Means by path, and in each dimension whether the path wins; latency wins by being least, ties by name."""
    from pyspark.sql import Window

    rows = results.groupBy(path).agg(F.count("*").alias("n"), *(F.round(F.avg(d), 4).alias(d) for d in dimensions))
    every = Window.partitionBy(F.lit(1))  # one row per path
    for d in dimensions:
        better = -F.col(d) if d == "latency" else F.col(d)
        first = F.row_number().over(every.orderBy(better.desc(), path)) == 1
        rows = rows.withColumn(f"wins_{d}", first)
    return rows


def failures(cases: DataFrame) -> DataFrame:
    """Failed cases by category: how many, their mean score and the worst."""
    worst = F.min(F.struct("score", "case_id"))
    return cases.where("score < 0.5").groupBy("category").agg(F.count("*").alias("n_cases"), F.round(F.avg("score"), 4).alias("mean_score"), worst["case_id"].alias("worst_case"))


def daily_usage(calls: DataFrame, team: str = "team_id") -> DataFrame:
    """Tokens of each team and day against the limit of its tier; an unknown tier counts as pro."""
    limits = F.create_map(*(F.lit(x) for kv in lists.DAILY_TOKENS.items() for x in kv))
    used = calls.groupBy(team, "tier", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"))
    limit = F.coalesce(F.try_element_at(limits, F.col("tier")), F.lit(lists.DAILY_TOKENS["pro"]))
    return used.withColumn("token_limit", limit.cast("long")).withColumn("within", F.col("tokens") < F.col("token_limit"))


def price(model: Column, which: int) -> Column:
    table = F.create_map(*(F.lit(x) for m, p in lists.PRICES.items() for x in (m, p[which])))
    return F.coalesce(F.try_element_at(table, model), F.lit(lists.OTHER_PRICE[which]))


def costs(calls: DataFrame, budget: float = 10.0, team: str = "team_id") -> DataFrame:
    """Dollars that each team spent, and what is left of its budget."""
    dollars = (F.col("tokens_in") * price(F.col("model"), 0) + F.col("tokens_out") * price(F.col("model"), 1)) / 1_000_000
    rows = calls.groupBy(team).agg(F.count("*").alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(dollars), 6).alias("spent"))
    return rows.withColumn("remaining", F.round(F.greatest(F.lit(0.0), budget - F.col("spent")), 6))


def recalled(memories: DataFrame, now: Column, query_words: Column, k: int = 5, half_life_hours: float = 72.0) -> DataFrame:
    """Memories by word overlap with the query, halved with age, the first k of each user."""
    from pyspark.sql import Window

    from ..functions import text as T

    words = F.array_distinct(T.split_words(F.lower("content")))
    overlap = F.size(F.array_intersect(words, query_words)) / F.greatest(F.size(query_words), F.lit(1))
    hours = (F.unix_micros(now) - F.unix_micros("valid_from")) / 3.6e9
    score = F.round(overlap * F.pow(F.lit(0.5), hours / half_life_hours) * F.col("relevance_score"), 6)
    rows = memories.where("valid_to IS NULL").withColumn("score", score).where("score > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("score").desc(), "memory_id"))).where(F.col("rank") <= k)
