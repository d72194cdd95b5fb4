"""Column functions that judge answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Share of the words of whole that part has; null if whole has none."""
    return F.size(F.array_intersect(whole, part)) / F.nullif(F.size(whole), F.lit(0))


def faithfulness(answer: Column, sources: Column) -> Column:
    c = share(sources, answer)
    scaled = F.when(c >= 0.6, F.least(F.lit(1.0), 0.5 + c * 0.5)).when(c >= 0.3, 0.3 + c * 0.4).otherwise(c * 0.5)
    return F.when(F.size(sources) == 0, 0.0).otherwise(F.coalesce(scaled, F.lit(0.0)))


def relevance(answer: Column, query: Column, expected: Column) -> Column:
    of_query, of_expected = share(answer, query), F.coalesce(share(answer, expected), F.lit(0.0))
    return F.when(F.size(query) == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.4 * of_query + 0.6 * of_expected))


def coverage(answer: Column, expected: Column, answer_text: Column | None = None, expected_text: Column | None = None) -> Column:
    """Share of the expected words that the answer has; half if none are known. An empty answer covers nothing, and where nothing is expected all is covered."""
    blank = lambda t: F.length(F.trim(F.coalesce(t, F.lit("")))) == 0
    c = F.coalesce(share(answer, expected), F.lit(0.5))
    if expected_text is not None:
        c = F.when(blank(expected_text), 1.0).otherwise(c)
    return F.when(blank(answer_text), 0.0).otherwise(c) if answer_text is not None else c


def failure(faithful: Column, relevant: Column, covered: Column, latency_ms: Column, recall: Column) -> Column:
    """The first cause that applies; missing scores count as 1."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    return (
        F.when(one(faithful) < 0.3, "hallucination")
        .when(one(relevant) < 0.3, "off_topic")
        .when(latency_ms > 10_000, "latency_exceeded")
        .when(recall < 0.2, "retrieval_miss")
        .when(one(covered) < 0.3, "low_coverage")
        .otherwise("unknown")
    )
