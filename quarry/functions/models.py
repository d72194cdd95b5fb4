"""Model seams: Arrow-batched functions that a real provider can replace, with deterministic stand-ins.

A provider is a Python callable over a list of texts; `embedder`, `generator` and `classifier` turn one into a column
function. It is created once in each worker.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import split_words


# fixed value: seeds of stand-in vectors
SEEDS = 2**32
# fixed values: how replies hold an object, a list and the parts of a navigation
OBJECT, LIST = r"(?s)(\{.*\})", r"(?s)(\[.*\])"
PART, NEXT_PART = r"(?is){name}:\s*{pattern}", r"(.*?)(?=\n\s*(?:PAGES|CONFIDENCE):|\z)"


def hashed_vectors(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors drawn from the text's digest: equal texts, equal vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            rng = random.Random(int(hashlib.sha256((t or "").encode()).hexdigest(), 16) % SEEDS)
            v = [rng.gauss(0, 1) for _ in range(size)]
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v])
        return out

    return embed


def quoted_sources(questions: list[str]) -> list[str]:
    """An answer without a model: the question's first words."""
    return [f"Based on the sources: {(q or '')[:200]}" for q in questions]


def _batched(make: Callable[[], Callable[[list[str]], list]], kind: str):
    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for batch in batches:
            yield pd.Series(provider(batch.tolist()), index=batch.index)

    return apply


def embedder(make=hashed_vectors):
    """A column function from texts to vectors; make creates the provider in the worker."""
    return _batched(make, "array<double>")


def generator(make=lambda: quoted_sources):
    """A column function from prompts to texts."""
    return _batched(make, "string")


def from_reply(reply: Column, schema: str) -> Column:
    """The JSON object within a model's reply, or null."""
    found = F.regexp_extract(reply, OBJECT, 1)
    return F.from_json(F.when(found != "", found), schema)


def triplets_from(reply: Column) -> Column:
    """The JSON array of subject, predicate and object within a model's reply, or an empty one."""
    found = F.regexp_extract(reply, LIST, 1)
    return F.coalesce(F.from_json(F.when(found != "", found), "array<struct<subject:string,predicate:string,object:string>>"), F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))


def with_fallback(intent: Column, query: Column) -> Column:
    """The optimized query of an intent, or the query itself where the model failed."""
    return F.coalesce(F.when(F.length(F.trim(intent["optimized_query"])) > 0, intent["optimized_query"]), query)


def two_pass(chunks: DataFrame, question: str, facts, answer) -> DataFrame:
    """Facts from each chunk (query_id, position, question column, content), then one answer from those that aren't empty, in order."""
    prompt = F.concat(F.col(question), F.lit("\n\n"), F.col("content"))
    found = chunks.withColumn("fact", facts(prompt)).where((F.length(F.trim("fact")) > 0) & (F.col("fact") != "NO_RELEVANT_CONTENT"))
    gathered = found.groupBy("query_id").agg(F.min(question).alias(question), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "fact"))), lambda x: x["fact"]), "\n").alias("facts"))
    return gathered.withColumn("answer", answer(F.concat(F.col(question), F.lit("\n\n"), F.col("facts"))))


def compressed(chunks: DataFrame, shorten) -> DataFrame:
    """Chunks shortened by a model; those without relevant content go, those where it fails stay."""
    rows = chunks.withColumn("short", shorten(F.col("content")))
    return rows.where(F.col("short").isNull() | (F.col("short") != "NO_RELEVANT_CONTENT")).withColumn("content", F.coalesce("short", "content")).drop("short")


def navigation(reply: Column) -> Column:
    """reasoning, pages and confidence of a navigation reply; confidence defaults to a half and stays within 0 and 1."""
    part = lambda name, pattern: F.regexp_extract(reply, PART.format(name=name, pattern=pattern), 1)
    confidence = F.coalesce(part("CONFIDENCE", r"([0-9.]+)").try_cast("double"), F.lit(0.5))
    return F.struct(F.trim(part("REASONING", NEXT_PART)).alias("reasoning"), F.trim(part("PAGES", r"([^\n]*)")).alias("pages"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"))


def streamed_words(answers: DataFrame, key: str) -> DataFrame:
    """An answer's words one by one, in order."""
    return answers.select(key, F.posexplode(split_words("answer")).alias("position", "word"))


def context_of(parts: DataFrame, key: str) -> DataFrame:
    """The context of each query: background, memories and sources, in this order and each by position."""
    rank = F.when(F.col("kind") == "background", 0).when(F.col("kind") == "memory", 1).otherwise(2)
    lines = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "position", "content")))
    return parts.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["content"]), "\n\n").alias("context"))


def cascade(paths: list[DataFrame], key: str) -> DataFrame:
    """Results of the first path that answers a query at all: later paths answer only what is left."""
    out = paths[0]
    for later in paths[1:]:
        out = out.unionByName(later.join(out.select(key).distinct(), key, "left_anti"))
    return out


def best_of(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n of each query by score."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "item"))).where(F.col("rank") <= n)


def tool_lines(payload: str) -> str:
    """A tool's JSON result as lines of key and value, without private keys; anything else as it is."""
    try:
        data = json.loads(payload)
    except ValueError:
        return payload
    return "\n".join(f"{k}: {v}" for k, v in data.items() if not k.startswith("_")) if isinstance(data, dict) else payload


def tool_context(payload: Column) -> Column:
    """The same as a column: a JSON object's lines of key and value without private keys; a text that is none as it is, and nothing for null."""
    pairs = F.map_filter(F.from_json(payload, "map<string,string>", {"mode": "PERMISSIVE"}), lambda k, v: ~k.startswith("_"))
    lines = F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")
    return F.when(F.trim(payload).startswith("{") & pairs.isNotNull(), lines).otherwise(payload)
