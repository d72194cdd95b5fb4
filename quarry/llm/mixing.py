"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Targets share all words by weight; one above its ceiling is cut there and the excess is shared again. A source's documents lie in
blocks, by hash, as many as its share of all words asks for. Its blocks are drawn in a permuted order, round by round with a
new permutation, until their words reach the target; the last block drawn gives only what is still missing. A tree of
halvings deals each source's drawn blocks out among the output shards by multivariate-hypergeometric draws; a shard takes the
next blocks of each source's order, so shards are disjoint, and a hash orders the documents within a shard. What the mix takes
of a document is the sum over the draws of its block.

Sources stay in Spark, however many: their ranks come from sorted partitions, the price that all targets share from one sum a
round, and the tree splits groups of sources on the driver and the sources of a group in a task, which is the same
distribution. Blocks are bounded by BLOCKS and the number of sources.

Defined cases: a null or blank text has no words and is never drawn; a null source is a source of its own, the last; null
doc_ids and repeated rows are documents of their own; ties of the permutation order by block, and within one by document; a
source without words has target 0; an empty table gives no rows; only documents of a source's last block may be left out of it or,
one of them, taken in part; other columns pass, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import carried, stored, with_text

WORDS = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Blocks of all sources together, about, and groups of sources that the driver splits.
BLOCKS, GROUPS = 1 << 15, 1 << 10
#: Tables of sources or blocks up to so many rows are broadcast; larger ones are joined.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def even(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def split(quotas: list[int], totals: list[int], seed: int) -> np.ndarray:
    """Blocks of each source (row) in each shard (column), with these totals by shard: recursive halving with hypergeometric draws."""
    out = np.zeros((len(quotas), len(totals)), np.int64)

    def halve(counts: np.ndarray, a: int, b: int) -> None:
        if b - a == 1 or not counts.sum():
            out[:, a] = counts
            return
        mid = (a + b) // 2
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(counts, sum(totals[a:mid]), method="marginals")
        halve(left, a, mid)
        halve(counts - left, mid, b)

    halve(np.array(quotas, np.int64), 0, len(totals))
    return out


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, by source with null last: places within sorted partitions, behind what the partitions before hold."""
    ordered = sources.withColumn("none", F.col("source") == "").repartitionByRange("none", "source").sortWithinPartitions("none", "source")
    ordered = stored(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "mix-ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("none", "part", "at", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...], ceiling: int) -> DataFrame:
    """source, source_size, rank, target: the words of all sources shared by weight, none above ceiling times its size."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = stored(ranked(sizes).withColumn("weight", weight), "mix-sources")
    words, every = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).head()
    unit, n_full = words / every if every else 0.0, -1
    while True:
        full = F.lit(unit) * F.col("weight") > ceiling * F.col("source_size")
        taken, rest, n = sources.agg(F.sum(F.when(full, ceiling * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).head()
        if n == n_full or not rest:
            return sources.withColumn("target", F.when(full, (ceiling * F.col("source_size")).cast("double")).otherwise(F.lit(unit) * F.col("weight"))).drop("weight")
        unit, n_full = (words - (taken or 0)) / rest, n


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns of docs), size in words, a source that is never null, and key, which orders and deals documents."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return carried(docs).select(
        "row",
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("row.source")), F.lit("")).alias("source"),
        F.xxhash64(F.lit(seed), F.col("row.doc_id"), text).alias("key"),
    )


def dealt(blocks: DataFrame, shards: int, ceiling: int, seed: int) -> DataFrame:
    """Draws of each block (source, block, words, quota, source_size, rank): how many of its words, in which epoch and for which shard."""
    rounds = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(ceiling - 1)))).withColumn("turn", F.xxhash64(F.lit(seed), "source", "block", "epoch"))
    before = Window.partitionBy("source", "epoch").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("epoch") * F.col("source_size") + F.coalesce(F.sum("words").over(before), F.lit(0))
    draws = rounds.withColumn("take", F.least(F.col("words"), F.col("quota") - first)).where("take > 0")
    draws = stored(draws.withColumn("number", F.row_number().over(Window.partitionBy("source").orderBy("epoch", "turn", "block")) - 1), "mix-draws")
    quotas = draws.groupBy("source", "rank").agg(F.count("*").alias("n")).withColumn("group", F.pmod("rank", F.lit(GROUPS)).cast("int"))
    groups = sorted((r[0], r[1]) for r in quotas.groupBy("group").agg(F.sum("n")).collect())  # at most GROUPS
    table = split([n for _, n in groups], even(sum(n for _, n in groups), shards), seed).tolist() if groups else []
    of_group = {g: row for (g, _), row in zip(groups, table, strict=True)}

    def within(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank")
        group = int(df["group"].iloc[0])
        bounds = split(df["n"].tolist(), of_group[group], seed + 1 + group).cumsum(axis=1).tolist()
        return pd.DataFrame({"source": df["source"], "bounds": bounds})

    bounds = quotas.groupBy("group").applyInPandas(within, "source string, bounds array<long>")
    shard = F.size(F.filter("bounds", lambda b: b <= F.col("number")))
    found = draws.join(bounds, "source").select("source", "block", F.struct("epoch", shard.alias("shard"), "take", "words").alias("draw"))
    return found.groupBy("source", "block").agg(F.sort_array(F.collect_list("draw")).alias("found"))


def mixed(rows: DataFrame, shards: int = 16, weights: tuple[float, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 17) -> DataFrame:
    """rows: a stored table of sized(). Adds source_size, target and draws (shard, block, epoch, words, place)."""
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling), "mix-targets")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    sources = sources.withColumn("quota", F.least(F.round("target").cast("long"), ceiling * F.col("source_size")))
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") * F.lit(BLOCKS / max(words, 1)))).cast("int"))
    rows = rows.join(small(sources), "source").withColumn("block", F.pmod("key", F.col("blocks")).cast("int"))
    blocks = rows.groupBy("source", "block", "quota", "source_size", "rank").agg(F.sum("size").alias("words")).where("words > 0")
    found = stored(dealt(stored(blocks, "mix-blocks"), shards, ceiling, seed), "mix-found")
    rows = rows.join(small(found), ["source", "block"], "left")
    cut = F.coalesce(F.exists("found", lambda d: d["take"] < d["words"]), F.lit(False))
    order = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # one block of a source at most
    placed = rows.where(~cut).withColumn("within", F.lit(0).cast("long")).unionByName(rows.where(cut).withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0))))

    def draw(d):
        some = F.when(d["take"] < d["words"], F.greatest(F.lit(0), F.least(F.col("size"), d["take"] - F.col("within")))).otherwise(F.col("size"))
        return F.struct(d["shard"].alias("shard"), F.col("block").alias("block"), d["epoch"].alias("epoch"), some.alias("words"), F.xxhash64(F.lit(seed), F.col("key"), d["epoch"]).alias("place"))

    draws = F.filter(F.transform(F.coalesce("found", F.array().cast("array<struct<epoch:int,shard:int,take:bigint,words:bigint>>")), draw), lambda d: d["words"] > 0)
    return placed.select("row", "size", "source_size", "target", draws.alias("draws"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: its words and those that the mix takes of it, by the draws of its block."""
    rows = stored(sized(docs.select("doc_id", "text", "source"), options.get("seed", 17)).withColumn("row", F.struct("row.doc_id")), "mix-rows")
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return mixed(rows, **options).select("row.doc_id", "size", "source_size", "target", words.alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"), F.transform("draws", lambda d: d["words"]).alias("shard_words"))


def drawn(docs: DataFrame, **options) -> tuple[DataFrame, list]:
    """The mix itself: row, text, shard and place of each draw, and the columns of docs with that text; order by shard and place."""
    rows = stored(sized(docs, options.get("seed", 17)), "mix-rows")
    out = mixed(rows, **options).select("row", "size", F.explode("draws").alias("draw")).withColumn("text", F.col("row.text"))
    skip = F.when(F.col("text").rlike("^" + BLANKS), 1).otherwise(0)
    rest = F.element_at(F.split("text", BLANKS, (F.col("draw.words") + skip + 1).cast("int")), -1)
    text = F.when(F.col("draw.words") < F.col("size"), F.expr("left(text, length(text) - length(rest))")).otherwise(F.col("text"))
    out = out.withColumn("rest", rest).select("row", text.alias("text"), "draw.shard", "draw.place")
    return out, with_text(F.col("text"), docs)
