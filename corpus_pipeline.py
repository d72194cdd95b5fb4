"""A training corpus from raw documents: toxic documents go, repeated runs of lines are cut out, one document of each group of
near duplicates stays, sources are mixed to target weights, and the result is tokenized and packed into sequences.

Defined cases, at each stage: a null or empty text is a document without words, which is kept as it is up to the mix, where it
is never drawn; a null doc_id is a document of its own, the last in order; rows equal in doc_id and text are kept up to the
near-duplicate stage, which leaves one; a document that line dedup would leave with 15 percent of its words or fewer stays whole; an empty table
gives no rows; very long texts are taken whole, and packing cuts them into sequences; columns besides doc_id, text and source
pass unchanged up to packing, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.lines import without_repeats
from quarry.llm.mixing import drawn
from quarry.llm.nearness import one_of_each
from quarry.llm.packing import pack
from quarry.llm.queries import read, vocabulary
from quarry.llm.staging import stored
from quarry.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # what would lose nearly all its words is a copy as a whole, for the next stage to decide on
    return without_repeats(docs, spare=85)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, size=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix, columns = drawn(docs, shards=16, weights=(1, 2, 3), ceiling=3)
    # each shard in shuffled order; a slice of the order at a time, so that a shard isn't one task's work
    part = F.pmod("place", F.lit(32))
    return mix.repartition("shard", part).sortWithinPartitions("shard", "place").select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary(), size=2048, end=0)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Label model, rolling hashes and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
