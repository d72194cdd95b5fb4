"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Tables of texts, whose rows are much work.
TEXTS = ("documents", "conversations", "pages", "benchmark")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Texts that lie in fewer files than there are cores are dealt to all of them; larger tables have more files, and nothing is moved."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in TEXTS and len(df.inputFiles()) < cores else df


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
