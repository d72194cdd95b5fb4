"""Mutation of tables: upsert, delete, incremental difference, history; and the caches' replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of new in place of old ones with their key. Of several new rows with a key the last one in order wins."""
    new = latest(new, key, [o.desc() if isinstance(o, Column) else F.col(o).desc() for o in order])
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def latest(versions: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last version of each key."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """What the condition doesn't hold for; unknown isn't deleted."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def difference(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """What an incremental load does with each chunk: reuse equal ones, insert new ones, drop orphans. One full join on the digest."""
    a = old.select(digest, F.col(key).alias("old_key")).dropDuplicates([digest])
    b = new.select(digest, F.col(key).alias("new_key")).dropDuplicates([digest])
    action = F.when(F.col("old_key").isNull(), "insert").when(F.col("new_key").isNull(), "orphan").otherwise("reuse")
    return a.join(b, digest, "full").withColumn("action", action)


def add_triplets(old: DataFrame, new: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Triplets keyed by what they say within a scope (team, namespace), whatever the case; a known one isn't added again, and of several that say the same the first in order stays."""
    said = ["subject", "predicate", "object"]
    key = F.sha2(F.concat_ws("\x1f", *scope, *(F.lower(c) for c in said)), 256)
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("triplet_id", key)
    return latest(every, ["triplet_id"], ["_new", *said]).drop("_new")


def entities(triplets: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Entities that triplets name, each once in its scope."""
    return triplets.select(*scope, F.explode(F.array("subject", "object")).alias("name")).where("name != ''").distinct()


def set_payload(df: DataFrame, condition: Column, values: dict[str, str]) -> DataFrame:
    """Keys of a payload map set on the rows that the condition holds for."""
    new = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    kept = F.map_filter("payload", lambda k, v: ~k.isin(*values))
    return df.withColumn("payload", F.when(F.coalesce(condition, F.lit(False)), F.map_concat(kept, new)).otherwise(F.col("payload")))


def ttl_replay(events: DataFrame, key: str, ttl: int = 300) -> DataFrame:
    """Which requests a cache answers: those within ttl seconds of the last one for the key that it didn't answer. A longer gap always empties the entry, so a fold runs only over the requests between two such gaps."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros("ts")
    gap = F.coalesce(at - F.lag(at).over(w) > ttl * 1_000_000, F.lit(True))
    runs = events.select(key, "event_id", "ts", at.alias("at"), gap.cast("int").alias("gap")).withColumn("run", F.sum("gap").over(w))
    times = F.array_sort(F.collect_list(F.struct("at", "event_id")))
    start = F.struct(F.lit(None).cast("long").alias("filled"), F.array().cast("array<struct<event_id:long,hit:boolean>>").alias("out"))

    def step(state, x):
        hit = F.coalesce(x["at"] - state["filled"] <= ttl * 1_000_000, F.lit(False))
        row = F.struct(x["event_id"].alias("event_id"), hit.alias("hit"))
        return F.struct(F.when(hit, state["filled"]).otherwise(x["at"]).alias("filled"), F.array_append(state["out"], row).alias("out"))

    return runs.groupBy(key, "run").agg(times.alias("times")).select(key, F.inline(F.aggregate("times", start, step, lambda s: s["out"])))


def cascade(requests: DataFrame, tiers: dict[str, DataFrame], key: str) -> DataFrame:
    """The first tier that has a request's key, with its value; the others are misses."""
    out = requests
    for name, tier in tiers.items():
        out = out.join(tier.select(key, F.col("value").alias(f"value_{name}")).dropDuplicates([key]), key, "left")
    values = [F.col(f"value_{n}") for n in tiers]
    tier = F.coalesce(*(F.when(v.isNotNull(), n) for n, v in zip(tiers, values, strict=True)), F.lit("MISS"))
    return out.withColumns({"cache_tier": tier, "value": F.coalesce(*values)}).drop(*(f"value_{n}" for n in tiers))


def query_table(df: DataFrame, columns: list[str], where: str | None = None, value=None, limit: int | None = 50, order: str | None = None) -> DataFrame:
    """Projection with one equality of a table tool, its first rows in an order if one is given; names are checked against the schema."""
    unknown = [c for c in [*columns, *(c for c in (where, order) if c)] if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    rows = df if where is None or value in (None, "") else df.where(F.col(where) == value)
    out = (rows.orderBy(order) if order else rows).select(*columns)
    return out if limit is None else out.limit(limit)


def describe(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table: name, type, whether null is allowed."""
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string, is_nullable boolean")
