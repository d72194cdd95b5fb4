"""Running budgets, sessions and percentiles as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def words(text: str = "text"):
    return F.size(T.split_words(text))


#: Cells of a group's values, and rows of a stretch of a group's time.
CELLS, STRETCH = 1024, 4096


def in_cells(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with cell: where a value lies between the least and the greatest of its group. A group that holds much of a table has as many tasks as cells."""
    ends = rows.groupBy(group).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    width = F.col("_high") - F.col("_low")
    cell = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / F.nullif(width, F.lit(0.0)) * CELLS), F.lit(CELLS - 1))).otherwise(0)
    return rows.join(ends, group).withColumn("cell", cell.cast("int")).drop("_low", "_high")


def fit_budget(rows: DataFrame, group: str, score: str, key: str, budget: float = 3000.0) -> DataFrame:
    """Rows by score, highest first, while their estimated tokens, 1.3 a word, stay within the budget. Sums by cell tell which rows can be reached at all; only these are put in order."""
    rows = in_cells(rows.withColumn("_cost", F.round(words() * 1.3, 6)), group, score)
    above = Window.partitionBy(group).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(group, "cell").agg(F.sum("_cost").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(above), F.lit(0.0)))
    within = rows.join(cells.where(F.col("_before") <= budget + 1e-6).select(group, "cell"), [group, "cell"])
    running = F.sum("_cost").over(Window.partitionBy(group).orderBy(F.col(score).desc(), key).rowsBetween(Window.unboundedPreceding, 0))
    return within.withColumn("used", F.round(running, 4)).where(F.col("used") <= budget).drop("_cost", "cell")


def prune_sessions(messages: DataFrame, most: int = 20, budget: int = 4000) -> DataFrame:
    """The newest messages of each conversation within count and token budget; the newest always stays."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tokens = F.floor(words() * 1.3).cast("int")
    rows = messages.withColumn("token_estimate", tokens).withColumn("back", F.row_number().over(newest))
    rows = rows.withColumn("running", F.sum("token_estimate").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("back") == 1) | (F.col("back") <= most) & (F.col("running") <= budget))


def summaries(messages: DataFrame, last: int = 6, chars: int = 200) -> DataFrame:
    """The last messages of each conversation, shortened, in order."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, chars)).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"), F.count("*").alias("n_messages"))


def sessions(events: DataFrame, ttl: int = 3600) -> DataFrame:
    """Sessions of a user: a gap of more than ttl seconds starts one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros("ts") / 1e6
    new = F.when(seconds - F.lag(seconds).over(w) <= ttl, 0).otherwise(1)
    rows = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def in_stretches(events: DataFrame, group: str, carry: int) -> DataFrame:
    """events in stretches of STRETCH rows of a group by time, each behind the last carry rows of the one before (is_carried). Places are counted by hours first."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    rows = events.withColumn("_hour", hour)
    before = Window.partitionBy(group).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy(group, "_hour").count().select(group, "_hour", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_hour").orderBy("ts", "event_id")) - 1
    placed = rows.withColumn("_in", inside).join(hours, [group, "_hour"]).withColumn("place", F.col("_before") + F.col("_in")).drop("_hour", "_in", "_before")
    own = F.floor(F.col("place") / STRETCH)
    both = F.when(F.pmod("place", F.lit(STRETCH)) >= STRETCH - carry, F.array(own, own + 1)).otherwise(F.array(own))
    return placed.select("*", own.alias("_own"), F.explode(both).alias("stretch")).withColumn("is_carried", F.col("stretch") != F.col("_own")).drop("_own")


def sliding_percentile(events: DataFrame, group: str, last: int = 100, p: int = 95) -> DataFrame:
    """A percentile of the last values before and at each event."""
    w = Window.partitionBy(group, "stretch").orderBy("place").rowsBetween(1 - last, 0)
    values = F.array_sort(F.collect_list("value").over(w))
    at = F.least(F.floor(F.size("values") * p / 100), F.size("values") - 1)
    return in_stretches(events, group, last - 1).withColumn("values", values).where("not is_carried").select("event_id", group, F.get("values", at.cast("int")).alias(f"p{p}"))


#: Windows in a stretch of time that one task counts.
SPANS = 16


def requests_in_window(events: DataFrame, client: str, seconds: int = 60, most: int = 100) -> DataFrame:
    """Requests of a client within the last seconds, and whether they stay within the limit. A client's time is cut into stretches of SPANS windows, each behind the last window of the one before, so that no task holds a whole history."""
    span = seconds * 1_000_000
    rows = events.withColumn("_at", F.unix_micros("ts")).withColumn("_own", F.floor(F.col("_at") / (span * SPANS)))
    late = F.col("_at") + span >= (F.col("_own") + 1) * (span * SPANS)
    dealt = rows.withColumn("_stretch", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(client, "_stretch").orderBy("_at").rangeBetween(-span, 0)
    counted = dealt.withColumn("in_window", F.count("*").over(w)).where(F.col("_stretch").eqNullSafe(F.col("_own"))).drop("_at", "_own", "_stretch")
    return counted.withColumn("allowed", F.col("in_window") <= most)


def histogram(events: DataFrame, group: str) -> DataFrame:
    """Count, least, most, mean and the 99th percentile by rank of each group's values. Counts by cell tell where the rank lies; only that cell's distinct values are put in order."""
    rows = events.where("value is not null").select(group, "value")
    counted = in_cells(rows.groupBy(group, "value").count(), group, "value")
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy(group, "cell").agg(F.sum("count").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    totals = rows.groupBy(group).agg(F.count("*").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean"))
    rank = F.least(F.floor(F.col("n_values") * 0.99), F.col("n_values") - 1)
    place = cells.join(totals.select(group, rank.alias("_rank")), group).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    up_to = F.col("_before") + F.sum("count").over(Window.partitionBy(group).orderBy("value"))
    near = counted.join(place.select(group, "cell", "_before", "_rank"), [group, "cell"]).withColumn("_up_to", up_to)
    p99 = near.where(F.col("_rank") < F.col("_up_to")).groupBy(group).agg(F.min("value").alias("p99"))
    return totals.join(p99, group)


def as_of(facts: DataFrame, moments: DataFrame, key: str) -> DataFrame:
    """Facts that are valid at each moment of their key: valid_from <= moment < valid_to, open ends included. An interval join behind an equi-join."""
    on = (facts[key] == moments[key]) & (facts.valid_from <= moments.moment) & (moments.moment < F.coalesce(facts.valid_to, F.lit("9999-01-01").cast("timestamp")))
    return moments.join(facts, on).drop(facts[key])
