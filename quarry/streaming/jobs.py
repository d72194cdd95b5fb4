"""Structured Streaming jobs: rate limits, circuit breakers, sessions and incremental ingestion, with state in Spark."""

from __future__ import annotations

import time
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed value: rows in a table that a processor gives at once
ROWS = 10_000

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, glob: str = "events.parque[t]", files: int = 100) -> DataFrame:
    """The events table as a stream of its files; a glob finds a single file as well as a folder of files."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(f"{path}/{glob}")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def by_clock(stream: DataFrame) -> bool:
    """Whether a stream has state that expires by the clock."""
    plan = stream._jdf.queryExecution().analyzed().toString()
    return "TransformWithState" in plan and "ProcessingTime" in plan


def finished(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is into Parquet files, with its state in RocksDB. State that expires by the clock asks for batches without rows for ever: there, the run ends with the last row."""
    spark = stream.sparkSession
    settings = ROCKS | {"spark.sql.streaming.noDataMicroBatches.enabled": str(not by_clock(stream)).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: State with lists, maps, timers and expiry is kept in RocksDB.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def in_order(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """Rows of one key and micro-batch by time and id, as tuples of microseconds, id and the other columns; only these columns are held, as arrays."""
    parts = [(b["ts"].to_numpy().astype("datetime64[us]").astype("int64"), b["event_id"].to_numpy(), *(b[c].to_numpy() for c in columns)) for b in batches]
    held = [np.concatenate(p) for p in zip(*parts, strict=True)]
    order = np.lexsort((held[1], held[0]))
    return zip(*(h[order].tolist() for h in held), strict=True)


class Limiter(StatefulProcessor):
    """Which requests of a user are let through. State: a list of the times let through within the window, which is gone when the user has been idle for as long."""

    def __init__(self, most: int, seconds: int, idle: int | None = None):
        self.most, self.span, self.idle = most, seconds * 1_000_000, (idle or seconds) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, out = deque(t[0] for t in self.times.get()), []
        for now, event_id in in_order(rows):
            while times and times[0] <= now - self.span:
                times.popleft()
            ok = len(times) < self.most
            if ok:
                times.append(now)
            out.append((key[0], event_id, ok))
        self.times.put([(t,) for t in times])
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, most: int = 100, seconds: int = 60, idle: int | None = None) -> DataFrame:
    """Exact sliding-window rate limiter per user: a request counts only if it was let through. A user who sends nothing for so long (the window, or idle seconds) has no state."""
    rows = stream.select("user_id", "event_id", "ts").groupBy("user_id")
    return rows.transformWithStateInPandas(Limiter(most, seconds, idle), "user_id long, event_id long, allowed boolean", "Append", "ProcessingTime")


class Breaker(StatefulProcessor):
    """Condition of a user's circuit breaker after each request. State: condition, failures and successes counted, and when it opened."""

    def __init__(self, failures: int, rest: int, successes: int, idle: int):
        self.failures, self.rest, self.successes, self.idle = failures, rest * 1_000_000, successes, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "condition string, failed int, passed int, opened long", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        condition, failed, passed, opened = self.state.get() if self.state.exists() else ("closed", 0, 0, 0)
        out = []
        for now, event_id, kind in in_order(rows, "event_type"):
            if condition == "open" and now - opened >= self.rest:
                condition, passed = "half_open", 0
            if condition != "open":
                if kind == "error":
                    failed += 1
                    if condition == "half_open" or failed >= self.failures:
                        condition, opened, failed = "open", now, 0
                elif condition == "half_open":
                    passed += 1
                    if passed >= self.successes:
                        condition, failed = "closed", 0
                else:
                    failed = 0
            out.append((key[0], event_id, condition))
        self.state.update((condition, failed, passed, opened))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "condition"])

    def close(self) -> None:
        pass


def breakers(stream: DataFrame, failures: int = 5, rest: int = 30, successes: int = 2, idle: int = 86_400) -> DataFrame:
    """Circuit breaker per user: so many failures open it, after a rest it is half open, and successes in a row close it. It is forgotten after idle seconds without a request."""
    rows = stream.select("user_id", "event_id", "ts", "event_type").groupBy("user_id")
    return rows.transformWithStateInPandas(Breaker(failures, rest, successes, idle), "user_id long, event_id long, condition string", "Append", "ProcessingTime")


class Sessions(StatefulProcessor):
    """Sessions of a user, given when they are over. State: start, end and number of rows of the open ones, in order, as one array of three rows. A user has one timer, at the time from which no row can prolong the first of them: it closes all that the watermark has passed, whether or not the user comes back."""

    def __init__(self, gap: int):
        self.gap = gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans binary")

    def _held(self) -> np.ndarray:
        state = self.open.get()
        return np.frombuffer(state[0] if state else b"", "<i8").reshape(3, -1)

    def _over(self, spans: np.ndarray) -> list[int]:
        """Milliseconds from which on rows lie behind a session and its gap."""
        return ((spans[1] + self.gap) // 1000 + 1).tolist()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        parts = [held]
        for batch in rows:  # a batch becomes few spans, so its rows aren't kept
            at = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            parts.append(self._merged(np.stack((at, at, np.ones_like(at)))))
            if sum(p.shape[1] for p in parts[1:]) > parts[0].shape[1]:  # by then it has doubled, so spans are sorted few times
                parts = [self._merged(np.concatenate(parts, axis=1))]
        now = self._merged(np.concatenate(parts, axis=1))
        before, after = self._over(held[:, :1]), self._over(now[:, :1])
        if before != after:
            for t in before:
                self.handle.deleteTimer(t)
            for t in after:
                self.handle.registerTimer(t)
        self.open.update((now.tobytes(),))
        return iter(())

    def _merged(self, spans: np.ndarray) -> np.ndarray:
        """Spans in order, those within the gap as one."""
        spans = spans[:, np.argsort(spans[0], kind="stable")]
        reached = np.maximum.accumulate(spans[1])
        first = np.flatnonzero(np.concatenate(([True], spans[0, 1:] - reached[:-1] > self.gap)))
        return np.stack((spans[0, first], reached[np.append(first[1:], len(reached)) - 1], np.add.reduceat(spans[2], first)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        k = bisect_right(over := self._over(held), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        for i in range(0, k, ROWS):
            started, ended, n = held[:, i : min(i + ROWS, k)]
            yield pd.DataFrame({"user_id": key[0], "started": started, "ended": ended, "n_events": n})
        if k < len(over):
            self.open.update((held[:, k:].tobytes(),))
            self.handle.registerTimer(over[k])
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def timed_sessions(stream: DataFrame, gap: int = 3600, late: str = "1 day") -> DataFrame:
    """user_id, started, ended (microseconds), n_events of sessions, each as soon as the watermark has passed its end and the gap: a gap of exactly that length doesn't end it."""
    rows = stream.withWatermark("ts", late).select("user_id", "ts").groupBy("user_id")
    return rows.transformWithStateInPandas(Sessions(gap), "user_id long, started long, ended long, n_events long", "Append", "EventTime")


def evaluated(responses: DataFrame, scores: DataFrame, within: str = "1 hour", late: str = "1 day", late_scores: str | None = None) -> DataFrame:
    """Responses (user_id, response_id, ts) with the scores (user_id, score_id, ts, score) that come for them within a time; a response without any is given once the watermarks of both streams have passed that time."""
    left = responses.select("user_id", "response_id", F.col("ts").alias("response_ts")).withWatermark("response_ts", late)
    right = scores.select(F.col("user_id").alias("of_user"), "score_id", F.col("ts").alias("score_ts"), "score").withWatermark("score_ts", late_scores or late)
    soon = F.expr(f"of_user = user_id AND score_ts >= response_ts AND score_ts <= response_ts + INTERVAL {within}")
    return left.join(right, soon, "left_outer").drop("of_user")


def session_counts(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events in each session of a user, by session windows behind a watermark."""
    marked = stream.withWatermark("ts", late)
    rows = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return rows.select("user_id", F.col("w.start").alias("started"), "n_events")


def once(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """At-least-once deliveries without their repetitions."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def attempt(rows: DataFrame, table: str, number: int, work, retries: int, unit: float = 2.0, held: DataFrame | None = None) -> None:
    """One round over rows with their attempt: those that succeed are stored, those that fail wait until they are due, which is twice as long after each attempt, or are set aside after the last. work adds ok, which may depend on the attempt; held are rows that wait on. A round overwrites its own folders alone, so a repeated one changes nothing."""
    spark = rows.sparkSession
    done = work(rows).withColumn("ok", F.coalesce("ok", F.lit(False)))
    last = F.col("attempt") > retries
    delay = F.least(F.lit(unit) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(30 * unit))
    place = {"rows": F.col("ok"), "waiting": ~F.col("ok") & ~last, "failed": ~F.col("ok") & last}
    tried = f"{table}/tried/round={number}"
    kinds = F.when(place["rows"], "rows").when(place["waiting"], "waiting").otherwise("failed")
    due = F.unix_micros(F.current_timestamp()) + F.round(delay * 1_000_000).cast("long")
    done.withColumns({"outcome": kinds, "due": F.when(place["waiting"], due)}).drop("ok").write.mode("overwrite").parquet(tried)
    told = spark.read.parquet(tried)
    for name in place:
        out = told.where(F.col("outcome") == name).drop("outcome", *(() if name == "waiting" else ("due",)))
        if name == "waiting" and held is not None:
            out = out.unionByName(held)
        out.write.mode("overwrite").parquet(f"{table}/{name}/round={number}")


def waiting(spark: SparkSession, table: str, number: int, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a round that wait: those that are due now (microseconds), for their next attempt, and those that wait on."""
    rows = spark.read.parquet(f"{table}/waiting/round={number}")
    is_due = F.col("due") <= (time.time_ns() // 1000 if now is None else now)
    return rows.where(is_due).drop("due").withColumn("attempt", F.col("attempt") + 1), rows.where(~is_due)


def ingest(stream: DataFrame, table: str, checkpoint: str, retries: int = 3, work=lambda rows: rows.withColumn("ok", F.lit(True)), late: str = "1 day", unit: float = 2.0) -> int:
    """Stores a stream's rows, each content once within the time that a row may be late; what fails is tried again when it is due, with a later batch or behind the last one, until nothing waits. Returns the number of rounds."""
    spark, rounds = stream.sparkSession, []
    fresh = stream.withColumn("digest", F.md5(F.to_json(F.struct(*stream.columns)))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])

    def batch(df: DataFrame, number: int) -> None:
        rows, held = df.withColumn("attempt", F.lit(1)), None
        if number:  # the batch before has left its folder
            due, held = waiting(spark, table, number - 1)
            rows = rows.unionByName(due)
        attempt(rows, table, number, work, retries, unit, held)
        rounds.append(number)

    fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    number = max(rounds, default=-1)
    while number >= 0:
        first = spark.read.parquet(f"{table}/waiting/round={number}").agg(F.min("due")).head()[0]
        if first is None:
            break
        time.sleep(max(0.0, first / 1e6 - time.time()))
        due, held = waiting(spark, table, number)
        number += 1
        attempt(due, table, number, work, retries, unit, held)
    return number + 1
