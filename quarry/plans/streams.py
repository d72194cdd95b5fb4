"""Streaming queries over the whole events table, run to its end. Sinks and checkpoints lie in the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.stored import place
from ..streaming import jobs
from .base import query


def folder(spark) -> str:
    """A new folder below the shared one."""
    return place(spark, "stream")


def run(spark, stream, mode="append"):
    path = folder(spark)
    jobs.finished(stream, f"{path}/rows", f"{path}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


RATE = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, [t] AS times, true AS allowed FROM o WHERE n = 1
          UNION ALL SELECT o.user_id, o.event_id, o.n,
            CASE WHEN len(list_filter(r.times, lambda x: x > o.t - 14400000000)) < 2 THEN list_append(list_filter(r.times, lambda x: x > o.t - 14400000000), o.t) ELSE list_filter(r.times, lambda x: x > o.t - 14400000000) END,
            len(list_filter(r.times, lambda x: x > o.t - 14400000000)) < 2
          FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, event_id, allowed FROM r"""


@query(RATE)
def rate_limit_exact(spark, sf_dir):
    return run(spark, jobs.limited(jobs.event_stream(spark, sf_dir), most=2, seconds=4 * 3600))


BREAKER = """WITH RECURSIVE o AS (SELECT user_id, event_id, event_type = 'error' AS bad, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, 'closed' AS condition, 0 AS failed, 0 AS passed, CAST(0 AS BIGINT) AS opened FROM events
          UNION ALL SELECT user_id, event_id, n,
            CASE WHEN trips THEN 'open' WHEN NOT bad AND now = 'half_open' AND passed + 1 >= 2 THEN 'closed' ELSE now END,
            CASE WHEN now = 'open' THEN failed WHEN trips THEN 0 WHEN bad THEN failed + 1 WHEN now = 'half_open' AND passed + 1 < 2 THEN failed ELSE 0 END,
            CASE WHEN NOT bad AND now = 'half_open' THEN passed + 1 ELSE passed END,
            CASE WHEN trips THEN t ELSE opened END
          FROM (SELECT *, now <> 'open' AND bad AND (now = 'half_open' OR failed + 1 >= 2) AS trips
                FROM (SELECT o.user_id, o.event_id, o.n, o.bad, o.t, r.failed, r.opened,
                        CASE WHEN r.condition = 'open' AND o.t - r.opened >= 7200000000 THEN 'half_open' ELSE r.condition END AS now,
                        CASE WHEN r.condition = 'open' AND o.t - r.opened >= 7200000000 THEN 0 ELSE r.passed END AS passed
                      FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)))
    SELECT user_id, event_id, condition FROM r WHERE n > 0"""


@query(BREAKER)
def circuit_breaker(spark, sf_dir):
    return run(spark, jobs.breakers(jobs.event_stream(spark, sf_dir), failures=2, rest=7200, successes=2))


TRIED = "CASE WHEN event_type <> 'error' THEN 1 WHEN value < 20 THEN 4 ELSE 1 + event_id % 4 END"


@query(f"SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' AND value < 20 THEN 'failed' ELSE 'rows' END AS outcome, CAST({TRIED} AS INTEGER) AS attempts FROM events")
def stream_ingest(spark, sf_dir):
    """Errors succeed after some attempts, and those of small value never: these are set aside after three retries."""
    table = f"{folder(spark)}/table"

    def work(rows):
        needed = F.when(F.col("event_type") != "error", 1).when(F.col("value") < 20, 99).otherwise(1 + F.col("event_id") % 4)
        return rows.withColumn("ok", F.col("attempt") >= needed)

    jobs.ingest(jobs.event_stream(spark, sf_dir), table, f"{table}-checkpoint", work=work, unit=0.2)
    out = [spark.read.parquet(f"{table}/{name}").select("user_id", "event_id", "event_type", F.lit(name).alias("outcome"), F.col("attempt").alias("attempts")) for name in ("rows", "failed")]
    return out[0].unionByName(out[1])


SPANS = """o AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id, ts FROM events),
    g AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o)"""


@query(f"""WITH {SPANS} SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS n_events FROM g GROUP BY user_id, session
    HAVING (max(t) + 3600000000) // 1000 + 1 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 86400000""")
def timed_sessions(spark, sf_dir):
    """Sessions that timers have closed when the stream has ended: all but those whose gap reaches into the last day."""
    return run(spark, jobs.timed_sessions(jobs.event_stream(spark, sf_dir), gap=3600, late="1 day"))


RESPONSES = "r AS (SELECT user_id, event_id AS response_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, event_id AS score_id, ts, value AS score FROM events WHERE event_type = 'click')"


@query(f"""WITH {RESPONSES}, w AS (SELECT least((SELECT max(ts) FROM r), (SELECT max(ts) FROM s)) - INTERVAL 1 DAY AS mark),
    j AS (SELECT r.user_id, response_id, r.ts, score_id, score FROM r LEFT JOIN s ON s.user_id = r.user_id AND s.ts >= r.ts AND s.ts <= r.ts + INTERVAL 6 HOUR)
    SELECT user_id, response_id, score_id, score FROM j, w WHERE score_id IS NOT NULL OR ts + INTERVAL 6 HOUR < mark""")
def stream_evaluation(spark, sf_dir):
    """Purchases stand for responses and clicks for the scores that a judge gives them within six hours: two streams, joined behind two watermarks."""
    events = lambda: jobs.event_stream(spark, sf_dir)
    responses = events().where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("response_id"), "ts")
    scores = events().where("event_type = 'click'").select("user_id", F.col("event_id").alias("score_id"), "ts", F.col("value").alias("score"))
    rows = run(spark, jobs.evaluated(responses, scores, within="6 hours", late="1 day"))
    return rows.select("user_id", "response_id", "score_id", "score")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(spark, sf_dir):
    """Every event is delivered twice, by two sources of one stream, and counts once."""
    events = jobs.event_stream(spark, sf_dir).unionByName(jobs.event_stream(spark, sf_dir))
    return run(spark, jobs.once(events, "event_id", late="40 days")).select("event_id", "user_id", "event_type")
