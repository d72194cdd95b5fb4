"""Timed sessions of users with very many of them, against a step-by-step version."""

import datetime as dt
import random

from quarry.streaming import jobs

GAP, LATE = 3600, 86_400
HOUR = 3_600_000_000
START = 1_704_067_200_000_000
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def spans(times):
    """Start, end and number of each stretch without a gap."""
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= GAP * 1_000_000:
            out[-1] = out[-1][0], t, out[-1][2] + 1
        else:
            out.append((t, t, 1))
    return out


def closed(runs):
    """Sessions given after each run, by rows (user, microseconds): rows behind the watermark don't count, then it moves on and closes sessions."""
    held, mark, latest, out = {}, 0, 0, set()
    for rows in runs:
        for user, t in rows:
            if t > mark * 1000:
                held.setdefault(user, []).append(t)
            latest = max(latest, t)
        mark = max(mark, latest // 1000 - LATE * 1000)
        for user, times in held.items():
            over = [s for s in spans(times) if (s[1] + GAP * 1_000_000) // 1000 + 1 <= mark]
            out |= {(user, *s) for s in over}
            held[user] = [t for t in times if not any(a <= t <= b for a, b, _ in over)]
        yield set(out)


def timed(spark, path):
    """Runs the stream to its end; all sessions given so far, and the timers registered."""
    stream = jobs.timed_sessions(jobs.event_stream(spark, f"{path}/events", glob="part-*"), gap=GAP, late=f"{LATE} seconds")
    for k, v in jobs.ROCKS.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k in jobs.ROCKS:
            spark.conf.unset(k)
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"]]
    return {tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{path}/rows").collect()}, sum(timers), len(timers)


def test_a_user_has_one_timer_however_many_sessions(spark, tmp_path):
    draw = random.Random(5)
    path = f"file://{tmp_path}"
    # user 1: more rows than come at once, in over 10,000 sessions of one to three rows; the others: few
    many = [(1, START + 3 * HOUR * i + draw.randrange(HOUR)) for i in range(10_500) for _ in range(draw.randrange(1, 4))]
    few = [(u, START + draw.randrange(10_000 * HOUR)) for u in range(2, 8) for _ in range(60)]
    last = max(t for _, t in many)
    near = [(u, last + draw.randrange(-30 * HOUR, 2 * HOUR)) for u in range(1, 10) for _ in range(20)]  # some are late, some lie between rows of the run before
    end = [(1, last + 200 * HOUR), (10, last + 200 * HOUR)]
    runs = [many + few, near, end]
    for rows in runs:
        draw.shuffle(rows)
    for k, (rows, want) in enumerate(zip(runs, closed(runs), strict=True)):
        spark.createDataFrame([(i, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t), u, "view", 0.0, None) for i, (u, t) in enumerate(rows)], EVENT).coalesce(1).write.parquet(f"{path}/events/part-{k}")
        got, timers, batches = timed(spark, path)
        assert got == want
        assert timers <= batches * 10  # users; it was one for each session
    assert len(got) > 10_500
