"""Streams with timers, expiry and two watermarks, batch by batch."""

import datetime as dt
import time

import pandas as pd
import pytest

from quarry.streaming import jobs

START = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def write(spark, path, number, rows):
    """One file of events: (id, minute, user, kind, value)."""
    spark.createDataFrame([(i, at(m), u, k, v, None) for i, m, u, k, v in rows], EVENT).coalesce(1).write.mode("overwrite").parquet(f"{path}/part-{number}")


def run(spark, stream, path, name):
    jobs.finished(stream, f"{path}/{name}-rows", f"{path}/{name}-checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}-rows")


@pytest.fixture
def events(spark, tmp_path):
    source = f"file://{tmp_path}/events"
    return source, f"file://{tmp_path}", lambda: jobs.event_stream(spark, source, glob="part-*")


def test_timers_close_sessions_of_users_who_stay_away(spark, events):
    source, path, stream = events
    sessions = lambda: run(spark, jobs.timed_sessions(stream(), gap=3600, late="30 minutes"), path, "s")
    us = lambda m: int((at(m) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    # out of order, two sessions that a later row joins, a gap of exactly an hour
    write(spark, source, 1, [(1, 70, 1, "view", 0.0), (2, 0, 1, "view", 0.0), (3, 130, 1, "view", 0.0), (4, 5, 2, "view", 0.0)])
    got = {tuple(r) for r in sessions().collect()}
    assert got == {(2, us(5), us(5), 1), (1, us(0), us(0), 1)}  # the watermark stands at 100: both are over, without another row
    write(spark, source, 2, [(5, 125, 1, "view", 0.0), (6, 40, 1, "view", 0.0), (7, 600, 3, "view", 0.0)])
    got = {tuple(r) for r in sessions().collect()}
    # row 6 is late and dropped; rows 1 and 3 are an hour apart, which is one session, and row 5 lies between them
    assert got == {(2, us(5), us(5), 1), (1, us(0), us(0), 1), (1, us(70), us(130), 3)}
    write(spark, source, 3, [(8, 2000, 3, "view", 0.0)])
    assert (3, us(600), us(600), 1) in {tuple(r) for r in sessions().collect()}


def test_expired_state_is_gone(spark, events):
    source, path, stream = events
    allowed = lambda: {r.event_id: r.allowed for r in run(spark, jobs.limited(stream(), most=2, seconds=86_400, idle=8), path, "l").collect()}
    write(spark, source, 1, [(1, 0, 1, "view", 0.0), (2, 1, 1, "view", 0.0), (3, 2, 1, "view", 0.0)])
    assert allowed() == {1: True, 2: True, 3: False}
    time.sleep(9)
    write(spark, source, 2, [(4, 3, 1, "view", 0.0)])
    assert allowed()[4]  # by the times alone it would be one too many; the idle user's state was dropped


def test_state_is_kept_between_batches(spark, events):
    source, path, stream = events
    allowed = lambda: {r.event_id: r.allowed for r in run(spark, jobs.limited(stream(), most=2, seconds=86_400), path, "k").collect()}
    write(spark, source, 1, [(2, 1, 1, "view", 0.0), (1, 0, 1, "view", 0.0)])
    allowed()
    write(spark, source, 2, [(3, 2, 1, "view", 0.0), (4, 2000, 1, "view", 0.0)])
    assert allowed() == {1: True, 2: True, 3: False, 4: True}


def test_responses_without_scores_come_when_both_watermarks_have_passed(spark, events):
    source, path, stream = events

    def joined():
        responses = stream().where("event_type = 'answer'").selectExpr("user_id", "event_id AS response_id", "ts")
        scores = stream().where("event_type = 'judge'").selectExpr("user_id", "event_id AS score_id", "ts", "value AS score")
        return {(r.response_id, r.score_id) for r in run(spark, jobs.evaluated(responses, scores, within="60 minutes", late="10 minutes"), path, "j").collect()}

    write(spark, source, 1, [(1, 0, 1, "answer", 0.0), (2, 30, 1, "judge", 0.5), (3, 0, 2, "answer", 0.0), (4, 61, 2, "judge", 0.1), (5, 60, 3, "answer", 0.0)])
    assert joined() == {(1, 2)}  # 3's score came too late, but it may still get another
    write(spark, source, 2, [(6, 120, 3, "judge", 0.9), (7, 200, 9, "answer", 0.0), (8, 200, 9, "judge", 0.2)])
    assert joined() == {(1, 2), (5, 6), (7, 8), (3, None)}
    # a score behind the watermark is dropped, and its response has been given without
    write(spark, source, 3, [(9, 40, 2, "judge", 0.3), (10, 900, 9, "answer", 0.0), (11, 900, 9, "judge", 0.2)])
    assert joined() == {(1, 2), (5, 6), (7, 8), (3, None), (10, 11)}


def test_rows_are_ordered_over_batches():
    frames = [pd.DataFrame({"ts": [at(5), at(1)], "event_id": [1, 2], "event_type": ["a", "b"]}), pd.DataFrame({"ts": [at(3), at(1)], "event_id": [3, 0], "event_type": ["c", "d"]})]
    assert [(i, k) for _, i, k in jobs.in_order(iter(frames), "event_type")] == [(0, "d"), (2, "b"), (3, "c"), (1, "a")]


def test_requests_are_counted_over_stretches(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from quarry.operators import windows as W

    monkeypatch.setattr(W, "SPANS", 2)
    rng = np.random.default_rng(1)
    seconds = sorted(rng.integers(0, 600, 400).tolist()) + [0, 30, 60, 60, 120]
    rows = [(i, s % 2, START + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: (r.in_window, r.allowed) for r in W.requests_in_window(df, "user_id", 30, 9).collect()}
    want = {i: sum(v == u and t - dt.timedelta(seconds=30) <= s <= t for _, v, s in rows) for i, u, t in rows}
    assert got == {i: (n, n <= 9) for i, n in want.items()}
