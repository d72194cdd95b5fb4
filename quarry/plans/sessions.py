"""Budgets, sessions, memories, caches and costs over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T
from ..operators import measure as M
from ..operators import tables as B
from ..operators import windows as W
from .base import query, read

N_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


def talks(spark, sf_dir):
    return read(spark, sf_dir, "conversations")


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH r AS (SELECT doc_id, source, round(sum(round({N_WORDS} * 1.3::DOUBLE, 6)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING), 4) AS used FROM documents)
    SELECT * FROM r WHERE used <= 3000""")
def budget_fit(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return W.fit_budget(rows, "source", "n_chars", "doc_id").select("doc_id", "source", "used")


@query(f"""WITH r AS (SELECT conv_id, turn, CAST(floor({N_WORDS} * 1.3::DOUBLE) AS BIGINT) AS token_estimate FROM conversations),
    w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, CAST(sum(token_estimate) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM r)
    SELECT conv_id, turn, token_estimate, back FROM w WHERE back = 1 OR back <= 20 AND running <= 4000""")
def session_prune(spark, sf_dir):
    return W.prune_sessions(talks(spark, sf_dir)).select("conv_id", "turn", "token_estimate", "back")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, string_agg(role || ': ' || left(text, 200), chr(10) ORDER BY turn) AS summary, count(*) AS n_messages FROM r WHERE back <= 6 GROUP BY conv_id""")
def session_summary(spark, sf_dir):
    return W.summaries(talks(spark, sf_dir))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM s GROUP BY user_id, session""")
def session_ttl(spark, sf_dir):
    return W.sessions(events(spark, sf_dir)).withColumns({"started": F.unix_micros("started"), "ended": F.unix_micros("ended")})


@query("""WITH w AS (SELECT event_id, event_type, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS v FROM events)
    SELECT event_id, event_type, v[CAST(least(floor(len(v) * 95 / 100.0), len(v) - 1) AS BIGINT) + 1] AS p95 FROM w""")
def latency_window_pct(spark, sf_dir):
    return W.sliding_percentile(events(spark, sf_dir), "event_type")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, count(*) AS n_values, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, max(CASE WHEN rn = least(floor(n * 0.99), n - 1) THEN value END) AS p99 FROM r GROUP BY event_type""")
def metrics_histogram(spark, sf_dir):
    return W.histogram(events(spark, sf_dir), "event_type")


@query("""SELECT event_id, user_id, count(*) OVER w AS in_window, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""")
def rate_limit_window(spark, sf_dir):
    return W.requests_in_window(events(spark, sf_dir), "user_id", 3600, 3).select("event_id", "user_id", "in_window", "allowed")


TIERS = "CASE user_id % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'standard' WHEN 2 THEN 'pro' WHEN 3 THEN 'premium' WHEN 4 THEN 'enterprise' ELSE 'other' END"
LIMITS = "CASE tier " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in lists.DAILY_TOKENS.items()) + f" ELSE {lists.DAILY_TOKENS['pro']} END"


@query(f"""WITH c AS (SELECT user_id AS team_id, {TIERS} AS tier, CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day, CAST(floor(value * 1000) AS BIGINT) AS tokens FROM events),
    u AS (SELECT team_id, tier, day, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY ALL)
    SELECT *, {LIMITS} AS token_limit, tokens < {LIMITS} AS within FROM u""")
def usage_daily_budget(spark, sf_dir):
    calls = events(spark, sf_dir).select(F.col("user_id").alias("team_id"), F.expr(TIERS).alias("tier"), "ts", F.floor(F.col("value") * 1000).alias("tokens"))
    return M.daily_usage(calls).withColumn("day", F.col("day").cast("string"))


MODELS = "CASE event_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3-haiku' WHEN 2 THEN 'claude-3-5-sonnet' ELSE 'unknown' END"
PRICE = ["CASE model " + " ".join(f"WHEN '{m}' THEN {p[i]}" for m, p in lists.PRICES.items()) + f" ELSE {lists.OTHER_PRICE[i]} END" for i in (0, 1)]


@query(f"""WITH c AS (SELECT user_id AS team_id, {MODELS} AS model, CAST(floor(value * 100) AS BIGINT) AS i, CAST(floor(value * 30) AS BIGINT) AS o FROM events),
    s AS (SELECT team_id, count(*) AS n_calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(sum((i * ({PRICE[0]})::DOUBLE + o * ({PRICE[1]})::DOUBLE) / 1000000), 6) AS spent FROM c GROUP BY team_id)
    SELECT *, round(greatest(0.0, 10.0 - spent), 6) AS remaining FROM s""")
def llm_cost(spark, sf_dir):
    calls = events(spark, sf_dir).select(F.col("user_id").alias("team_id"), F.expr(MODELS).alias("model"), F.floor(F.col("value") * 100).alias("tokens_in"), F.floor(F.col("value") * 30).alias("tokens_out"))
    return M.costs(calls)


NOW = "TIMESTAMP '2024-02-01 00:00:00'"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH q AS (SELECT list_distinct(list(w)) AS qw FROM (SELECT unnest({WORDS.format('r_name')}) AS w FROM region UNION ALL SELECT 'the' UNION ALL SELECT 'of' UNION ALL SELECT 'la')),
    m AS (SELECT e.event_id AS memory_id, e.user_id, e.ts, e.value / 100 AS relevance_score, c.text FROM events e JOIN conversations c ON c.conv_id = e.event_id AND c.turn = 0),
    s AS (SELECT memory_id, user_id, round(len(list_intersect({WORDS.format('text')}, qw))::DOUBLE / greatest(len(qw), 1) * pow(0.5::DOUBLE, (epoch_us({NOW}) - epoch_us(ts)) / 3.6e9::DOUBLE / 72.0::DOUBLE) * relevance_score, 6) AS score FROM m, q)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, memory_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def memory_recall(spark, sf_dir):
    first = talks(spark, sf_dir).where("turn = 0").select(F.col("conv_id").alias("memory_id"), F.col("text").alias("content"))
    memories = events(spark, sf_dir).select(F.col("event_id").alias("memory_id"), "user_id", F.col("ts").cast("timestamp").alias("valid_from"), (F.col("value") / 100).alias("relevance_score"), F.lit(None).cast("timestamp").alias("valid_to"))
    names = read(spark, sf_dir, "region").select(F.explode(T.split_words(F.lower("r_name"))).alias("w"))
    asked = names.agg(F.array_distinct(F.concat(F.collect_set("w"), T.strings(["the", "of", "la"]))).alias("asked"))  # one row
    rows = memories.join(first, "memory_id").crossJoin(F.broadcast(asked))
    return M.recalled(rows, F.expr(NOW), F.col("asked")).select("memory_id", "user_id", "score", "rank")


@query("""WITH f AS (SELECT user_id, event_id, ts AS a, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events WHERE event_type IN ('view', 'signup')),
    m AS (SELECT user_id, event_id AS moment_id, ts AS moment FROM events WHERE event_type = 'purchase')
    SELECT m.user_id, moment_id, f.event_id AS fact_id FROM m JOIN f ON f.user_id = m.user_id AND a <= moment AND moment < coalesce(b, TIMESTAMP '9999-01-01')""")
def memory_as_of(spark, sf_dir):
    """A new fact of a kind ends the one before: what was known of a user at each purchase."""
    from pyspark.sql import Window

    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    end = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    facts = rows.where("event_type IN ('view', 'signup')").select("user_id", F.col("event_id").alias("fact_id"), F.col("ts").alias("valid_from"), end.alias("valid_to"))
    moments = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("moment_id"), F.col("ts").alias("moment"))
    return W.as_of(facts, moments, "user_id").select("user_id", "moment_id", "fact_id")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, t AS filled, false AS hit FROM o WHERE n = 1
          UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.t - r.filled <= 7200000000 THEN r.filled ELSE o.t END, o.t - r.filled <= 7200000000 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, event_id, hit FROM r""")
def cache_ttl_replay(spark, sf_dir):
    return B.ttl_replay(events(spark, sf_dir), "user_id", 7200)


@query("""WITH r AS (SELECT conv_id, turn, md5(text) AS k FROM conversations), l1 AS (SELECT md5(text) AS k, max('a' || doc_id) AS v FROM documents WHERE lang = 'en' GROUP BY 1), l2 AS (SELECT md5(text) AS k, max('b' || conv_id) AS v FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT conv_id, turn, CASE WHEN l1.v IS NOT NULL THEN 'L1' WHEN l2.v IS NOT NULL THEN 'L2' ELSE 'MISS' END AS cache_tier, coalesce(l1.v, l2.v) AS value FROM r LEFT JOIN l1 USING (k) LEFT JOIN l2 USING (k)""")
def cache_cascade(spark, sf_dir):
    key = F.md5("text").alias("k")
    l1 = read(spark, sf_dir, "documents").where("lang = 'en'").groupBy(key).agg(F.max(F.concat(F.lit("a"), F.col("doc_id"))).alias("value"))
    l2 = talks(spark, sf_dir).where("role = 'assistant'").groupBy(key).agg(F.max(F.concat(F.lit("b"), F.col("conv_id"))).alias("value"))
    return B.cascade(talks(spark, sf_dir).select("conv_id", "turn", key), {"L1": l1, "L2": l2}, "k").select("conv_id", "turn", "cache_tier", "value")
