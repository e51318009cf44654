"""Streaming queries: each runs what is there to its end and returns the table it has written."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.plans.lifecycle_plans import BREAKER_SQL
from quern.plans.memory_plans import TASKS_SQL, order_steps
from quern.plans.registry import query
from quern.session import shared_dir
from quern.sources import logs
from quern.sources.tables import LOG
from quern.streaming import events as S
from quern.streaming import keyed as K


def _base(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _finished(t, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over the events table and read back its last state (complete) or all its rows (append)."""
    base = _base(t, "stream")
    write = S.appended(f"{base}/out") if mode == "append" else lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out")
    S.run_to_table(stream, f"{base}/checkpoint", mode, write)
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def _events(t) -> DataFrame:
    return S.event_stream(t.spark, t.folder)


#: Parts that rows arrive in; after each the query is stopped.
FILES = 4


def _restarted(t, rows: DataFrame, part: F.Column, make) -> DataFrame:
    """What ``make(stream)`` has given for all rows, which arrive by ``part``, one batch a part; the query is stopped after each and goes on
    from its checkpoint with the next. Each batch's rows are written below its number."""
    base = _base(t, "keyed")
    rows = rows.withColumn("_part", part.cast("int"))
    schema = rows.drop("_part").schema
    for k in range(FILES):
        # as many files as the rows have tasks: all that are there are one batch
        rows.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{base}/in")
        stream = make(t.spark.readStream.schema(schema).parquet(f"{base}/in"))
        S.run_to_table(stream, f"{base}/checkpoint", "update", S.appended(f"{base}/out"))
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out").drop("batch")


def _timed(t) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _quarter(rows: DataFrame) -> F.Column:
    """Which of the FILES equal parts of the events a time falls into."""
    bounds = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / FILES for k in range(1, FILES)], 1000)).first()[0] or []
    return sum((F.when(F.unix_micros("ts") > b, 1).otherwise(0) for b in bounds), F.lit(0))


@query("y1_stream_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def y1(t):
    return _finished(t, S.counts(_events(t)), "complete").select("event_type", "n", F.round("total", 4).alias("total"))


@query("y2_stream_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def y2(t):
    return _finished(t, S.windowed(_events(t), "1 day"), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("y1_tail", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def y1_tail(t):
    return _finished(t, S.tail(_events(t), ["error", "purchase"]), "append").select("event_id", "event_type")


@query("y1_log_tail", "SELECT event_id, level FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level FROM events ORDER BY event_id DESC LIMIT 200) WHERE level <> 'INFO'")
def y1_log(t):
    """The events as a log of JSON lines: its last 200 lines are replayed, and warnings and errors among them kept."""
    base = _base(t, "log")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    lines = t.events.select("event_id", F.to_json(F.struct(level.alias("level"), F.col("event_id").cast("string").alias("msg"))).alias("value"))
    # one log is one file
    lines.repartitionByRange(1, "event_id").sortWithinPartitions("event_id").select("value").write.text(f"{base}/log")
    (file,) = [f for f in t.spark.read.text(f"{base}/log").inputFiles()]
    S.run_to_table(logs.tail(t.spark, unquote(file.removeprefix("file://")), "WARNING"), f"{base}/checkpoint", "append", S.appended(f"{base}/out"))
    return t.spark.read.schema(LOG).parquet(f"{base}/out").select(F.col("msg").cast("long").alias("event_id"), "level")


@query("y7_stream_sync", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def y7(t):
    """Batches hold new and changed keys and old versions; only what changed is written."""
    got = _restarted(t, t.events.select("user_id", "event_id"), F.col("event_id") % FILES, lambda s: K.changed(s, "user_id", "event_id"))
    return K.current(got, ["user_id"])


@query("y3_stream_last_n", "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 10")
def y3_stream(t):
    got = _restarted(t, t.events.select("user_id", "event_id"), F.col("event_id") % FILES, lambda s: K.last_n(s, "user_id", "event_id", "event_id", 10))
    return K.current(got, ["user_id"])


@query("y4_stream_ttl", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def y4_stream(t):
    rows = _timed(t).select("event_id", "ts")
    return K.still_live(_restarted(t, rows, _quarter(rows), lambda s: K.expiring(s, "event_id", 6 * 3600))).withColumnRenamed("id", "event_id")


@query("x16_stream_breaker", BREAKER_SQL)
def x16_stream(t):
    """A breaker for each user; events arrive in the order of time."""
    rows = _timed(t).select("event_id", "ts", "user_id", "event_type")
    got = _restarted(t, rows, _quarter(rows), lambda s: K.breaker(s, "user_id", "event_id", F.col("event_type") != "error", failures=2, recovery=86_400.0))
    return got.where("id is not null").select(F.col("id").alias("event_id"), "accepted", "state")


@query("x13_stream_tasks", TASKS_SQL)
def x13_stream(t):
    """Every order is a task, its lines the results of steps, two steps a file."""
    return K.current(_restarted(t, order_steps(t), F.least(F.floor((F.col("step") / 10**12 - 1) / 2), F.lit(FILES - 1)), K.tasks), ["task_id"])


@query("y9_stream_sliding", "WITH s AS (SELECT unnest(range(0, 2)) AS k), e AS (SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 12 HOURS AS start, event_type FROM events, s) SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM e GROUP BY ALL")
def y9_sliding(t):
    return _finished(t, S.windowed(_events(t), "24 hours", "12 hours", late="60 days"), "complete").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("y9_stream_sessions", "WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOURS)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, no")
def y9_sessions(t):
    return _finished(t, S.sessions(_events(t), "6 hours", late="60 days"), "complete").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("y9_stream_unique", "SELECT event_id FROM events")
def y9_unique(t):
    """Every event arrives twice; each passes once."""
    base = _base(t, "twice")
    for _ in range(2):
        t.events.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = S.unique(S.event_stream(t.spark, f"{base}/in", "*.parquet").select("event_id", "ts"), ["event_id"], late="60 days")
    return _finished(t, stream, "append").select("event_id")


@query("y4_ttl", "SELECT event_id, ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' AS live FROM events")
def y4(t):
    now = F.expr("timestamp_ntz '2024-01-15 12:00:00'")
    return t.events.select("event_id", ((F.col("ts") + F.expr("interval 1 hour") > now) & (F.col("ts") <= now)).alias("live"))


@query("z_sliding", "WITH s AS (SELECT unnest(range(0, 2)) AS k), e AS (SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 12 HOURS AS start, event_type FROM events, s) SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM e GROUP BY ALL")
def z_sliding(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "24 hours", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("z_sessions", "WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOURS)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, no")
def z_sessions(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("z_asof", "SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error' GROUP BY e.event_id")
def z_asof(t):
    """Last purchase of the user at each error: one sort by user and time instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = t.events.withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("event_type = 'error'").select("event_id", "last_purchase")
