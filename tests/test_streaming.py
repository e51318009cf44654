"""State by key over several batches, a restart between them, and timers that fire without events of their own key."""

import datetime
import random

from pyspark.sql import functions as F

from quern.operators import lifecycle
from quern.streaming import events as S
from quern.streaming import keyed as K

START = datetime.datetime(2024, 5, 1)


class Feed:
    """Files that arrive one after another; every ``go`` starts the query anew from its checkpoint."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.base, self.schema, self.make = spark, f"file://{folder}", schema, make

    def go(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.base}/in")
        stream = self.make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in"))
        S.run_to_table(stream, f"{self.base}/checkpoint", "update", S.appended(f"{self.base}/out"))
        return self.spark.read.schema(stream.schema).parquet(f"{self.base}/out")


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_last_n_goes_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user string, pos long, id long", lambda s: K.last_n(s, "user", "pos", "id", 2))
    feed.go([("a", 1, 10), ("a", 3, 30), ("b", 1, 11), (None, 1, 12)], [("a", 2, 20)])
    got = feed.go([("a", 9, 90), ("b", 0, 5)])
    now = sorted((str(r.user), r.rn, r.id) for r in K.current(got, ["user"]).collect())
    assert now == [("None", 1, 12), ("a", 1, 90), ("a", 2, 30), ("b", 1, 11), ("b", 2, 5)]
    got = feed.go([("a", 0, 1), ("b", 2, 22)])
    assert {u: v for u, v in got.groupBy("user").agg(F.max("version")).collect()} == {None: 0, "a": 2, "b": 2}, "a row that changes nothing gives nothing"


def test_entries_expire_by_timer(spark, tmp_path):
    """Entry 1 expires exactly at its time though only other entries come; state survives restarts; expired entries stay away."""
    feed = Feed(spark, tmp_path, "id long, ts timestamp", lambda s: K.expiring(s, "id", 60, shards=2))
    live = lambda df: {r.id for r in K.still_live(df).collect()}
    assert live(feed.go([(1, at(0)), (2, at(30)), (9, None)])) == {1, 2, 9}
    assert live(feed.go([(3, at(59.999))])) == {1, 2, 3, 9}
    assert live(feed.go([(4, at(60))])) == {2, 3, 4, 9}
    got = feed.go([(5, at(100)), (6, at(101))], [(7, at(125))])
    assert live(got) == {5, 6, 7, 9}
    assert {r.id for r in got.where("not live").collect()} == {1, 2, 3, 4}


def test_an_open_breaker_is_half_open_by_timer(spark, tmp_path):
    make = lambda s: K.breaker(s, "user", "id", F.col("ok"), failures=2, recovery=60.0, successes=1)
    feed = Feed(spark, tmp_path, "user string, id long, ts timestamp, ok boolean", make)
    states = lambda df: [(r.user, r.id, r.accepted, r.state) for r in df.collect() if r.user == "a"]
    got = states(feed.go([("a", 1, at(0), False), ("a", 2, at(1), False), ("b", 3, at(2), True)], [("a", 4, at(30), True)]))
    assert sorted(got) == [("a", 1, True, "closed"), ("a", 2, True, "open"), ("a", 4, False, "open")]
    got = states(feed.go([("b", 5, at(60.5), True)]))
    assert len(got) == 3, "not yet"
    got = states(feed.go([("b", 6, at(61), True)]))
    assert [g for g in got if g[1] is None] == [("a", None, None, "half_open")]
    got = states(feed.go([("a", 7, at(70), True)]))
    assert ("a", 7, True, "closed") in got


def test_streamed_breaker_equals_the_fold(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, at(i * rng.choice([3, 4])), rng.random() < 0.5) for i in range(200)]
    rows.sort(key=lambda r: (r[2], r[1]))
    schema = "user string, id long, ts timestamp, ok boolean"
    feed = Feed(spark, tmp_path, schema, lambda s: K.breaker(s, "user", "id", F.col("ok"), failures=2, recovery=20.0))
    feed.go(rows[:40], rows[40:100])
    got = feed.go(rows[100:130], rows[130:])
    whole = spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("ts")).withColumn("s", F.col("us") / 1e6)
    want = lifecycle.breaker(whole, "user", ["us", "id"], ["id"], "s", "ok", failures=2, recovery=20.0)
    assert sorted((r.id, r.accepted, r.state) for r in got.where("id is not null").collect()) == sorted((r.id, r.accepted, r.state) for r in want.collect())


def test_changed_keys_only(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, v long", lambda s: K.changed(s, "k", "v"))
    feed.go([("a", 1), ("b", 1)], [("a", 2), ("b", 1)])
    got = feed.go([("c", 5), ("a", 1)])
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 5)]
    assert sorted((r.k, r.v) for r in K.current(got, ["k"]).collect()) == [("a", 2), ("b", 1), ("c", 5)]


def test_tasks_share_entries_of_the_state_store(spark, tmp_path):
    """600 tasks are 4 entries (null ids, below 0, up to 255, up to 511), not 600; each task goes on from its own state."""
    import itertools

    from quern.operators.memory import task_states

    ids = [None, *range(-100, 499)]
    steps = [(i, n, (n + (i or 0)) % 5 != 0) for i, n in itertools.product(ids, range(9))]
    schema = "task_id long, step long, ok boolean"
    for part in ([s for s in steps if s[1] < 4], [s for s in steps if s[1] >= 4]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = K.tasks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        S.run_to_table(stream, f"file://{tmp_path}/checkpoint", "update", S.appended(f"{tmp_path}/out"))
    got = K.current(spark.read.parquet(f"{tmp_path}/out").drop("batch"), ["task_id"])
    want = task_states(spark.createDataFrame(steps, schema))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    keys = spark.read.format("statestore").option("stateVarName", "states").load(f"file://{tmp_path}/checkpoint").select("key").distinct().count()
    assert keys == 4
