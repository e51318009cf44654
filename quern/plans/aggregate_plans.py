"""Log statistics on ``events`` (user_id: collection, event_type: tool or query type, value: latency), budgets and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import aggregates as A
from quern.plans.registry import query

LAST = "ts >= TIMESTAMP '2024-01-21 00:00:00'"


@query("a1_usage", f"SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value))::BIGINT AS mean FROM events WHERE {LAST} GROUP BY event_type")
def a1(t):
    return A.usage(t.events.where(LAST), "event_type", "value")


@query("a2_retrieval_stats", "SELECT user_id, event_type, count(*) AS calls, count(*) FILTER (value > 50) AS slow, round(avg(value) + 1e-7::DOUBLE, 4) AS mean FROM events GROUP BY ALL")
def a2(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.count_if(F.expr("value > 50")).alias("slow"), F.round(F.avg("value") + 1e-7, 4).alias("mean"))


@query("a3_audit", "SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY event_type")
def a3(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("a3_latest", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def a3_latest(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "event_type")


@query("a4_percent", "SELECT user_id, floor(count(*) FILTER (event_type = 'view') * 100 / greatest(count(*), 1))::BIGINT AS cache_percent, floor(count(*) FILTER (event_type = 'error') * 100 / greatest(count(*), 1))::BIGINT AS failure_percent FROM events GROUP BY user_id")
def a4(t):
    n = F.count("*")
    return t.events.groupBy("user_id").agg(A.percent(F.count_if(F.expr("event_type = 'view'")), n).alias("cache_percent"), A.percent(F.count_if(F.expr("event_type = 'error'")), n).alias("failure_percent"))


@query("a5_running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-7::DOUBLE, 4) AS mean FROM events")
def a5(t):
    m = A.running_mean(t.events, "event_type", ["ts", "event_id"], "value", F.to_date("ts"))
    return m.select("event_id", F.round(F.col("mean") + 1e-7, 4).alias("mean"))


@query("a6_tools", "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value < 90) AS ok, count(*) FILTER (NOT value < 90) AS failed, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def a6(t):
    return t.events.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_if(F.expr("value < 90")).alias("ok"), F.count_if(F.expr("not value < 90")).alias("failed"), F.round(F.sum("value"), 4).alias("total"))


@query("a7_p50", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS p50, count(*) AS n FROM events GROUP BY event_type")
def a7(t):
    return A.upper_median(t.events, ["event_type"], "value")


@query("a8_steps", "SELECT event_type, count(*) AS n, round(avg(value))::BIGINT AS mean, min(value) AS low, max(value) AS high, list_sort(list(value))[greatest(floor(count(*) * 0.95)::BIGINT - 1, 0) + 1] AS p95 FROM events GROUP BY event_type")
def a8(t):
    base = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value")).cast("long").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return base.join(A.p95(t.events, ["event_type"], "value").drop("n"), "event_type")


@query("a9_dashboard", "WITH l AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type, round(avg(value), 4) AS recent_mean, count(*) AS n FROM l WHERE rn <= 60 GROUP BY event_type")
def a9(t):
    last = A.last_n(t.events, "event_type", [F.desc("ts"), F.desc("event_id")], 60)
    return last.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("recent_mean"), F.count("*").alias("n"))


@query("a10_modules", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, lang, source LIMIT 12")
def a10(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "lang", "source").limit(12)


@query("a12_tasks", "SELECT c_nationkey AS collection, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS planned FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def a12(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("collection")).agg(F.count_if(F.expr("o_orderstatus = 'F'")).alias("done"), F.count_if(F.expr("o_orderstatus = 'O'")).alias("active"), F.count_if(F.expr("o_orderstatus not in ('F', 'O')")).alias("planned"))


@query("a14_distinct", "SELECT lang, count(DISTINCT source) AS sources, string_agg(DISTINCT source, '|' ORDER BY source) AS names FROM documents GROUP BY lang")
def a14(t):
    return t.documents.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("names"))


@query("a15_budget", "SELECT event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 4) AS tokens, round(sum(value) OVER w, 4) > 2000 AS exceeded FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def a15(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.round(F.sum("value").over(w), 4)
    return t.events.select("event_id", F.count("*").over(w).alias("calls"), total.alias("tokens"), (total > 2000).alias("exceeded"))


@query("a16_guard", "SELECT event_id, CASE WHEN value * 100 > 5000 THEN 'too_long' WHEN event_type = 'click' AND count(*) FILTER (event_type = 'click') OVER w > 1 THEN 'aux_spent' WHEN count(*) OVER w > 2 THEN 'calls_spent' ELSE 'ok' END AS verdict FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def a16(t):
    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    aux = F.sum((F.col("event_type") == "click").cast("int")).over(w)
    return t.events.select("event_id", F.when(F.col("value") * 100 > 5000, "too_long").when((F.col("event_type") == "click") & (aux > 1), "aux_spent").when(F.count("*").over(w) > 2, "calls_spent").otherwise("ok").alias("verdict"))


_BOUNDS = [10.0, 25.0, 50.0, 75.0, 90.0]


@query("a17_histogram", " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS count FROM events GROUP BY event_type" for b in _BOUNDS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type")
def a17(t):
    return A.histogram(t.events, "value", _BOUNDS, ["event_type"])


@query("w2_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def w2(t):
    return t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


@query("w7_rolling", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 59 PRECEDING) + 1e-7::DOUBLE, 4) AS mean60 FROM events")
def w7(t):
    m = A.rolling_mean(t.events, "event_type", ["ts", "event_id"], "value", 60, F.to_date("ts"))
    return m.select("event_id", F.round(F.col("mean") + 1e-7, 4).alias("mean60"))


_STREAK = "WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), s AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM r)"


@query("w8_consecutive", _STREAK + " SELECT event_id, streak, streak >= 2 AS stop FROM s")
def w8(t):
    return A.consecutive(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak", (F.col("streak") >= 2).alias("stop"))


@query("w9_escalation", "WITH c AS (SELECT event_id, ['local', 'cheap', 'reason'][user_id % 3 + 1] AS tier, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) SELECT event_id, r AS reflections, CASE WHEN r < 2 THEN 'retry_same' WHEN r < 4 THEN 'escalate' WHEN r < 6 THEN 'force_reason' ELSE 'human_review' END AS action, CASE WHEN r < 2 THEN tier WHEN r < 4 THEN CASE tier WHEN 'local' THEN 'cheap' ELSE 'reason' END WHEN r < 6 THEN 'reason' ELSE tier END AS next_tier FROM c")
def w9(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    tiers = F.array(F.lit("local"), F.lit("cheap"), F.lit("reason"))
    c = t.events.select("event_id", F.get(tiers, (F.col("user_id") % 3).cast("int")).alias("tier"), F.sum((F.col("event_type") == "error").cast("int")).over(w).alias("reflections"))
    action, tier = A.escalation(F.col("reflections"), F.col("tier"))
    return c.select("event_id", "reflections", action.alias("action"), tier.alias("next_tier"))


@query("w10_keep_newest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 20")
def w10(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("rn", F.row_number().over(w)).where("rn > 20").select("user_id", "event_id")


@query("w11_active_phase", "SELECT collection, o_orderkey FROM (SELECT c_nationkey AS collection, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rn = 1")
def w11(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), F.desc("o_orderdate"), "o_orderkey")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("c_nationkey").alias("collection"), "o_orderkey")


@query("o5_paging", "SELECT event_id, rn, (SELECT count(*) FROM events) AS total, ceil((SELECT count(*) FROM events) / 50)::BIGINT AS pages FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn BETWEEN 51 AND 100")
def o5(t):
    # a page near the top needs the sorted top only, not a global rank of all rows
    top = t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")).where("rn > 50")
    total = t.events.agg(F.count("*").alias("total"))
    return ranked.crossJoin(total).select("event_id", "rn", "total", F.ceil(F.col("total") / 50).alias("pages"))


@query("h27_first_failure", "SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS first_failed FROM lineitem GROUP BY l_orderkey")
def h27(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("first_failed"))


@query("z_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def z_q1(t):
    return t.lineitem.where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("z_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
def z_q5(t):
    j = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("z_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def z_rollup(t):
    return t.documents.rollup("lang", "source").agg(F.count("*").alias("n"))
