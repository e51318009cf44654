"""Tasks, sessions, contexts, logs and schemas: orders are tasks, their lines steps, events log rows, documents chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import context as X
from quern.operators import dml as D
from quern.operators import lifecycle as L
from quern.operators import retrieval as R
from quern.plans.registry import query
from quern.plans.retrieval_plans import TOK, docs, item_queries, sparse_sql

# --- tasks

_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'waiting_approval' WHEN 'O' THEN 'executing' ELSE 'done' END"
_STEP = "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'done' ELSE 'planned' END"


def tasks(t):
    return t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("collection"), F.expr(_STATUS).alias("status"), F.col("o_orderdate").alias("at"))


def steps(t):
    return t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("step"), F.expr(_STEP).alias("status"))


@query("h12_approve", f"SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'executing' ELSE {_STATUS} END AS status, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS approved, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'fine' END AS feedback FROM orders")
def h12_approve(t):
    """Approvals come for every second task, whatever its state."""
    return L.approve(tasks(t), tasks(t).where("task_id % 2 = 0").select("task_id", F.lit("fine").alias("feedback"))).select("task_id", "status", "approved", "feedback")


@query("h12_complete_tasks", f"SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE {_STATUS} END AS status FROM orders")
def h12_tasks(t):
    return L.complete(tasks(t), steps(t), tasks(t).where("task_id % 3 = 0"))[0].select("task_id", "status")


@query("h12_complete_steps", f"SELECT l_orderkey AS task_id, l_linenumber AS step, CASE WHEN l_orderkey % 3 = 0 AND o_orderstatus <> 'F' AND l_returnflag NOT IN ('R', 'A') THEN 'done' ELSE {_STEP} END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def h12_steps(t):
    """A task that is done already keeps its steps as they are."""
    return L.complete(tasks(t), steps(t), tasks(t).where("task_id % 3 = 0"))[1].select("task_id", "step", "status")


#: A number for each line of an order; line numbers alone repeat.
_NO = "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey"


def checkpoints(t):
    return t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.expr(_NO).alias("at"), F.concat(F.lit("node"), F.col("l_suppkey").cast("string")).alias("node"), F.col("l_partkey").alias("step"))


@query("h12_resume", "SELECT l_orderkey AS task_id, 'node' || max_by(l_suppkey, " + _NO + ") AS current_node, max_by(l_partkey, " + _NO + ") AS resume_from_step FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def h12_resume(t):
    return L.resume(tasks(t), checkpoints(t))


@query("k10_checkpoints", "WITH n AS (SELECT l_orderkey AS task_id, max(" + _NO + ") AS at_, 'node' || max_by(l_suppkey, " + _NO + ") AS node FROM lineitem GROUP BY 1) SELECT coalesce(n.task_id, o_orderkey) AS task_id, coalesce(at_, 0)::BIGINT AS version, coalesce(node, 'start') AS node FROM orders FULL JOIN n ON n.task_id = o_orderkey")
def k10(t):
    """Every order has a first checkpoint; the newest of its lines' takes its place."""
    store = t.orders.select(F.col("o_orderkey").alias("task_id"), F.lit(0).cast("long").alias("at"), F.lit("start").alias("node"), F.lit(0).cast("long").alias("step"))
    return L.save_checkpoints(store, checkpoints(t).withColumn("at", F.col("at").cast("long"))).select("task_id", F.col("at").alias("version"), "node")


@query("h18_load", """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'cache' ELSE 'table' END AS origin, 1 AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'EDIT' ELSE o_orderstatus END AS step, CASE WHEN o_orderkey % 3 = 0 THEN 'g"' || o_orderkey ELSE '' END AS goal, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5)::INT ELSE 0 END AS reflection_count, 0 AS n_files FROM orders""")
def h18(t):
    """A third of the tasks is cached in today's form; the table holds rows of version 0 that lack most fields."""
    cached = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("task_id"), F.lit("EDIT").alias("step"), F.concat(F.lit('g"'), F.col("o_orderkey").cast("string")).alias("goal"), (F.col("o_orderkey") % 5).cast("int").alias("reflection_count"))
    table = t.orders.select(F.col("o_orderkey").cast("string").alias("task_id"), F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderstatus").alias("step"))).alias("json"))
    got = L.load_checkpoints(L.checkpoint_json(cached), table)
    return got.select(F.col("task_id").cast("long").alias("task_id"), "origin", "version", "step", "goal", "reflection_count", F.size("opened_files").alias("n_files"))


@query("h18_status", "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 4 = 0 THEN 'SUSPENDED' ELSE 'RUNNING' END AS status FROM orders WHERE o_orderkey % 4 <> 2")
def h18_status(t):
    """Every fourth task is suspended, another completed, unknown states change nothing; then the active ones."""
    base = t.orders.select(F.col("o_orderkey").alias("task_id"), F.lit("RUNNING").alias("status"))
    kind = F.when(F.col("o_orderkey") % 4 == 0, "SUSPENDED").when(F.col("o_orderkey") % 4 == 2, "COMPLETED").otherwise("ASLEEP")
    now = L.set_status(base, t.orders.select(F.col("o_orderkey").alias("task_id"), kind.alias("status")))
    return now.join(L.active(now), "task_id").select("task_id", "status")


@query("s10_task_history", "SELECT o_custkey AS collection, o_orderkey AS task_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 20")
def s10(t):
    return L.history(tasks(t), "collection", "at").select("collection", "task_id", "rn")


@query("h15_plan_lines", r"""WITH a AS (SELECT item_id, item_id % 4 AS k, CASE item_id % 4 WHEN 0 THEN [trim(text), 'check'] WHEN 3 THEN ['Title'] END AS fixed_steps, list_filter(string_split('- ' || replace(text, '.', chr(10) || '- '), chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM benchmark),
b AS (SELECT item_id, CASE WHEN fixed_steps IS NOT NULL THEN fixed_steps ELSE list_transform(ls, lambda x: trim(x, '- ')) END AS s FROM a)
SELECT item_id AS task_id, (generate_subscripts(s, 1) - 1)::INT AS step, unnest(s) AS description FROM b""")
def h15(t):
    """An answer that is a JSON array, answers that are not, and tasks with neither answer nor description."""
    kind = F.col("item_id") % 4
    answer = F.when(kind == 0, F.to_json(F.array(F.col("text"), F.lit("  "), F.lit("check")))).when(kind == 1, F.lit("no json"))
    description = F.when(kind != 3, F.concat(F.lit("- "), F.replace("text", F.lit("."), F.lit("\n- "))))
    return L.plan_steps(t.benchmark.select(F.col("item_id").alias("task_id"), F.lit("Title").alias("title"), description.alias("description"), answer.alias("answer")))


@query("h14_loop", "WITH r AS (SELECT user_id AS task_id, event_id AS step, row_number() OVER w AS no, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), v AS (SELECT *, CASE WHEN no > 15 THEN 'step cap' WHEN spent > 400 THEN 'budget' ELSE 'run' END AS verdict FROM r), b AS (SELECT *, coalesce(max((verdict <> 'run')::INT) OVER (PARTITION BY task_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v) SELECT task_id, step, verdict FROM b WHERE b = 0")
def h14(t):
    rows = t.events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("step"), F.col("value").alias("tokens"))
    return L.bounded_loop(rows, 15, F.lit(400))


@query("h13_learning", "SELECT l_orderkey AS task_id, l_linenumber AS step, 'Başarılı Adım: ' || substr(repeat('d' || l_partkey || ' ', 20), 1, 80) AS title, sha256('Görev: t' || l_orderkey || chr(10) || chr(10) || 'Adım: ' || repeat('d' || l_partkey || ' ', 20) || chr(10) || chr(10) || 'Sonuç: ' || substr(repeat(l_linestatus, 600), 1, 500)) AS digest, 'resolved_incident' AS memory_type FROM lineitem WHERE l_returnflag = 'A'")
def h13(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("task_id"), "l_linenumber", F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("title"), F.repeat(F.concat(F.lit("d"), F.col("l_partkey").cast("string"), F.lit(" ")), F.lit(20)).alias("description"), F.repeat("l_linestatus", F.lit(600)).alias("result"), (F.col("l_returnflag") == "A").alias("ok"))
    # the step's number stands in for its id
    got = L.learning_records(s.withColumn("task_id", F.struct("task_id", "l_linenumber")))
    return got.select("task_id.task_id", F.col("task_id.l_linenumber").alias("step"), "title", F.sha2("content", 256).alias("digest"), "memory_type")


@query("h13_related", f"WITH {sparse_sql(5, 'lang IS NOT NULL')} SELECT query_id AS task_id, count(*) AS count, coalesce(string_agg(substr(d.source || '/' || id, 1, 100), '|' ORDER BY rn) FILTER (rn <= 3), '') AS suggestions FROM sparse JOIN documents d ON d.doc_id = id GROUP BY query_id")
def h13_related(t):
    mem = t.documents.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"), F.when(F.col("lang").isNotNull(), "active").otherwise("archived").alias("status"))
    return L.related(t.benchmark.select(F.col("item_id").alias("task_id"), F.lit("").alias("title"), F.col("text").alias("description")), mem)


@query("h26_outcomes", "SELECT event_id AS task_id, CASE WHEN event_type <> 'error' THEN 'Başarılı çözüm: goal ' || props ELSE 'Başarısız pattern [' || tier || ']' END AS title, CASE WHEN event_type <> 'error' THEN 'Görev ''goal ' || props || ''' başarıyla ' || tier || ' ile ' || r || ' reflection sonrası çözüldü.' ELSE 'Pattern ' || tier || '''da başarısız oldu (reflection=' || r || '): ' || substr(repeat(props, 50), 1, 200) END AS content, r > 6 AS needs_review FROM (SELECT *, event_id % 9 AS r, ['cheap', 'reason'][user_id % 2 + 1] AS tier FROM events)")
def h26(t):
    runs = t.events.select(F.col("event_id").alias("task_id"), F.concat(F.lit("goal "), "props").alias("goal"), F.when(F.col("user_id") % 2 == 0, "cheap").otherwise("reason").alias("tier"), (F.col("event_id") % 9).alias("reflections"), (F.col("event_type") != "error").alias("ok"), F.repeat("props", F.lit(50)).alias("error"))
    return L.outcome_records(runs)


# --- sessions, workspaces, locks


@query("h19_session", "SELECT conv_id || '/' || turn || '/' || role AS task_id, turn % 2 = 0 AS cached, role AS current_step, CASE WHEN turn % 2 = 0 THEN '' ELSE substr(min(text), 1, 500) END AS spec, CASE WHEN turn % 2 = 0 THEN '' ELSE substr(min(text), 1, 200) END AS test_code, turn::INT AS tokens_used FROM conversations GROUP BY conv_id, turn, role")
def h19(t):
    """Every second session is only in the table, where its texts were cut."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    s = t.conversations.groupBy(key.alias("task_id"), F.col("role").alias("current_step"), F.col("turn").cast("int").alias("tokens_used")).agg(F.min("text").alias("spec"), F.min("text").alias("test_code"), F.lit(3).alias("memory_count"))
    cache = s.where("tokens_used % 2 = 0").select("task_id", F.to_json(F.struct("current_step", "tokens_used")).alias("json"))
    return L.load_sessions(cache, L.save_sessions(s))


@query("h31_garbage", "WITH w AS (SELECT event_id AS workspace_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), v AS (SELECT workspace_id, CASE WHEN user_id % 3 = 0 THEN 'task ended' WHEN ts < TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR THEN 'old' WHEN r > 20 THEN 'excess' ELSE '' END AS reason FROM w) SELECT * FROM v WHERE reason <> ''")
def h31(t):
    ws = t.events.select(F.col("event_id").alias("workspace_id"), F.col("user_id").alias("task_id"), F.col("ts").alias("created_at"))
    owners = t.events.select(F.col("user_id").alias("task_id")).distinct().withColumn("status", F.when(F.col("task_id") % 3 == 0, "COMPLETED").otherwise("RUNNING"))
    return L.collect_garbage(ws, owners, F.expr("timestamp_ntz '2024-01-10'"))


@query("k15_locks", "SELECT event_type || user_id AS key, event_id AS owner, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1 AND user_id % 5 <> 0 AS acquired FROM events")
def k15(t):
    key = F.concat("event_type", F.col("user_id").cast("string"))
    now = F.expr("timestamp_ntz '2024-02-01'")
    held = t.events.where("user_id % 5 < 2").select(key.alias("key"), F.lit(0).alias("owner"), F.when(F.col("user_id") % 5 == 0, now + F.expr("interval 1 minute")).otherwise(now).alias("expires_at"))
    return L.acquire(held, t.events.select(key.alias("key"), F.col("event_id").alias("owner"), F.col("ts").alias("at")), now).select("key", "owner", "acquired")


@query("k15_release", "SELECT DISTINCT event_type || user_id AS key FROM events WHERE user_id % 2 = 1")
def k15_release(t):
    held = t.events.select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), "user_id").distinct()
    return L.release(held, held.where("user_id % 2 = 0")).select("key")


# --- contexts


@query("p12_shapes", """WITH d AS (SELECT *, ['agent_doc', 'repo_summary', 'episodic_memory', NULL, 'other'][doc_id % 5 + 1] AS st FROM documents)
SELECT doc_id AS id, coalesce(st, 'source_code') AS source_type, CASE WHEN st = 'agent_doc' THEN source || '.md' END AS relative_path, CASE st WHEN 'agent_doc' THEN 'body' WHEN 'episodic_memory' THEN 'c' || doc_id END AS content,
CASE WHEN st IS NULL OR st IN ('repo_summary', 'other') THEN source END AS file, CASE WHEN st IS NULL OR st IN ('repo_summary', 'other') THEN doc_id || '-' || (doc_id + 5) END AS lines, CASE WHEN st = 'repo_summary' THEN coalesce(lang, 'markdown') WHEN st IS NULL OR st = 'other' THEN coalesce(lang, '') END AS language, CASE WHEN st = 'episodic_memory' THEN 'n' || doc_id END AS title, CASE WHEN st = 'agent_doc' THEN '' END AS h1 FROM d""")
def p12(t):
    kind = F.get(F.array(*[F.lit(x) for x in ("agent_doc", "repo_summary", "episodic_memory", None, "other")]), (F.col("doc_id") % 5).cast("int"))
    n = F.col("doc_id").cast("string")
    hits = t.documents.select(F.col("doc_id").alias("id"), F.lit(1.0).alias("score"), kind.alias("source_type"), F.concat("source", F.lit(".md")).alias("relative_path"), F.lit("body").alias("content"), F.concat(F.lit("c"), n).alias("code"), F.concat(F.lit("n"), n).alias("name"), F.col("source").alias("file_path"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + 5).alias("end_line"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("h1"))
    return X.hit_shapes(hits).select("id", "source_type", "relative_path", "content", "file", "lines", "language", "title", "h1")


@query("h20_parse", """WITH e AS (SELECT event_id, event_id % 5 AS k, event_type || event_id AS x FROM events)
SELECT event_id AS id, 0 AS "at", CASE k WHEN 0 THEN x WHEN 1 THEN x WHEN 2 THEN 'search' WHEN 3 THEN 'search_result' ELSE 'unknown' END AS file_path, CASE k WHEN 0 THEN 'body' WHEN 1 THEN 'text' WHEN 2 THEN x WHEN 3 THEN x ELSE '{"other":"' || x || '"}' END AS content, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 ELSE 0.8 END::DOUBLE AS relevance FROM e
UNION ALL SELECT event_id, 1, 'search', 'more', 0.7 FROM e WHERE k = 0""")
def h20(t):
    """The same find in five forms: an object under results, a list with other keys, a list of text, text, an object without known keys."""
    x, k = F.concat("event_type", F.col("event_id").cast("string")), F.col("event_id") % 5
    result = F.when(k == 0, F.concat(F.lit('{"results": [{"file_path": "'), x, F.lit('", "content": "body", "score": 0.5}, "more"]}')))
    result = result.when(k == 1, F.concat(F.lit('[{"path": "'), x, F.lit('", "text": "text", "relevance": 0.25}]'))).when(k == 2, F.concat(F.lit('["'), x, F.lit('"]')))
    result = result.when(k == 3, F.concat(F.lit('{"items": "'), x, F.lit('"}'))).otherwise(F.concat(F.lit('{"chunks": [{"other":"'), x, F.lit('"}]}')))
    return X.parse_results(t.events.select("event_id", result.alias("r")), "event_id", "r")


def _sessions(t):
    c = t.conversations.select(F.col("conv_id").alias("task_id"), (F.col("turn") * 10 + F.when(F.col("role") == "user", 0).otherwise(1)).alias("at"), F.col("role").alias("title"), F.col("role").alias("file_path"), F.col("text").alias("content"), (F.length("text") % 7).alias("relevance"))
    return c.groupBy("task_id", "at", "title", "file_path").agg(F.min("content").alias("content"), F.min("relevance").alias("relevance"))


@query("b4_session", f"""WITH c AS (SELECT conv_id AS task_id, turn * 10 + (role <> 'user')::INT AS pos, role, min(text) AS content, min(length(text) % 7) AS relevance FROM conversations GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY relevance DESC, pos) AS r, count(*) OVER (PARTITION BY task_id) AS n FROM c),
code AS (SELECT task_id, string_agg('### ' || role || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) || chr(10) ORDER BY CASE WHEN n > 20 THEN r ELSE pos END) AS code FROM k WHERE r <= 20 GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos DESC) AS r FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS o FROM l WHERE r <= 10),
mem AS (SELECT task_id, string_agg('- ' || role || ': ' || content, chr(10) ORDER BY pos) AS m FROM f WHERE o <= 5 GROUP BY 1), raw AS (SELECT task_id, '{fixed.MEMORY_HEAD}' || chr(10) || m || chr(10) || chr(10) || code AS raw FROM mem JOIN code USING (task_id))
SELECT task_id, CASE WHEN length(raw) > 1200 THEN substr(raw, 1, 1200) || chr(10) || '{fixed.CONTEXT_CUT[1:]}' ELSE raw END AS context FROM raw""")
def b4(t):
    c = _sessions(t)
    return X.session_text(c, c, F.lit(300))


_FOUND = f"""{sparse_sql(5)}, a AS (SELECT query_id // 4 AS task_id, query_id % 4 AS query_no, rn, d.source AS file_path, substr(d.text, 1, 1500) AS content, score AS relevance, row_number() OVER (PARTITION BY query_id // 4 ORDER BY query_id % 4, rn) AS pos FROM sparse JOIN documents d ON d.doc_id = id WHERE query_id % 4 < 3)"""


@query("b5_assemble", f"""WITH {_FOUND}, c AS (SELECT * FROM a WHERE pos <= 8), code AS (SELECT task_id, count(*) AS n, string_agg('### ' || file_path || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) || chr(10) ORDER BY pos) AS code FROM c GROUP BY 1),
m AS (SELECT item_id // 4 AS task_id, count(*) AS n, string_agg('- note: ' || substr(text, 1, 500), chr(10) ORDER BY item_id) AS m FROM benchmark GROUP BY 1), raw AS (SELECT *, '{fixed.MEMORY_HEAD}' || chr(10) || m.m || chr(10) || chr(10) || code AS raw, code.n AS nc, m.n AS nm FROM m JOIN code USING (task_id)),
x AS (SELECT task_id, nc, nm, CASE WHEN length(raw) > 12000 THEN substr(raw, 1, 12000) || chr(10) || '{fixed.CONTEXT_CUT[1:]}' ELSE raw END AS context FROM raw) SELECT task_id::BIGINT AS task_id, nc AS n_chunks, nm AS n_memory, (length(context) // 4)::BIGINT AS tokens_used, context FROM x""")
def b5(t):
    """Four items are a task's queries (the fourth is one too many) and its memories."""
    hits = R.bm25(item_queries(t), docs(t), 5).join(docs(t), "id")
    found = hits.select(F.floor(F.col("query_id") / 4).alias("task_id"), (F.col("query_id") % 4).alias("query_no"), "rn", F.col("source").alias("file_path"), F.col("text").alias("content"), F.col("score").alias("relevance"))
    memories = t.benchmark.select(F.floor(F.col("item_id") / 4).alias("task_id"), F.col("item_id").alias("at"), F.lit("note").alias("title"), F.col("text").alias("content"))
    return X.assemble(found, memories, 2000, widen=True)


@query("k16_render", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), k AS (SELECT * FROM r WHERE rn <= 3)
SELECT lang AS query_id, '## ''q-' || lang || ''' için Sonuçlar (' || count(*) || ' blok)' || chr(10) || chr(10) || string_agg('### `' || source || '` (doc) — final_score: ' || printf('%.3f', doc_id % 8 / 8) || CASE WHEN doc_id % 2 = 0 THEN ' 📦 75%' ELSE '' END || chr(10) || '📄 `' || source || '` satır 1-' || rn || chr(10) || '```' || lang || chr(10) || substr(text, 1, 800) || chr(10) || '```' || chr(10), chr(10) ORDER BY rn) AS text FROM k WHERE lang IS NOT NULL GROUP BY lang""")
def k16(t):
    top = R.top_k(t.documents.where("lang is not null").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.lit(0).alias("score"), "source", "text"), 3)
    return X.render(top.select("query_id", F.concat(F.lit("q-"), "query_id").alias("query"), "rn", F.col("source").alias("name"), F.lit("doc").alias("type"), (F.col("id") % 8 / 8).alias("final_score"), F.when(F.col("id") % 2 == 0, 0.75).otherwise(1.0).alias("ratio"), F.col("source").alias("file"), F.concat(F.lit("1-"), F.col("rn").cast("string")).alias("lines"), F.col("query_id").alias("language"), F.col("text").alias("code")))


_IMPACTS = "SELECT source AS change, 'f' || doc_id AS file_path, doc_id % 16 / 16 AS score FROM documents"


@query("h11_impact_text", f"""WITH i AS ({_IMPACTS}), r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY score DESC, file_path) AS rn FROM i), h AS (SELECT change, count(*) AS n, count(*) FILTER (score >= 0.7) AS high FROM i GROUP BY 1)
SELECT change, 'Etkilenen ' || n || ' dosya (yüksek risk: ' || high || '):' || chr(10) || string_agg('  ' || file_path || ' → skor=' || printf('%.2f', score + 1e-9) || ' risk=' || CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END, chr(10) ORDER BY rn) AS text FROM r JOIN h USING (change) WHERE rn <= 12 GROUP BY change, n, high""")
def h11(t):
    return X.impact_text(t.documents.select(F.col("source").alias("change"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), (F.col("doc_id") % 16 / 16).alias("score")), "change")


@query("h21_top_files", f"""WITH i AS ({_IMPACTS}) SELECT change, file_path, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY score DESC, file_path) AS rn FROM i) WHERE rn <= 5""")
def h21(t):
    """The five strongest impacts of each change."""
    i = t.documents.select(F.col("source").alias("change"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), (F.col("doc_id") % 16 / 16).alias("score"))
    return R.top_k(i, 5, by="change", id_col="file_path").select("change", "file_path", "score", "rn")


# --- logs


#: The breaker call by call: r holds the state after each one.
BREAKER_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS no, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted, 'closed' AS state, 0 AS failed, 0 AS good, 0.0::DOUBLE AS last FROM e
UNION ALL SELECT user_id, no, event_id, state <> 'open' AS accepted,
  CASE WHEN state = 'open' THEN state WHEN ok AND state = 'half_open' AND good + 1 >= 2 THEN 'closed' WHEN NOT ok AND (state = 'half_open' OR failed + 1 >= 2) THEN 'open' ELSE state END,
  CASE WHEN state = 'open' THEN failed WHEN NOT ok THEN failed + 1 WHEN state = 'half_open' AND good + 1 < 2 THEN failed ELSE 0 END,
  CASE WHEN state = 'half_open' AND ok THEN good + 1 ELSE good END, CASE WHEN state <> 'open' AND NOT ok THEN s ELSE last END
FROM (SELECT e.user_id, e.no, e.event_id, e.s, e.ok, CASE WHEN state = 'open' AND s - last >= 86400.0 THEN 'half_open' ELSE state END AS state, failed, CASE WHEN state = 'open' AND s - last >= 86400.0 THEN 0 ELSE good END AS good, last
  FROM r JOIN e ON e.user_id = r.user_id AND e.no = r.no + 1))
SELECT event_id, accepted, state FROM r WHERE no > 0"""


@query("x16_breaker", BREAKER_SQL)
def x16(t):
    """A breaker for each user; calls are the user's events."""
    e = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") != "error").alias("ok"))
    return L.breaker(e.withColumn("s", F.col("us") / 1e6), "user_id", ["us", "event_id"], ["event_id"], "s", "ok", failures=2, recovery=86_400.0)


@query("x16_backoff", "SELECT event_id, least(1.0::DOUBLE * pow(2.0, event_id % 7), 30.0::DOUBLE) AS seconds FROM events")
def x16_backoff(t):
    return t.events.select("event_id", L.backoff(F.col("event_id") % 7).alias("seconds"))


_RUNS = f"""r AS (SELECT l_orderkey AS task_id, {_NO} AS no, {fixed.PHASES + ['FAILED', 'WAITING']}[l_partkey % 11 + 1] AS phase, ['started', 'completed', 'escalated'][l_suppkey % 3 + 1] AS status FROM lineitem)"""


def run_events(t):
    phase = F.element_at(F.array(*[F.lit(x) for x in [*fixed.PHASES, "FAILED", "WAITING"]]), (F.col("l_partkey") % 11 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("started", "completed", "escalated")]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.expr(_NO).alias("no"), phase.alias("phase"), status.alias("status"))


@query("x14_phases", f"WITH {_RUNS}, g AS (SELECT task_id, max_by(phase, no) AS last_phase, count(*) FILTER (phase = 'EDIT' AND status = 'started') AS n_edits, count(*) FILTER (status = 'escalated') AS escalations FROM r GROUP BY 1) SELECT task_id, last_phase, CASE last_phase WHEN 'DONE' THEN 'done' WHEN 'FAILED' THEN 'failed' WHEN 'WAITING' THEN 'waiting' ELSE 'running' END AS status, n_edits, escalations FROM g")
def x14(t):
    return L.phase_outcomes(run_events(t))


@query("y5_sse", f"""WITH {_RUNS} SELECT task_id, no, 'event: step' || chr(10) || 'data: {{"step":"' || phase || '","status":"' || status || '"}}' || chr(10) || chr(10) AS sse FROM r""")
def y5(t):
    return L.step_events(run_events(t))


_STEPS = "s AS (SELECT *, ['SPEC', 'DONE', 'FAILED', 'EDIT'][event_id % 4 + 1] AS step, ['local', 'cheap', 'reason'][user_id % 3 + 1] AS tier FROM events)"


@query("h22_step_counters", f"WITH {_STEPS} SELECT tier, count(*) FILTER (step = 'SPEC') AS started, count(*) FILTER (step = 'DONE' AND value > 50) AS completed, count(*) FILTER (step = 'FAILED') AS failed, sum(event_id % 3)::BIGINT AS reflections FROM s GROUP BY tier")
def h22(t):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return L.run_summary(t.events.select(pick(("SPEC", "DONE", "FAILED", "EDIT"), F.col("event_id") % 4).alias("step"), pick(("local", "cheap", "reason"), F.col("user_id") % 3).alias("tier"), (F.col("value") > 50).alias("success"), (F.col("event_id") % 3).alias("reflection_count")))


@query("x12_trace", "WITH s AS (SELECT user_id AS trace_id, 'query of ' || repeat(user_id || ' ', 40) AS q, ts, event_id, event_type AS name, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) END AS f FROM events) SELECT trace_id, substr(any_value(q), 1, 80) AS query_preview, round(sum(value), 4) AS total_latency_ms, count(*) AS step_count, coalesce(string_agg(name, ',' ORDER BY r) FILTER (f <= 50), '') AS failed_steps, string_agg(name, '>' ORDER BY r) FILTER (r <= 50) AS path FROM s GROUP BY trace_id")
def x12(t):
    s = t.events.select(F.col("user_id").alias("trace_id"), F.concat(F.lit("query of "), F.repeat(F.concat(F.col("user_id").cast("string"), F.lit(" ")), F.lit(40))).alias("query"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("name"), F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", "Error").alias("error"))
    return L.trace(s).withColumn("total_latency_ms", F.round("total_latency_ms", 4))


@query("h23_snapshot", """SELECT event_type AS tool, user_id % 3 AS shard, count(*) AS value, 'tool_calls_total{tool="' || event_type || '",shard="' || user_id % 3 || '"} ' || count(*) AS line FROM events GROUP BY 1, 2""")
def h23(t):
    return L.counters(t.events.select(F.col("event_type").alias("tool"), (F.col("user_id") % 3).alias("shard")), "tool_calls_total", ["tool", "shard"])


_AUDIT = [*fixed.AUDIT_EVENTS, "gossip"]


@query("h24_audit", f"SELECT event_id, kind AS event_type, user_id::VARCHAR AS collection, '' AS task_id, coalesce(s, '') AS summary FROM (SELECT *, {_AUDIT}[event_id % 6 + 1] AS kind, CASE WHEN event_id % 2 = 0 THEN event_type END AS s FROM events) WHERE kind <> 'gossip'")
def h24(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in _AUDIT]), (F.col("event_id") % 6 + 1).cast("int"))
    return L.audit(t.events.select("event_id", kind.alias("event_type"), F.col("user_id").alias("collection"), F.lit(None).cast("string").alias("task_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("summary")))


@query("h25_model_chain", "WITH c AS (SELECT event_id, CASE WHEN event_type = 'view' THEN ['a', 'r'] WHEN event_type = 'error' THEN ['r', 'a'] ELSE ['m', 'a', 'r'] END AS chain FROM events) SELECT event_id, chain[least(event_id % 5 + 1, len(chain))] AS used FROM c")
def h25(t):
    """The chosen model may be one of the others already; attempts go on with the last."""
    chosen = F.when(F.col("event_type") == "view", "a").when(F.col("event_type") == "error", "r").otherwise("m")
    return t.events.select("event_id", L.model_of(L.model_chain(chosen, F.lit("a"), F.lit("r")), F.col("event_id") % 5 + 1).alias("used"))


@query("y6_jobs", "SELECT event_id, minute(date_trunc('minute', ts)) = 0 AS cleanup, minute(ts) = 30 AS sessions, hour(ts) = 3 AND minute(ts) = 0 AS memory_cycle FROM events")
def y6(t):
    return t.events.select("event_id", *[c.alias(k) for k, c in L.due(F.col("ts")).items()])


@query("y8_bounded_wait", "SELECT event_id, CASE WHEN value <= 55 THEN 'result' ELSE 'background' END AS reply FROM events")
def y8(t):
    return t.events.select("event_id", L.reply(F.col("value")).alias("reply"))


@query("h28_command_results", "SELECT event_id AS run_id, CASE WHEN value > 80 THEN -1 ELSE (user_id % 2)::INT END AS exit_code, least(value, 80.0) AS duration, value > 80 AS timed_out, value <= 80 AND user_id % 2 = 0 AS success FROM events")
def h28(t):
    return L.command_results(t.events.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 2).alias("exit_code"), F.col("value").alias("duration"), F.lit(80.0).alias("limit")))


@query("s15_frames", "SELECT event_id AS id, event_type || coalesce(props, '') AS text FROM events")
def s15(t):
    """Each event's type and properties as two frames of a multiplexed stream."""
    head = lambda c: F.concat(F.unhex(F.lit("01000000")), F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), F.encode(c, "utf-8"))
    return L.frames(t.events.select("event_id", F.concat(head(F.col("event_type")), head(F.coalesce("props", F.lit("")))).alias("body")), "event_id", "body")


# --- schemas, nodes, vectors


@query("h36_migrate", "SELECT o_orderkey, o_orderstatus, 0 AS reflection_count, 'new' AS phase FROM orders")
def h36(t):
    schema = {"o_orderkey": ("long", None), "o_orderstatus": ("string", None), "reflection_count": ("int", 0), "phase": ("string", "new")}
    once = L.migrate(t.orders.select("o_orderkey", "o_orderstatus"), schema)
    return L.migrate(once, schema)


@query("h35_chunk_dict", "SELECT p_partkey, 'p' || p_partkey AS name, p_size AS start_line, 'a,b' AS imports, false AS has_docstring FROM part")
def h35(t):
    c = t.part.select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("start_line"), F.array(F.lit("a"), F.lit("b")).alias("imports"), F.lit(None).cast("string").alias("docstring"))
    j = L.chunk_dicts(c, "p_partkey").select("p_partkey", F.from_json("json", "name string, start_line int, imports array<string>").alias("c"), F.contains("json", F.lit("docstring")).alias("has_docstring"))
    return j.select("p_partkey", "c.name", "c.start_line", F.array_join("c.imports", ",").alias("imports"), "has_docstring")


@query("k2_doc_upsert", "SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE coalesce(lang, '') END AS content, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS schema_version, 'agent_doc' AS source_type, 'normal' AS doc_priority, source AS relative_path, false AS is_deleted FROM documents")
def k2(t):
    """All fields of the payload; every second chunk comes again."""
    old = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("content"), F.col("source").alias("relative_path"))
    new = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("new").alias("content"), F.col("source").alias("relative_path"), F.lit(2).alias("schema_version"))
    got = D.upsert(L.doc_payloads(old), L.doc_payloads(new), "chunk_id")
    assert got.columns == list(fixed.DOC_PAYLOAD)
    return got.select("chunk_id", "content", "schema_version", "source_type", "doc_priority", "relative_path", "is_deleted")


@query("k7_nodes", "SELECT 'Class' AS label, 'c' || c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c FROM customer UNION ALL SELECT 'File', 'n' || n_nationkey, 'x', NULL, NULL FROM nation")
def k7(t):
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    old = t.customer.select(F.lit("Class").alias("label"), key.alias("node_id"), F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")).alias("props"))
    new = t.customer.where("c_custkey % 2 = 0").select(F.lit("Class").alias("label"), key.alias("node_id"), F.lit(None).cast("string").alias("name"), F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.col("c_mktsegment")).alias("props"))
    named = t.nation.select(F.lit("File").alias("label"), F.lit(None).cast("string").alias("node_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.create_map(F.lit("a"), F.lit("x")).alias("props"))
    got = L.merge_nodes(old, new.union(named))
    return got.select("label", "node_id", *[F.try_element_at("props", F.lit(k)).alias(k) for k in "abc"])


@query("k7_edges", "SELECT 'c' || c_custkey AS src, 'OWNS' AS rel, 'n' || c_nationkey AS dst FROM customer WHERE c_nationkey < 20")
def k7_edges(t):
    """Edges of unknown types, and edges to nations that are no nodes, are left out."""
    from quern.plans.graph_plans import tag

    nodes = t.customer.select(tag("c", "c_custkey").alias("node_id")).union(t.nation.where("n_nationkey < 20").select(tag("n", "n_nationkey")))
    e = t.customer.select(tag("c", "c_custkey").alias("src"), F.lit("OWNS").alias("rel"), tag("n", "c_nationkey").alias("dst"))
    return L.link_nodes(nodes, e.union(t.customer.select(tag("c", "c_custkey"), F.lit("KNOWS"), tag("n", "c_nationkey"))).union(e))


@query("s9_match", "SELECT 's' || l_suppkey AS src, 'CALLS' AS rel, 'p' || l_partkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 7 = 0 AND p_size > 25")
def s9(t):
    """(Class)-[CALLS|CONTAINS]->(Function): large parts are functions, suppliers classes."""
    from quern.plans.graph_plans import edges, tag

    nodes = t.supplier.select(tag("s", "s_suppkey").alias("name"), F.lit("Class").alias("label")).union(t.part.where("p_size > 25").select(tag("p", "p_partkey"), F.lit("Function")))
    return L.match(nodes, edges(t), "Class", ["CALLS", "CONTAINS"], "Function")


@query("h7_sparse", f"WITH k AS (SELECT doc_id AS id, {TOK.format('text')} AS t FROM documents), f AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM k) GROUP BY ALL) SELECT id, round(sum(round(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / 256)), 6)), 3) AS weight FROM f GROUP BY id")
def h7(t):
    v = L.sparse_vectors(docs(t))
    return v.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["weight"]), 3).alias("weight"))
