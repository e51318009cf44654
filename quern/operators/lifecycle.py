"""Tasks, checkpoints, sessions, learning records, metrics and audits: conditional changes of tables, and folds of event logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions.text import ladder
from quern.operators import aggregates, dml, retrieval

FINAL = ["done", "failed", "aborted"]
CHECKPOINT_VERSION = 1
LOCK_SECONDS = 600


# --- tasks


def approve(tasks: DataFrame, approvals: DataFrame) -> DataFrame:
    """``tasks`` (task_id, status, ...) with feedback: those that wait for approval and are in ``approvals`` (task_id, feedback) go
    on executing; approvals of other tasks change nothing. ``approved`` says which."""
    one = approvals.groupBy("task_id").agg(F.min("feedback").alias("_f"))
    j = tasks.join(one, "task_id", "left").withColumn("approved", (F.col("status") == "waiting_approval") & F.col("_f").isNotNull())
    return j.withColumn("status", F.when(F.col("approved"), "executing").otherwise(F.col("status"))).withColumn("feedback", F.when(F.col("approved"), F.col("_f"))).drop("_f")


def complete(tasks: DataFrame, steps: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and steps after requests (task_id) to complete: a task that is neither done nor aborted becomes done, and with it
    those of its steps that have not ended."""
    hit = requests.select("task_id").distinct().join(tasks.where(~F.col("status").isin("done", "aborted")).select("task_id"), "task_id").withColumn("_hit", F.lit(True))
    over = lambda df, ended: df.join(hit, "task_id", "left").withColumn("status", F.when(F.col("_hit") & ~F.col("status").isin(ended), "done").otherwise(F.col("status"))).drop("_hit")
    return over(tasks, ["done", "aborted"]), over(steps, FINAL)


def latest(checkpoints: DataFrame, by: str = "task_id", order: str = "at") -> DataFrame:
    """The newest checkpoint of each task."""
    fields = [c for c in checkpoints.columns if c != by]
    return checkpoints.groupBy(by).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_c")).select(by, "_c.*")


def resume(tasks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """task_id, current_node, resume_from_step of every task that has a checkpoint (task_id, at, node, step)."""
    last = latest(checkpoints).select("task_id", F.col("node").alias("current_node"), F.col("step").alias("resume_from_step"))
    return tasks.select("task_id").join(last, "task_id")


def save_checkpoints(store: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by task: the newest row of each task wins over the stored one."""
    return dml.upsert(store, latest(new).select(*store.columns), "task_id")


_CHECKPOINT = "version int, task_id string, step string, goal string, reflection_count int, opened_files array<string>, last_failures array<string>, workspace_path string, snapshot_ref string, tokens_used int"


def checkpoint_json(rows: DataFrame) -> DataFrame:
    """task_id and the checkpoint as JSON of the current version."""
    fields = [F.lit(CHECKPOINT_VERSION).alias("version"), *[c for c in rows.columns if c != "version"]]
    return rows.select("task_id", F.to_json(F.struct(*fields)).alias("json"))


def load_checkpoints(cache: DataFrame, table: DataFrame) -> DataFrame:
    """Checkpoints (task_id, json) from the cache, else from the table; older versions get the fields they lack."""
    both = table.select("task_id", F.col("json").alias("_t")).join(cache.select("task_id", F.col("json").alias("_c")), "task_id", "full_outer")
    c = both.select("task_id", F.when(F.col("_c").isNotNull(), "cache").otherwise("table").alias("origin"), F.from_json(F.coalesce("_c", "_t"), _CHECKPOINT).alias("c"))
    none = F.array().cast("array<string>")
    get = lambda name, default: F.coalesce(F.col(f"c.{name}"), default).alias(name)
    return c.select("task_id", "origin", F.greatest(F.coalesce("c.version", F.lit(0)), F.lit(CHECKPOINT_VERSION)).alias("version"), F.col("c.step").alias("step"), get("goal", F.lit("")), get("reflection_count", F.lit(0)), get("opened_files", none), get("last_failures", none), get("workspace_path", F.lit("")), get("snapshot_ref", F.lit("")), get("tokens_used", F.lit(0)))


def set_status(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Tasks after status updates (task_id, status); unknown states are ignored."""
    good = updates.where(F.col("status").isin(fixed.TASK_STATUSES)).groupBy("task_id").agg(F.max("status").alias("_s"))
    return tasks.join(good, "task_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def active(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin("RUNNING", "SUSPENDED")).select("task_id")


def history(tasks: DataFrame, by: str, at: str, limit: int = 20) -> DataFrame:
    """The newest ``limit`` tasks of each collection, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc("task_id"))
    return tasks.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= limit)


def plan_steps(tasks: DataFrame, answer: str = "answer") -> DataFrame:
    """task_id, step (from 0), description: the planner's answer if it is a JSON array, else the lines of the task's description,
    else the description, the title or a fixed step."""
    listed = F.from_json(answer, "array<string>")
    good = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
    lines = F.filter(F.split(F.coalesce("description", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    stripped = F.transform(lines, lambda x: F.regexp_replace(x, "^[- ]+|[- ]+$", ""))
    whole = F.array(F.coalesce(F.when(F.col("description") != "", F.col("description")), F.when(F.col("title") != "", F.col("title")), F.lit(fixed.DEFAULT_STEP)))
    is_list = F.ltrim(F.coalesce(answer, F.lit(""))).startswith("[") & listed.isNotNull()
    steps = F.when(is_list, good).when(F.size(stripped) > 0, stripped).otherwise(whole)
    return tasks.select("task_id", F.posexplode(steps).alias("step", "description"))


def bounded_loop(steps: DataFrame, cap: int, budget: Column, cost: str = "tokens") -> DataFrame:
    """Steps (task_id, step) that a loop runs before its cap or its budget stops it, and why it stopped at the first other."""
    w = Window.partitionBy("task_id").orderBy("step")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("no", F.row_number().over(w)).withColumn("spent", F.coalesce(F.sum(cost).over(upto), F.lit(0)))
    verdict = ladder([(F.col("no") > cap, "step cap"), (F.col("spent") > budget, "budget")], "run")
    rows = rows.withColumn("verdict", verdict)
    before = F.coalesce(F.max((F.col("verdict") != "run").cast("int")).over(upto), F.lit(0))
    return rows.withColumn("_b", before).where("_b = 0").select("task_id", "step", "verdict")


def learning_records(steps: DataFrame) -> DataFrame:
    """A memory of each successful step (task_id, title, description, result, ok)."""
    text = F.format_string(fixed.LEARNED_TEXT, "title", "description", F.substring("result", 1, 500))
    return steps.where("ok").select("task_id", F.concat(F.lit(fixed.LEARNED_TITLE), F.substring("description", 1, 80)).alias("title"), text.alias("content"), F.lit("resolved_incident").alias("memory_type"), F.array(F.lit("task_learning"), F.lit("successful_step")).alias("tags"))


def outcome_records(runs: DataFrame, max_reflections: int = 6) -> DataFrame:
    """A memory of each run (task_id, goal, tier, reflections, ok, error), and whether a person has to look at it."""
    good = F.format_string(fixed.SOLVED_TEXT, F.substring("goal", 1, 120), "tier", "reflections")
    bad = F.format_string(fixed.FAILED_TEXT, "tier", "reflections", F.substring(F.coalesce("error", F.lit("")), 1, 200))
    title = F.when(F.col("ok"), F.concat(F.lit(fixed.SOLVED_TITLE), F.substring("goal", 1, 60))).otherwise(F.format_string(fixed.FAILED_TITLE, "tier"))
    return runs.select("task_id", title.alias("title"), F.when(F.col("ok"), good).otherwise(bad).alias("content"), (F.col("reflections") > max_reflections).alias("needs_review"))


def related(tasks: DataFrame, memories: DataFrame) -> DataFrame:
    """task_id, count, suggestions: how many of the five best memories (id, name, content) of each task there are, and the names
    (100 characters) of the first three."""
    from quern.operators import memory

    q = tasks.select(F.col("task_id").alias("query_id"), F.concat_ws(" ", "title", "description").alias("text"))
    hits = memory.search(q, memories, 5).join(memories.select("id", "name"), "id")
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", F.substring("name", 1, 100).alias("name"))))), lambda x: x["name"])
    return hits.groupBy(F.col("query_id").alias("task_id")).agg(F.count("*").alias("count"), F.array_join(names, "|").alias("suggestions"))


# --- sessions, workspaces, locks


def save_sessions(sessions: DataFrame) -> DataFrame:
    """task_id and the small part of a session that is kept for good, as JSON: texts are cut to 500 and 200 characters."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return sessions.select("task_id", F.to_json(F.struct(F.col("current_step").alias("step"), cut("spec", 500).alias("spec"), cut("test_code", 200).alias("test_code"), "tokens_used", "memory_count")).alias("extra"))


def load_sessions(cache: DataFrame, saved: DataFrame) -> DataFrame:
    """Sessions (task_id, json) from the cache, else from what was kept (task_id, extra)."""
    schema = "current_step string, step string, spec string, test_code string, tokens_used int, memory_count int"
    both = cache.select("task_id", F.col("json").alias("_c")).join(saved, "task_id", "full_outer")
    s = both.select("task_id", F.col("_c").isNotNull().alias("cached"), F.from_json(F.coalesce("_c", "extra"), schema).alias("s"))
    return s.select("task_id", "cached", F.coalesce("s.current_step", "s.step").alias("current_step"), F.coalesce("s.spec", F.lit("")).alias("spec"), F.coalesce("s.test_code", F.lit("")).alias("test_code"), F.coalesce("s.tokens_used", F.lit(0)).alias("tokens_used"))


def collect_garbage(workspaces: DataFrame, tasks: DataFrame, now: Column, hours: int = 24, keep: int = 20) -> DataFrame:
    """workspace_id and why it goes: its task is not active, it is older than ``hours``, or its task has ``keep`` newer ones."""
    newer = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("created_at"), F.desc("workspace_id")))
    rows = workspaces.withColumn("_r", newer).join(active(tasks).withColumn("_live", F.lit(True)), "task_id", "left")
    old = F.col("created_at") < now - F.expr(f"interval {hours} hours")
    why = ladder([(F.col("_live").isNull(), "task ended"), (old, "old"), (F.col("_r") > keep, "excess")], "")
    return rows.select("workspace_id", why.alias("reason")).where("reason <> ''")


def acquire(locks: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests (key, owner, at) and whether each gets its lock: the first of a key, unless a lock (key, owner, expires_at) lives."""
    live = locks.where(F.col("expires_at") > now).select("key", F.lit(True).alias("_held")).distinct()
    first = F.row_number().over(Window.partitionBy("key").orderBy("at", "owner")) == 1
    rows = requests.withColumn("_first", first).join(live, "key", "left")
    got = F.col("_first") & F.col("_held").isNull()
    return rows.select("key", "owner", got.alias("acquired"), F.when(got, now + F.expr(f"interval {LOCK_SECONDS} seconds")).alias("expires_at"))


def release(locks: DataFrame, keys: DataFrame) -> DataFrame:
    return dml.delete(locks, keys, "key")


# --- logs


def breaker_step(state: tuple, call: tuple, failures: int, recovery: float, successes: int) -> tuple:
    """((name, failures, successes, last failure), (accepted, name)) after a call (seconds, ok) of a circuit breaker."""
    name, failed, good, last = state
    at, fine = call
    if name == "open" and at - last >= recovery:
        name, good = "half_open", 0
    if name == "open":
        return (name, failed, good, last), (False, name)
    if fine:
        if name == "half_open":
            good += 1
            name, failed = ("closed", 0) if good >= successes else (name, failed)
        else:
            failed = 0
    else:
        failed, last = failed + 1, at
        name = "open" if name == "half_open" or failed >= failures else name
    return (name, failed, good, last), (True, name)


def breaker(events: DataFrame, by: str, order: list[str], keep: list[str], seconds: str, ok: str, failures: int = 5, recovery: float = 60.0, successes: int = 2) -> DataFrame:
    """``keep``, accepted and state (closed, open, half_open) after each call of a circuit breaker, by group in order.

    ``seconds``: the call's time. Open from ``failures`` failures in a row on; calls are refused until ``recovery`` seconds have
    passed since the last failure; then half open, where a failure opens it again and ``successes`` successes close it.
    """
    step = lambda state, call: breaker_step(state, call, failures, recovery, successes)
    types = dict(events.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", accepted boolean, state string"
    return aggregates.scanned(events, [by], order, keep, [seconds, ok], ("closed", 0, 0, 0.0), step, schema)


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """Seconds to wait after an attempt (from 0), without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))


def phase_outcomes(events: DataFrame) -> DataFrame:
    """task_id, last_phase, status, n_edits, escalations of runs from their events (task_id, no, phase, status).

    A run is done if its DONE has completed, failed at FAILED, waiting at WAITING, else running.
    """
    last = F.max_by("phase", "no")
    status = ladder([(last == "DONE", "done"), (last == "FAILED", "failed"), (last == "WAITING", "waiting")], "running")
    n = lambda phase: F.count_if((F.col("phase") == phase) & (F.col("status") == "started"))
    return events.groupBy("task_id").agg(last.alias("last_phase"), status.alias("status"), n("EDIT").alias("n_edits"), F.count_if(F.col("status") == "escalated").alias("escalations"))


def step_events(events: DataFrame) -> DataFrame:
    """task_id, no and the server-sent text of each step event (phase, status)."""
    body = F.to_json(F.struct(F.col("phase").alias("step"), "status"))
    return events.select("task_id", "no", F.concat(F.lit("event: step\ndata: "), body, F.lit("\n\n")).alias("sse"))


def run_summary(events: DataFrame) -> DataFrame:
    """tier, started, completed, failed, reflections of the runs' step events (step, tier, success, reflection_count)."""
    n = lambda step: F.col("step") == step
    return events.groupBy("tier").agg(F.count_if(n("SPEC")).alias("started"), F.count_if(n("DONE") & F.col("success")).alias("completed"), F.count_if(n("FAILED")).alias("failed"), F.sum("reflection_count").alias("reflections"))


def trace(steps: DataFrame, shown: int = 50) -> DataFrame:
    """trace_id, query_preview, total_latency_ms, step_count, failed_steps, path of pipeline traces.

    ``steps``: trace_id, query, at, name, latency_ms, error. Names of the first ``shown`` steps (and failed steps) are listed.
    """
    w = Window.partitionBy("trace_id").orderBy("at")
    rows = steps.withColumn("_r", F.row_number().over(w)).withColumn("_f", F.when(F.col("error").isNotNull(), F.row_number().over(Window.partitionBy("trace_id", F.col("error").isNull()).orderBy("at"))))
    names = lambda rank: F.transform(F.array_sort(F.collect_list(F.when(F.col(rank) <= shown, F.struct(rank, "name")))), lambda x: x["name"])
    return rows.groupBy("trace_id").agg(F.substring(F.min_by("query", "at"), 1, 80).alias("query_preview"), F.sum("latency_ms").alias("total_latency_ms"), F.count("*").alias("step_count"), F.array_join(names("_f"), ",").alias("failed_steps"), F.array_join(names("_r"), ">").alias("path"))


def counters(df: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """labels, value and the exposition line of a counter by its labels."""
    text = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    return df.groupBy(*labels).agg(F.count("*").alias("value")).select(*labels, "value", F.concat(F.lit(metric + "{"), text, F.lit("} "), F.col("value").cast("string")).alias("line"))


def audit(events: DataFrame) -> DataFrame:
    """Rows of the audit log: events of the fixed vocabulary, with '' for what is missing."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return events.where(F.col("event_type").isin(fixed.AUDIT_EVENTS)).select("event_id", "event_type", part("collection"), part("task_id"), part("summary"))


def model_chain(model: Column, analysis: Column, reasoning: Column) -> Column:
    """Models to try in turn: the chosen one, then the analysis and the reasoning model, each once."""
    return F.array_distinct(F.array(model, analysis, reasoning))


def model_of(chain: Column, attempt: Column) -> Column:
    """The model of an attempt (from 1); the last one for all further attempts."""
    return F.element_at(chain, F.least(attempt, F.size(chain)).cast("int"))


def due(at: Column) -> dict[str, Column]:
    """Which periodic jobs are due at a time: hourly clean-up, sessions at half past, the memory cycle at 3 in the morning."""
    hour, minute = F.hour(at), F.minute(at)
    return {"cleanup": minute == 0, "sessions": minute == 30, "memory_cycle": (hour == 3) & (minute == 0)}


def reply(duration_s: Column, limit: float = 55.0) -> Column:
    """Whether a caller gets the result, or the note that it goes on in the background."""
    return F.when(duration_s <= limit, "result").otherwise("background")


def command_results(runs: DataFrame) -> DataFrame:
    """Runs (exit_code, duration, limit) as result rows: over the limit they have timed out, with exit code -1."""
    late = F.col("duration") > F.col("limit")
    code = F.when(late, F.lit(-1)).otherwise(F.col("exit_code")).cast("int")
    return runs.select("run_id", code.alias("exit_code"), F.least("duration", "limit").alias("duration"), late.alias("timed_out"), (code == 0).alias("success"))


def frames(rows: DataFrame, id_col: str, body: str) -> DataFrame:
    """id and text of multiplexed container output: frames of an 8-byte header (length in its last four bytes) and a payload.

    A body without any text in frames is taken as it is.
    """
    @F.pandas_udf("string")
    def text(bodies: pd.Series) -> pd.Series:
        out = []
        for b in bodies:
            b, at, found = bytes(b or b""), 0, []
            while at + 8 <= len(b):
                size = int.from_bytes(b[at + 4 : at + 8], "big")
                found.append(b[at + 8 : at + 8 + size].decode(errors="replace"))
                at += 8 + size
            joined = "".join(found)
            out.append(joined if joined.strip() else b.decode(errors="replace"))
        return pd.Series(out)

    return rows.select(F.col(id_col).alias("id"), text(body).alias("text"))


# --- schemas


def migrate(table: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """``table`` with every column of ``schema`` (name: type, default) that it lacks; running it again changes nothing."""
    missing = {c: F.lit(v).cast(t) for c, (t, v) in schema.items() if c not in table.columns}
    return table.withColumns(missing) if missing else table


def chunk_dicts(chunks: DataFrame, key: str) -> DataFrame:
    """key and the whole chunk as JSON; empty semantic_meta is left out, as JSON omits nulls."""
    return chunks.select(key, F.to_json(F.struct(*chunks.columns)).alias("json"))


def doc_payloads(chunks: DataFrame) -> DataFrame:
    """Document chunks with exactly the fields of their payload, defaults for what is missing."""
    return chunks.select(*[(F.coalesce(F.col(c), F.lit(v)) if c in chunks.columns else F.lit(v)).alias(c) for c, v in fixed.DOC_PAYLOAD.items()])


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (label, node_id, props map) by key: a new node's properties override an old one's, others stay.

    ``new`` may name its id node_id, id or name; rows without any are left out.
    """
    ident = F.coalesce(*[F.col(c) for c in ("node_id", "id", "name") if c in new.columns])
    named = new.select("label", ident.alias("node_id"), F.col("props").alias("_n")).where("node_id is not null and node_id <> ''")
    j = old.join(named, ["label", "node_id"], "full_outer")
    empty = F.expr("map()").cast("map<string,string>")
    had, got = F.coalesce("props", empty), F.coalesce("_n", empty)
    return j.select("label", "node_id", F.map_concat(F.map_filter(had, lambda k, v: ~F.map_contains_key(got, k)), got).alias("props"))


def link_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) of known types whose ends both exist, each once."""
    ids = nodes.select("node_id").distinct()
    good = edges.where(F.col("rel").isin(fixed.EDGE_TYPES)).select("src", "rel", "dst").distinct()
    return good.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def match(nodes: DataFrame, edges: DataFrame, source: str | None = None, rel: list[str] | None = None, target: str | None = None) -> DataFrame:
    """src, rel, dst of the pattern (source label)-[types]->(target label); None matches all."""
    rows = edges if rel is None else edges.where(F.col("rel").isin(rel))
    for end, label in (("src", source), ("dst", target)):
        if label is not None:
            rows = rows.join(nodes.where(F.col("label") == label).select(F.col("name").alias(end)).distinct(), end, "left_semi")
    return rows.select("src", "rel", "dst")


def sparse_vectors(docs: DataFrame, buckets: int = 1 << 20, k1: float = 1.2, b: float = 0.75, avg_len: float = 256.0) -> DataFrame:
    """id and the sparse vector of each text: (index, weight) by index, index the term's hash, weight its saturated frequency."""
    p = retrieval.postings(docs)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / avg_len))
    rows = p.select("id", F.pmod(F.crc32("term"), F.lit(buckets)).alias("index"), F.round(weight, 6).alias("weight"))
    # terms that share an index add up
    one = rows.groupBy("id", "index").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("vector"))
