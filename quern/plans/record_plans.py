"""Record-level queries: scans and filters by key, projections, rendering, task life cycle, traces, parsing with fall-backs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import ladder, lookup, tokens
from quern.operators import aggregates as A
from quern.operators import chunking as C
from quern.operators import dml as D
from quern.operators import graph as G
from quern.operators import memory as M
from quern.plans.memory_plans import _MEM, memories
from quern.plans.registry import query
from quern.plans.retrieval_plans import TOK


@query("k12_memory_write", "SELECT conv_id, turn, 'new' AS origin FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, turn, 'old' FROM conversations WHERE turn <> 0")
def k12(t):
    old = t.conversations.select("conv_id", "turn", F.lit("old").alias("origin"))
    new = t.conversations.where("turn = 0").select("conv_id", "turn", F.lit("new").alias("origin"))
    return D.upsert(old, new, ["conv_id", "turn"])


@query("p2_doc_filter", "SELECT doc_id FROM documents WHERE lang = 'de' AND NOT source = 'src2'")
def p2(t):
    rows = D.tombstone(t.documents.select("doc_id", "lang", "source", F.lit(False).alias("is_deleted")), F.col("source") == "src2")
    return rows.where("lang = 'de' and not is_deleted").select("doc_id")


@query("p6_memory_filter", f"WITH {_MEM} SELECT conv_id, turn FROM l WHERE layer = 'semantic' AND status = 'active'")
def p6(t):
    return memories(t).where((F.col("layer") == "semantic") & (F.col("status") == "active")).select("conv_id", "turn")


@query("p8_names", "SELECT doc_id FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey < 5)")
def p8(t):
    names = t.nation.where("n_nationkey < 5").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return t.documents.join(names, "source", "left_semi").select("doc_id")


@query("p15_valid", f"WITH {_MEM} SELECT conv_id, turn, status = 'active' AND (valid_to IS NULL OR valid_to >= 40) AS valid FROM l")
def p15(t):
    return memories(t).select("conv_id", "turn", M.valid(F.lit(40)).alias("valid"))


@query("p16_labels", "SELECT c_custkey, c_custkey % 2 = 0 AS ok FROM customer")
def p16(t):
    e = t.customer.select("c_custkey", F.lit("Class").alias("src_label"), F.when(F.col("c_custkey") % 2 == 0, "CALLS").otherwise("LIKES").alias("rel"), F.lit("Function").alias("dst_label"))
    return G.check_labels(e).select("c_custkey", "ok")


@query("u3_intersection", f"SELECT item_id, len(list_intersect(list_distinct({TOK.format('text')}), ['the', 'of', 'and']))::INT AS shared FROM benchmark")
def u3(t):
    return t.benchmark.select("item_id", F.size(F.array_intersect(tokens(F.col("text")), F.array(F.lit("the"), F.lit("of"), F.lit("and")))).alias("shared"))


@query("u5_subset", "SELECT count(*) = 0 AS is_subset FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def u5(t):
    return t.labels.select("doc_id").join(t.documents, "doc_id", "left_anti").agg((F.count("*") == 0).alias("is_subset"))


_X2 = """WITH p AS (SELECT 'm' || p_partkey || '.py' AS path, p_size FROM part)
SELECT path, 'Big' AS name, 'GOD_CLASS' AS smell, (2 * (p_size // 2 + 1) + 1)::INT AS value FROM p WHERE p_size // 2 + 1 > 15 UNION ALL SELECT path, 'long', 'LONG_METHOD', (p_size + 11)::INT FROM p WHERE p_size + 11 > 50"""


@query("x2_python_smells", _X2)
def x2(t):
    """Each part is a module with a class of p_size / 2 + 1 methods and a function of p_size + 11 lines."""
    lines = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int")), f), "\n")
    methods = lines(F.col("p_size") / 2, lambda i: F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self):\n        pass")))
    long = lines(F.col("p_size") + 9, lambda i: F.concat(F.lit("    x = "), i.cast("string")))
    body = F.concat(F.lit("class Big:\n"), methods, F.lit("\n\ndef long():\n"), long, F.lit("\n"))
    return M.python_smells(M.code_chunks(t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))))


@query("y3_last_n", "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def y3(t):
    return A.last_n(t.events, "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "rn")


@query("h33_doc_chunks", r"""WITH r AS (SELECT doc_id, text, {} AS safe, {} AS risk FROM documents WHERE n_chars > 0) SELECT doc_id, sha256(safe) AS checksum, substr(sha256('doc|' || doc_id || '|0'), 1, 16) AS chunk_id FROM r WHERE risk <= 0.8""")
def h33(t):
    """Sections redacted, skipped if too risky, with ids by position and checksums after redaction."""
    safe, risk = C.redact(F.col("text"))
    return t.documents.where("n_chars > 0").select("doc_id", F.sha2(safe, 256).alias("checksum"), C.chunk_id(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("0")).alias("chunk_id"), risk.alias("risk")).where("risk <= 0.8").drop("risk")


@query("s12_log_lines", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'INFO' ELSE upper(event_type) END AS level, CASE WHEN event_id % 4 = 0 THEN 'not json ' || event_id ELSE 'took ' || event_id END AS msg FROM events")
def s12(t):
    """JSON lines parsed; a malformed line becomes an INFO record."""
    from quern.sources.tables import parse_log

    line = F.when(F.col("event_id") % 4 == 0, F.format_string("not json %d", "event_id")).otherwise(F.to_json(F.struct(F.upper("event_type").alias("level"), F.format_string("took %d", "event_id").alias("msg"))))
    r = t.events.select("event_id", parse_log(line, F.lit("2024-01-01")).alias("r"))
    return r.select("event_id", "r.level", "r.msg")


@query("h2_decisions", f"WITH {_MEM} SELECT conv_id, turn, 'architectural_decision' AS memory_type, 'decision' AS layer FROM l WHERE role = 'assistant'")
def h2(t):
    kind = F.lit("architectural_decision")
    return memories(t).where("role = 'assistant'").select("conv_id", "turn", kind.alias("memory_type"), M.layer(kind).alias("layer"))


@query("h3_recall", f"WITH {_MEM}, r AS (SELECT conv_id, turn, substr(content, 1, 600) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, content) AS rn FROM l WHERE status = 'active' AND (valid_to IS NULL OR valid_to >= 40)) SELECT conv_id, turn, content, rn FROM r WHERE rn <= 3")
def h3(t):
    rows = M.recall(memories(t), F.lit(40))
    return A.last_n(rows, "conv_id", [F.desc("turn"), F.col("role"), F.col("content")], 3).select("conv_id", "turn", F.substring("content", 1, 600).alias("content"), "rn")


@query("h17_router", "SELECT event_id, CASE WHEN value >= 70 THEN 'reason' WHEN value >= 30 OR user_id % 5 = 0 THEN 'cheap' ELSE 'local' END AS tier FROM events")
def h17(t):
    """Tier by score; an unhealthy local model hands its share to the cheap one."""
    score, healthy = F.col("value") / 100, F.col("user_id") % 5 != 0
    tier = ladder([(score >= 0.70, "reason"), (score >= 0.30, "cheap"), (~healthy, "cheap")], "local")
    return t.events.select("event_id", tier.alias("tier"))


def _fill() -> None:
    from quern.plans.chunk_plans import _redact_sql
    from quern.plans.registry import SQL

    SQL["h33_doc_chunks"] = SQL["h33_doc_chunks"].format(*_redact_sql())


_fill()
