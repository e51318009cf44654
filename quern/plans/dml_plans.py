"""Change, sync, set and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import collection_name, hit_key
from quern.operators import dml as D
from quern.plans.registry import query

_V1 = "v1 AS (SELECT doc_id, sha256(text) AS checksum FROM documents WHERE doc_id % 3 <> 0)"
_V2 = "v2 AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS checksum FROM documents WHERE doc_id % 7 <> 0)"


def v1(t):
    return t.documents.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("checksum"))


def v2(t):
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return t.documents.where("doc_id % 7 <> 0").select("doc_id", F.sha2(text, 256).alias("checksum"))


@query("k1_upsert", f"WITH {_V1}, {_V2} SELECT * FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM v2) UNION ALL SELECT * FROM v2")
def k1(t):
    return D.upsert(v1(t), v2(t), "doc_id")


@query("k3_delete", f"WITH {_V1} SELECT * FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k3(t):
    return D.delete(v1(t), t.labels, "doc_id")


@query("k4_delete_where", "SELECT count(*) AS deleted FROM documents WHERE lang = 'de'")
def k4(t):
    return D.delete_where(t.documents, F.col("lang") == "de")[1]


@query("k5_tombstone", "SELECT doc_id, source = 'src2' AS is_deleted FROM documents")
def k5(t):
    return D.tombstone(t.documents.select("doc_id", "source", F.lit(False).alias("is_deleted")), F.col("source") == "src2").select("doc_id", "is_deleted")


@query("k8_log_rows", "SELECT item_id, substr(text, 1, 80) AS query, substr(sha256(item_id::VARCHAR), 1, 16) AS user_hash FROM benchmark")
def k8(t):
    return t.benchmark.select("item_id", F.substring("text", 1, 80).alias("query"), F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 16).alias("user_hash"))


@query("k9_upsert_steps", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'done' ELSE o_orderpriority END AS status FROM orders")
def k9(t):
    steps = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("status"))
    return D.upsert(steps, t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("done").alias("status")), "o_orderkey")


@query("k11_insert_absent", "WITH old AS (SELECT DISTINCT sha256(text) AS patch_hash, text AS patch FROM documents WHERE doc_id % 3 = 0), new AS (SELECT DISTINCT sha256(text) AS patch_hash, text AS patch FROM documents WHERE trim(text) <> '') SELECT patch_hash FROM old UNION ALL SELECT patch_hash FROM new WHERE patch_hash NOT IN (SELECT patch_hash FROM old)")
def k11(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("patch_hash"), F.col("text").alias("patch"))
    old, new = rows.where("doc_id % 3 = 0").select("patch_hash", "patch").distinct(), rows.select("patch_hash", "patch")
    return D.insert_absent(old, new, "patch_hash", "patch").select("patch_hash")


@query("k13_wipe", "SELECT lang, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY lang")
def k13(t):
    return D.delete_where(t.documents, F.col("source") == "src1")[0].groupBy("lang").agg(F.count("*").alias("n"))


@query("k14_cache", "SELECT 'ret:' || item_id AS key, item_id * 10 AS expires_at FROM benchmark WHERE item_id * 10 > 100 AND NOT starts_with('ret:' || item_id, 'ret:2')")
def k14(t):
    state = t.benchmark.select(F.concat(F.lit("ret:"), F.col("item_id").cast("string")).alias("key"), (F.col("item_id") * 10).alias("expires_at"))
    return D.invalidate(D.live(state, F.lit(100)), "ret:2")


@query("j1_left_nested", "SELECT o_orderkey, count(l_linenumber) AS steps, coalesce(string_agg(l_linenumber || ':' || l_linestatus, '|' ORDER BY l_linenumber, l_linestatus), '') AS detail FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N' GROUP BY o_orderkey")
def j1(t):
    j = t.orders.join(t.lineitem.where("l_returnflag <> 'N'"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    detail = F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber").isNotNull(), F.struct("l_linenumber", "l_linestatus")))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_linestatus"]))
    return j.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("steps"), F.array_join(detail, "|").alias("detail"))


@query("j4_sync", f"WITH {_V1}, {_V2} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'obsolete' WHEN a.checksum = b.checksum THEN 'unchanged' ELSE 'upsert' END AS action FROM v1 a FULL JOIN v2 b ON a.doc_id = b.doc_id")
def j4(t):
    return D.sync(v2(t), v1(t), "doc_id", "checksum")


@query("j5_skip", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("j6_deleted", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0 AND source < 'src3')")
def j6(t):
    on_disk = t.documents.where("doc_id % 2 = 0 and source < 'src3'").select("source")
    return t.documents.select("source").distinct().join(on_disk, "source", "left_anti")


@query("j8_resolve", "SELECT n_nationkey, r_name FROM nation JOIN region ON lower(r_name) = lower(['Africa','AMERICA','asia','EuRoPe','Middle East'][n_regionkey + 1])")
def j8(t):
    names = F.array(*[F.lit(x) for x in ("Africa", "AMERICA", "asia", "EuRoPe", "Middle East")])
    n = t.nation.withColumn("k", F.lower(F.get(names, F.col("n_regionkey"))))
    return n.join(t.region.withColumn("k", F.lower("r_name")), "k").select("n_nationkey", "r_name")


def _pairs(th):
    return f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE score >= {th} ORDER BY score DESC, a, b LIMIT 50"


@query("j9_clones", _pairs(0.4))
def j9(t):
    return D.clones(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.4)


@query("j9_clones_strict", _pairs(0.95))
def j9_strict(t):
    return D.clones(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.95)


@query("j11_orphans", "SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01')")
def j11(t):
    old = t.orders.where("o_orderstatus = 'F' and o_orderdate < timestamp '1995-01-01'").select(F.col("o_custkey").alias("user_id"))
    return t.events.select("user_id").distinct().join(old, "user_id", "left_semi")


@query("j12_stale", "SELECT e.event_id FROM events e LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') o ON o_custkey = user_id WHERE e.ts < TIMESTAMP '2024-01-10' OR o_custkey IS NULL")
def j12(t):
    active = t.orders.where("o_orderstatus = 'O'").select("o_custkey").distinct()
    return t.events.join(active, F.col("o_custkey") == F.col("user_id"), "left").where("ts < timestamp '2024-01-10' or o_custkey is null").select("event_id")


@query("s5_changed_files", "WITH p AS (SELECT doc_id AS pos, './src//' || source || ['.py','.md'][doc_id % 2 + 1] AS raw FROM documents), c AS (SELECT replace(substr(raw, 3), '//', '/') AS path, min(pos) AS pos FROM p GROUP BY 1) SELECT path, pos AS first_at, ends_with(path, '.py') AND path <> 'src/src1.py' AS accepted FROM c")
def s5(t):
    raw = F.concat(F.lit("./src//"), "source", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".md"))
    listing = t.documents.where("source <> 'src1'").select(F.concat(F.lit("src/"), "source", F.lit(".py")).alias("path"))
    return D.normalise_paths(t.documents.select(raw.alias("path"), F.col("doc_id").alias("at")), listing, [".py", ".ts"], ["node_modules"]).withColumnRenamed("at", "first_at")


@query("s6_paths", "SELECT DISTINCT source, lang FROM documents")
def s6(t):
    return t.documents.select("source", "lang").distinct()


@query("s7_by_path", "SELECT doc_id, sha256(text) AS checksum FROM documents WHERE source = 'src4'")
def s7(t):
    return t.documents.where("source = 'src4'").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("p1_code_filter", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS kind FROM documents) WHERE kind NOT IN ('de', 'fr') OR kind IS NULL")
def p1(t):
    kind = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("kind"))
    return kind.where(F.coalesce(~F.col("kind").isin("de", "fr"), F.lit(True))).select("doc_id")


@query("p5_conjunction", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0' AND n_chars > 1000")
def p5(t):
    return t.documents.where("lang = 'en' and source = 'src0' and n_chars > 1000").select("doc_id")


@query("p11_log_filter", "SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('error', 'purchase') AND contains(props, '3')) WHERE rn <= 50")
def p11(t):
    severity = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
    from pyspark.sql.window import Window

    from quern.functions.text import lookup

    top = t.events.where((lookup(F.col("event_type"), severity, 0) >= 3) & F.contains("props", F.lit("3"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).cast("long").alias("rn"))


@query("p13_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'active' ELSE 'planned' END AS status FROM orders WHERE o_orderstatus <> 'O'")
def p13(t):
    raw = F.when(F.col("o_orderstatus") == "F", " Finished").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("todo")
    return t.orders.select("o_orderkey", D.status(raw).alias("status")).where("status <> 'active'")


@query("p14_paths", "SELECT page_id, starts_with(p, '/work/a/') AS under_root, contains(p, 'test_') OR contains(p, '.spec.') AS is_test FROM (SELECT page_id, ['/work/a/x.py','/work/b/test_y.py','/work/a/z.spec.ts'][page_id % 3 + 1] AS p FROM pages)")
def p14(t):
    paths = F.array(*[F.lit(x) for x in ("/work/a/x.py", "/work/b/test_y.py", "/work/a/z.spec.ts")])
    p = F.get(paths, (F.col("page_id") % 3).cast("int"))
    return t.pages.select("page_id", p.startswith("/work/a/").alias("under_root"), p.rlike(r"(^|/)test_|\.spec\.|\.test\.").alias("is_test"))


@query("u1_sets", "SELECT 'difference' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersection', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def u1(t):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("difference", a.subtract(b)).union(n("union", a.union(b).distinct())).union(n("intersection", a.intersect(b)))


@query("u4_ordered_distinct", "SELECT doc_id, array_to_string((list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')[1:8])).list_sort(), ' ') AS first_terms FROM documents")
def u4(t):
    from quern.functions.text import tokens

    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.slice(tokens(F.col("text")), 1, 8))), " ").alias("first_terms"))


@query("h6_read_through", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'cached' ELSE substr(sha256(item_id::VARCHAR), 1, 8) END AS value, item_id % 2 = 0 AS cached FROM benchmark")
def h6(t):
    cache = t.benchmark.where("item_id % 2 = 0").select("item_id", F.lit("cached").alias("value"))
    return D.read_through(t.benchmark.select("item_id"), cache, "item_id", F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 8))


@query("h9_collection_name", "SELECT page_id, lower(replace(split_part(p, '/', 4), ' ', '_')) AS collection FROM (SELECT page_id, '/srv/my/Project ' || page_id % 5 AS p FROM pages)")
def h9(t):
    path = F.concat(F.lit("/srv/my/Project "), (F.col("page_id") % 5).cast("string"))
    return t.pages.select("page_id", collection_name(path).alias("collection"))


@query("h34_hit_key", "SELECT doc_id, sha256(source || ':' || doc_id || ':' || n_chars) AS hit_key FROM documents")
def h34(t):
    return t.documents.select("doc_id", hit_key(F.col("source"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("hit_key"))
