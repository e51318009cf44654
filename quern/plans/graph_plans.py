"""Graph queries: the star schema as a graph (customer -> nation -> region, supplier -> nation, supplier - part)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.operators import graph as G
from quern.plans.registry import query


TYPES = ["CALLS", "DEPENDS_ON", "OWNS", "USES_CONFIG", "RELATES_TO_RULE", "IMPLEMENTS", "READS_ENTITY"]


def tag(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(t):
    """region > nation > supplier > part, customer > nation > region; the type of a supply follows its line number, so that
    every walk meets types that it must not follow."""
    e = lambda df, s, rel, d: df.select(s.alias("src"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), d.alias("dst"))
    own = e(t.nation, tag("r", "n_regionkey"), "CONTAINS", tag("n", "n_nationkey")).union(e(t.nation, tag("n", "n_nationkey"), "AFFECTS_MODULE", tag("r", "n_regionkey")))
    own = own.union(e(t.customer, tag("c", "c_custkey"), "DEPENDS_ON", tag("n", "c_nationkey"))).union(e(t.supplier, tag("n", "s_nationkey"), "OWNS", tag("s", "s_suppkey")))
    rel = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return own.union(e(t.lineitem, tag("s", "l_suppkey"), rel, tag("p", "l_partkey")))


E = f"""e AS (SELECT 'r' || n_regionkey AS src, 'CONTAINS' AS rel, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || n_nationkey, 'AFFECTS_MODULE', 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'DEPENDS_ON', 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 'OWNS', 's' || s_suppkey FROM supplier
UNION ALL SELECT 's' || l_suppkey, {TYPES}[l_linenumber % 7 + 1], 'p' || l_partkey FROM lineitem)"""


def among(types):
    return "rel IN (" + ", ".join(f"'{x}'" for x in types) + ")"


def walk_sql(seeds, types, hops, reverse=False, name="w"):
    """``name``: (seed, node, distance) from seeds (seed, node)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    parts = [f"{name}0 AS ({seeds})", f"{name}e AS (SELECT DISTINCT src, dst FROM e WHERE {among(types)})"]
    for d in range(1, hops + 1):
        parts.append(f"{name}{d} AS (SELECT DISTINCT seed, {b} AS node FROM {name}{d - 1} JOIN {name}e ON {a} = node)")
    parts.append(f"{name} AS (SELECT seed, node, min(d)::INT AS distance FROM (" + " UNION ALL ".join(f"SELECT seed, node, {d} AS d FROM {name}{d}" for d in range(1, hops + 1)) + ") GROUP BY seed, node)")
    return ", ".join(parts)


def near_sql(table, limit):
    return f"(SELECT seed, node, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS rn FROM {table}) WHERE rn <= {limit})"


def places(t):
    """All regions, nations, suppliers and customers, each the seed of a walk."""
    out = t.region.select(tag("r", "r_regionkey").alias("seed")).union(t.nation.select(tag("n", "n_nationkey")))
    return out.union(t.supplier.select(tag("s", "s_suppkey"))).union(t.customer.select(tag("c", "c_custkey")))


_PLACES = "SELECT x AS seed, x AS node FROM (SELECT 'r' || r_regionkey AS x FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer)"


@query("g1_expand", f"WITH {E}, {walk_sql(_PLACES, fixed.EXPAND_TYPES, 3)}, o AS (SELECT * FROM w WHERE node <> seed) SELECT seed, node, distance FROM {near_sql('o', 15)} UNION ALL SELECT seed, node, 0 FROM w0")
def g1(t):
    return G.expand(places(t), edges(t))


@query("g3_centrality", f"WITH {E}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node, degree, round(degree / (SELECT max(degree) FROM d), 6) AS centrality FROM d WHERE node LIKE 'n%' OR node LIKE 'r%'")
def g3(t):
    return G.degree(edges(t)).where("node like 'n%' or node like 'r%'")


@query("g4_pagerank_sim", f"WITH {E}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node, degree, round(degree / (SELECT max(degree) FROM d), 6) AS centrality FROM d")
def g4(t):
    return G.degree(edges(t))


@query("g4_pagerank")
def g4_pagerank(t):
    """True PageRank of the graph; a test holds it against a plain power iteration."""
    ranks, _ = G.pagerank(edges(t), tolerance=1e-4)
    return ranks.select("node", F.round("rank", 6).alias("rank"))


@query("g5_communities", f"WITH {E}, b AS (SELECT DISTINCT node, other FROM (SELECT src AS node, dst AS other FROM e WHERE {among(fixed.COMMUNITY_TYPES)} UNION ALL SELECT dst, src FROM e WHERE {among(fixed.COMMUNITY_TYPES)}) WHERE node <> other) SELECT node, count(*) AS size FROM b GROUP BY node HAVING count(*) > 1 ORDER BY size DESC, node LIMIT 10")
def g5(t):
    return G.communities(edges(t))


@query("g6_skeleton", "SELECT r_name AS module, n_name AS class, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS functions FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def g6(t):
    j = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    g = j.groupBy(F.col("r_name").alias("module"), F.col("n_name").alias("class")).agg(F.array_sort(F.collect_set("s_name")).alias("f"))
    return g.select("module", "class", F.when(F.size("f") > 0, F.array_join("f", "|")).alias("functions"))


@query("g7_repomap", """SELECT r_name AS module, count(DISTINCT n_nationkey) AS n_dependencies, array_to_string(list_sort(list_distinct(list(n_name) FILTER (ends_with(n_name, '0'))))::VARCHAR[], '|') AS entry_points, array_to_string(list_sort(list_distinct(list(n_name)))[1:5], '|') AS public_functions FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def g7(t):
    j = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("module"))
    g = j.agg(F.countDistinct("n_nationkey").alias("n_dependencies"), F.array_sort(F.collect_set("n_name")).alias("names"))
    ends = F.filter("names", lambda x: x.endswith("0"))
    return g.select("module", "n_dependencies", F.when(F.size(ends) > 0, F.array_join(ends, "|")).alias("entry_points"), F.array_join(F.slice("names", 1, 5), "|").alias("public_functions"))


@query("g8_edge_weights", "SELECT n.n_name AS src, l_returnflag AS rel, l_linestatus AS dst, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation n ON n_nationkey = s_nationkey GROUP BY ALL ORDER BY n DESC, src, rel, dst LIMIT 20")
def g8(t):
    j = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return G.edge_weights(j.select(F.col("n_name").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_linestatus").alias("dst")))


@query("g9_render", "SELECT r_name AS module, r_name || ': ' || string_agg(n_name, ', ' ORDER BY n_name) AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def g9(t):
    g = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("module")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return g.select("module", F.concat("module", F.lit(": "), F.array_join("names", ", ")).alias("line"))


def traced(t):
    """All regions, nations and parts."""
    return t.region.select(tag("r", "r_regionkey").alias("seed")).union(t.nation.select(tag("n", "n_nationkey"))).union(t.part.select(tag("p", "p_partkey")))


_TRACED = "SELECT x AS seed, x AS node FROM (SELECT 'r' || r_regionkey AS x FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'p' || p_partkey FROM part)"


@query("g10_callers", f"WITH {E}, {walk_sql(_TRACED, fixed.CALLER_TYPES, 3, True)} SELECT * FROM {near_sql('w', 50)}")
def g10(t):
    return G.callers(traced(t), edges(t))


@query("g11_deps", f"WITH {E}, {walk_sql(_PLACES, fixed.DEPENDENCY_TYPES, 2)} SELECT * FROM {near_sql('w', 30)}")
def g11(t):
    return G.dependencies(places(t), edges(t))


def part_nodes(t):
    """Parts are functions of files named by brand; each brand is a module as well."""
    f = t.part.select(tag("p", "p_partkey").alias("name"), F.lit("Function").alias("label"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("kind"))
    return f.union(t.part.select("p_brand", F.lit("Module"), F.lit(None).cast("string"), F.lit("module")).distinct())


def brands(t):
    return t.part.select(F.col("p_brand").alias("path")).distinct()


_ENT = "ent AS (SELECT p_brand AS seed, 'p' || p_partkey AS node, 'Function' AS label, p_type AS kind FROM part UNION ALL SELECT DISTINCT p_brand, p_brand, 'Module', 'module' FROM part)"


@query("g12_entities", f"WITH {_ENT} SELECT * FROM ent")
def g12(t):
    return G.entities(part_nodes(t), brands(t))


_NSEED = "SELECT 'n' || n_nationkey AS seed, 'n' || n_nationkey AS node FROM nation"


def impact_sql(seeds):
    return f"{E}, {walk_sql(seeds, fixed.CALLER_TYPES, 3, True, 'u')}, {walk_sql(seeds, fixed.DEPENDENCY_TYPES, 2, False, 'v')}, up AS {near_sql('u', 50)}, down AS {near_sql('v', 30)}, sc AS (SELECT seed, round(sum(x), 2) AS score FROM (SELECT seed, 1.0::DOUBLE / distance AS x FROM up UNION ALL SELECT seed, 0.2::DOUBLE / distance FROM down) GROUP BY seed)"


_RISK = "CASE WHEN score > 10 THEN 'high' WHEN score > 3 THEN 'medium' ELSE 'low' END"


def nation_impact(t):
    seeds = t.nation.select(tag("n", "n_nationkey").alias("seed"))
    return G.impact(G.callers(seeds, edges(t)), G.dependencies(seeds, edges(t)))


@query("g13_impact", f"WITH {impact_sql(_NSEED)} SELECT seed, score, {_RISK} AS risk FROM sc")
def g13(t):
    return nation_impact(t)


@query("g14_report", f"WITH {_ENT}, {impact_sql('SELECT DISTINCT seed, node FROM ent')}, s AS (SELECT DISTINCT seed FROM ent) SELECT seed, (SELECT count(*) FROM ent WHERE ent.seed = s.seed) AS n_entities, (SELECT count(*) FROM up WHERE up.seed = s.seed) AS n_callers, (SELECT count(*) FROM down WHERE down.seed = s.seed) AS n_dependencies, coalesce(score, 0.0::DOUBLE) AS score, coalesce({_RISK}, 'low') AS risk, '' AS affected FROM s LEFT JOIN sc USING (seed)")
def g14(t):
    """Callers of parts are suppliers, nations and regions, which stand in no file."""
    return G.change_report(brands(t), part_nodes(t), edges(t))


@query("g14_affected", f"WITH {E}, f AS (SELECT 's' || s_suppkey AS name, 'file' || s_nationkey AS path FROM supplier UNION ALL SELECT 'p' || p_partkey, p_brand FROM part), q AS (SELECT path AS seed, name AS node FROM f), {walk_sql('SELECT * FROM q', fixed.CALLER_TYPES, 3, True, 'u')}, up AS {near_sql('u', 50)} SELECT seed, coalesce((SELECT string_agg(DISTINCT f.path, '|' ORDER BY f.path) FROM up JOIN f ON f.name = up.node WHERE up.seed = q2.seed), '') AS affected FROM (SELECT DISTINCT seed FROM q) q2")
def g14_affected(t):
    nodes = t.supplier.select(tag("s", "s_suppkey").alias("name"), F.lit("Class").alias("label"), tag("file", "s_nationkey").alias("file_path"), F.lit("class").alias("kind")).union(part_nodes(t).where("label = 'Function'"))
    return G.change_report(nodes.select(F.col("file_path").alias("path")).distinct(), nodes, edges(t)).select("seed", "affected")


@query("g15_review", f"WITH {impact_sql(_NSEED)} SELECT seed, round(score / 10, 4) AS risk, round(score / 10, 4) > 0.7 AS needs_approval FROM sc")
def g15(t):
    r, a = G.review(F.col("score"))
    return nation_impact(t).select("seed", r.alias("risk"), a.alias("needs_approval"))


@query("g16_summary", "SELECT doc_id, concat_ws(' | ', 'File', source, CASE WHEN doc_id % 2 = 0 THEN lang END) AS summary FROM documents")
def g16(t):
    return t.documents.select("doc_id", G.summary(F.lit("File"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("summary"))


@query("g17_labels", f"WITH {E} SELECT rel, count(*) AS n, count(*) FILTER (rel <> 'KNOWS') AS known FROM (SELECT rel FROM e UNION ALL SELECT 'KNOWS' FROM region) GROUP BY rel")
def g17(t):
    more = edges(t).select("rel").union(t.region.select(F.lit("KNOWS")))
    checked = G.check_labels(more.withColumn("src_label", F.lit("Class")).withColumn("dst_label", F.lit("Function")))
    return checked.groupBy("rel").agg(F.count("*").alias("n"), F.count_if("ok").alias("known"))


_CHUNKS = """SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'function' ELSE 'class' END AS chunk_type, p_brand AS file_path, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS parent, p_type AS imp, CASE WHEN p_size > 25 THEN p_type END AS cal, p_size FROM part"""


def part_chunks(t):
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("class")
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "create").when(F.col("p_size") % 3 == 1, "find").otherwise(""), F.col("p_partkey").cast("string"))
    return t.part.select(kind.alias("chunk_type"), name.alias("name"), F.col("p_brand").alias("file_path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("parent_class"), one(F.col("p_type")).alias("imports"), one(F.when(F.col("p_size") > 25, F.col("p_type"))).alias("calls"), one(F.lit(None).cast("string")).alias("bases"), one(F.lit(None).cast("string")).alias("config_keys"), one(F.lit(None).cast("string")).alias("endpoints"), (F.col("p_size") == 1).alias("is_dto"), (F.col("p_size") == 2).alias("is_migration"), (F.col("p_size") == 3).alias("is_ui_component"), (F.col("p_size") == 4).alias("is_business_rule"), (F.col("p_size") >= 40).alias("is_entity"))


@query("t17_relations", """WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Function' ELSE 'Class' END AS label, CASE p_size % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'find' ELSE '' END || p_partkey AS name, p_brand, p_type, p_size, p_partkey FROM part), r AS (
SELECT 'Module' AS src_label, p_brand AS src, 'CONTAINS' AS rel, label AS dst_label, name AS dst FROM p UNION ALL SELECT 'Class', p_brand, 'OWNS', 'Function', name FROM p WHERE p_partkey % 3 = 0 UNION ALL SELECT 'Module', p_brand, 'DEPENDS_ON', 'Import', p_type FROM p UNION ALL SELECT label, name, 'CALLS', 'Function', p_type FROM p WHERE p_size > 25
UNION ALL SELECT label, name, 'OWNS', 'DTO', name FROM p WHERE p_size = 1 UNION ALL SELECT label, name, 'OWNS', 'Migration', name FROM p WHERE p_size = 2 UNION ALL SELECT label, name, 'OWNS', 'UIComponent', name FROM p WHERE p_size = 3 UNION ALL SELECT label, name, 'RELATES_TO_RULE', 'BusinessRule', name FROM p WHERE p_size = 4 UNION ALL SELECT label, name, 'OWNS', 'Entity', name FROM p WHERE p_size >= 40
UNION ALL SELECT label, name, CASE p_size % 3 WHEN 0 THEN 'MUTATES_ENTITY' ELSE 'READS_ENTITY' END, 'Entity', name FROM p WHERE p_size >= 40 AND p_size % 3 < 2) SELECT DISTINCT * FROM r""")
def t17(t):
    return G.relations(part_chunks(t))


@query("k6_merge_edges", "SELECT src, rel, dst, max_by(props, v) AS props FROM (SELECT 'c' || c_custkey AS src, 'OWNS' AS rel, 'n' || c_nationkey AS dst, 'old' AS props, 0 AS v FROM customer UNION ALL SELECT 'c' || c_custkey, 'OWNS', 'n' || c_nationkey, c_mktsegment, 1 FROM customer WHERE c_custkey % 2 = 0) GROUP BY ALL HAVING true")
def k6(t):
    key = [F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.lit("OWNS").alias("rel"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst")]
    old = t.customer.select(*key, F.lit("old").alias("props"))
    new = t.customer.where("c_custkey % 2 = 0").select(*key, F.col("c_mktsegment").alias("props")).union(t.customer.select(key[0], F.lit("KNOWS"), key[2], F.lit("x")))
    return G.merge_edges(old, new)
