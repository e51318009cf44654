"""Memory, code and task queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import dml as D
from quern.operators import memory as M
from quern.plans import stored
from quern.plans.registry import query
from quern.plans.retrieval_plans import MIXED, dense_sql, fuse_sql, item_queries, mixed_queries, sparse_sql, vectors
from quern.session import shared_dir
from quern.sources import tables as S
from quern.sources import trees

_MEM = """m AS (SELECT conv_id, turn, role, text AS content, ['general','architecture_decision','semantic','odd'][turn % 4 + 1] AS memory_type, CASE WHEN turn % 3 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN conv_id % 2 = 0 THEN conv_id + turn END AS valid_to FROM conversations),
l AS (SELECT *, CASE memory_type WHEN 'architecture_decision' THEN 'decision' WHEN 'semantic' THEN 'semantic' ELSE 'episodic' END AS layer FROM m)"""


def memories(t):
    kinds = F.array(*[F.lit(x) for x in ("general", "architecture_decision", "semantic", "odd")])
    m = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("content"), F.get(kinds, (F.col("turn") % 4).cast("int")).alias("memory_type"), F.when(F.col("turn") % 3 == 0, "archived").otherwise("active").alias("status"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") + F.col("turn")).alias("valid_to"))
    return m.withColumn("layer", M.layer(F.col("memory_type")))


@query("h5_entry", f"WITH {_MEM} SELECT conv_id, turn, substr(sha256(role || ':' || substr(content, 1, 200)), 1, 16) AS entry_id, layer FROM l")
def h5(t):
    return memories(t).select("conv_id", "turn", M.entry_id(F.col("role"), F.col("content")).alias("entry_id"), "layer")


@query("h1_store", "SELECT conv_id, turn, conv_id * 86400 + 7 * 86400 AS valid_to, 'semantic' AS layer FROM conversations WHERE role = 'user'")
def h1(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 86400 + 7 * 86400).alias("valid_to"), F.lit("semantic").alias("layer"))


KINDS = ["architectural_decision", "code_patch", "general", "semantic"]


def notes(t):
    """Documents as memories: a kind by number, every fifth archived, some past their end."""
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    m = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("name"), F.col("lang").alias("collection"), kind.alias("memory_type"), F.when(F.col("doc_id") % 5 == 0, "archived").otherwise("active").alias("status"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("valid_to"), F.when(F.col("doc_id") % 8 == 1, "agent-LOCAL").otherwise("").alias("provenance"))
    return m.withColumn("layer", M.layer(F.col("memory_type")))


@query("r14_memory", f"WITH {sparse_sql(5, 'id % 4 = 0 AND id % 5 <> 0')} SELECT query_id, id, score, rn FROM sparse")
def r14(t):
    """Decisions: the kind names a layer, which restricts the search."""
    return M.search(item_queries(t), notes(t), kind="architectural_decision")


@query("r14_semantic", f"WITH {sparse_sql(5, 'id % 4 = 3')} SELECT query_id, id, score, rn FROM sparse")
def r14_semantic(t):
    """The semantic layer, archived entries included."""
    return M.search(item_queries(t), notes(t), layer_="semantic", include_invalid=True)


@query("r14_hybrid", f"WITH {dense_sql(20, 'e.vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 5 <> 0)', MIXED)}, {sparse_sql(20, 'id % 4 = 0 AND id % 5 <> 0')}, {fuse_sql(5)} SELECT query_id, id, score, rn FROM fused")
def r14_hybrid(t):
    return M.search(mixed_queries(t), notes(t), layer_="decision", vectors=vectors(t).select("id", "vec"))


@query("r14_valid", f"WITH {_MEM} SELECT conv_id, turn, substr(content, 1, 600) AS content FROM l WHERE status = 'active' AND (valid_to IS NULL OR valid_to >= 40) AND layer IN ('decision', 'episodic')")
def r14_valid(t):
    return M.recall(memories(t), F.lit(40), ["decision", "episodic"]).select("conv_id", "turn", F.substring("content", 1, 600).alias("content"))


@query("r15_patches", f"WITH {sparse_sql(3, 'id % 4 = 1 AND id % 5 <> 0')} SELECT query_id, rn, '' AS task_id, d.source AS goal, 'unknown' AS task_type, 'python' AS language, sha256(d.text) AS digest, CASE WHEN id % 8 = 1 THEN 'LOCAL' ELSE 'TIER_CHEAP' END AS tier FROM sparse JOIN documents d ON d.doc_id = id")
def r15(t):
    return M.patches(item_queries(t), notes(t)).select("query_id", "rn", "task_id", "goal", "task_type", "language", F.sha2("patch", 256).alias("digest"), "tier")


_COMPACT = sparse_sql(20, "id % 5 <> 0") + ", f AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM sparse), g AS (SELECT f.*, d.text FROM f JOIN documents d ON d.doc_id = id WHERE n >= 2 AND rn <= 5)"


@query("x8_compact", f"WITH {_COMPACT}, c AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rn) AS content, count(*) AS merged FROM g GROUP BY query_id) SELECT query_id, 'Compacted Memory: ' || b.text AS title, sha256(content) AS digest, 'semantic' AS layer, merged FROM c JOIN benchmark b ON b.item_id = query_id")
def x8(t):
    new, _ = M.compact(item_queries(t), notes(t))
    return new.select("query_id", "title", F.sha2("content", 256).alias("digest"), "layer", "merged")


@query("x8_archived", f"WITH {_COMPACT} SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 OR doc_id IN (SELECT id FROM g) THEN 'archived' ELSE 'active' END AS status FROM documents")
def x8_archived(t):
    return M.compact(item_queries(t), notes(t))[1].select("id", "status")


_CYCLE = sparse_sql(20, "id % 5 <> 0 AND NOT (id % 3 = 0 AND id < 400)") + ", f AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM sparse), g AS (SELECT * FROM f WHERE n >= 2 AND rn <= 5)"


@query("h4_cycle", f"WITH {_CYCLE} SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 OR doc_id IN (SELECT id FROM g) THEN 'archived' WHEN doc_id % 3 = 0 AND doc_id < 400 THEN 'expired' ELSE 'active' END AS status FROM documents")
def h4(t):
    """Upkeep: what is past its end expires and is compacted no more."""
    return M.cycle(notes(t), item_queries(t), F.lit(400))[1].select("id", "status")


@query("x9_facts", r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(t, chr(10))) AS line, (generate_subscripts(string_split(t, chr(10)), 1) - 1)::INT AS at_ FROM (SELECT doc_id, '- ' || replace(text, '. ', chr(10) || '2) ') AS t FROM documents)),
f AS (SELECT id, at_, trim(regexp_replace(line, '^\s*(?:[-*•]|\d+[.)])\s+', '')) AS fact FROM l) SELECT id, at_ AS "at", fact FROM f WHERE fact <> ''""")
def x9(t):
    d = t.documents.select("doc_id", F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit("\n2) "))).alias("c"))
    return M.facts(d, "doc_id", "c")


@query("x10_prune", f"WITH {_MEM} SELECT conv_id, turn, CASE WHEN status = 'active' AND valid_to < 40 THEN 'expired' ELSE status END AS status FROM l")
def x10(t):
    return M.prune(memories(t), F.lit(40)).select("conv_id", "turn", "status")


#: Lines of an order may share a number.
STEP = "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey"
_LAST, _VERIFIER, _REVIEWER, _EDITOR = len(fixed.TASK_NODES) - 1, *map(fixed.TASK_NODES.index, ("verifier", "reviewer", "editor"))
#: The task machine step by step.
TASKS_SQL = f"""WITH RECURSIVE e AS (SELECT l_orderkey AS task_id, l_returnflag <> 'R' AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {STEP}) AS no FROM lineitem),
r AS (SELECT DISTINCT task_id, 0::BIGINT AS no, 0 AS node, 'PLANNING' AS status, 0 AS reflections FROM e
UNION ALL SELECT e.task_id, e.no,
  CASE WHEN status IN ('DONE', 'FAILED') THEN node WHEN status = 'WAITING_APPROVAL' THEN CASE WHEN ok THEN {_LAST} ELSE node END WHEN ok THEN least(node + 1, {_LAST}) WHEN node = {_VERIFIER} AND reflections < 3 THEN {_EDITOR} ELSE node END,
  CASE WHEN status IN ('DONE', 'FAILED') THEN status WHEN status = 'WAITING_APPROVAL' THEN CASE WHEN ok THEN 'EXECUTING' ELSE 'FAILED' END WHEN ok THEN CASE WHEN node = {_LAST} THEN 'DONE' ELSE 'EXECUTING' END
    WHEN node = {_VERIFIER} THEN CASE WHEN reflections >= 3 THEN 'FAILED' ELSE 'EXECUTING' END WHEN node = {_REVIEWER} THEN 'WAITING_APPROVAL' ELSE 'FAILED' END,
  reflections + CASE WHEN status NOT IN ('DONE', 'FAILED', 'WAITING_APPROVAL') AND NOT ok AND node = {_VERIFIER} THEN 1 ELSE 0 END
FROM r JOIN e ON e.task_id = r.task_id AND e.no = r.no + 1)
SELECT task_id, {fixed.TASK_NODES}[arg_max(node, no) + 1] AS node, arg_max(status, no) AS status, arg_max(reflections, no)::INT AS reflections FROM r GROUP BY task_id"""


def order_steps(t):
    """Every order is a task, its lines the results of steps."""
    return t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.expr(STEP).alias("step"), (F.col("l_returnflag") != "R").alias("ok"))


@query("x13_states", TASKS_SQL)
def x13(t):
    return M.task_states(order_steps(t))


#: A command, its folder and the verdict.
COMMANDS = [
    ("python3 -m pytest tests", "/srv/app", "ok"), ("/usr/bin/node x.js", "/srv/app", "ok"), ("node --hard x.js", "/srv/app", "blocked argument"), ("python3 -c 'print(1'", "/srv/app", "bad syntax"),
    ("python3 -c 'print(1)'", "/srv/app", "ok"), ("bash -c ls", "/srv/app", "blocked shell flag"), ("bash run.sh", "/srv/.git/hooks", "blocked folder"), ("bash run.sh", None, "ok"), ("git status", "/srv/app", "unknown program"),
    ("dd IF=/dev/zero", "/srv/app", "dangerous part"), ("python3 'unclosed", "/srv/app", "bad syntax"), ("", "/srv/app", "empty"), ("/usr/local/bin/python4", "/srv/app", "unknown program"), ("sudo rm -rf /", "/srv/app", "dangerous part"), ("python3 x --force", "/srv/app", "blocked argument"),
]


@query("x15_commands", "SELECT event_id, [" + ", ".join(f"'{v}'" for *_, v in COMMANDS) + f"][event_id % {len(COMMANDS)} + 1] AS verdict FROM events")
def x15(t):
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in COMMANDS]), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    return t.events.select("event_id", M.command_verdict(pick(0), pick(1)).alias("verdict"))


def project_files(t):
    names = F.array(*[F.lit(x) for x in ("src/main.py", "pyproject.toml", "web/package.json", "a.sln", "Dockerfile", "lib/x.py", "app/angular.json")])
    # an empty document is a file without a path; as in SQL, places below 1 count from the end and there is none at 0 (not by
    # element_at, which is the last name for a null place with Spark 4.1.2)
    at = F.try_mod("doc_id", "n_chars") % 7
    return t.documents.select(F.col("source").alias("project"), F.get(names, F.when(at < -1, at + 8).otherwise(at).cast("int")).alias("path"))


_FILES = "p AS (SELECT source AS project, ['src/main.py','pyproject.toml','web/package.json','a.sln','Dockerfile','lib/x.py','app/angular.json'][doc_id % n_chars % 7 + 1] AS path FROM documents)"


@query("x6_profile", f"""WITH {_FILES}, f AS (SELECT project, path, CASE path WHEN 'pyproject.toml' THEN 'Python' WHEN 'web/package.json' THEN 'Node.js' WHEN 'a.sln' THEN '.NET' WHEN 'Dockerfile' THEN 'Docker' WHEN 'app/angular.json' THEN 'Angular' END AS fw, CASE path WHEN 'pyproject.toml' THEN 'pip' WHEN 'web/package.json' THEN 'npm' WHEN 'a.sln' THEN 'nuget' END AS pm FROM p)
SELECT project, coalesce(string_agg(DISTINCT fw, '|' ORDER BY fw), '') AS frameworks, coalesce(string_agg(DISTINCT pm, '|' ORDER BY pm), '') AS package_managers, coalesce(string_agg(DISTINCT CASE WHEN path = 'src/main.py' THEN 'main.py' END, '|'), '') AS entry_points, count(*) AS n_files FROM f GROUP BY project""")
def x6(t):
    return M.profile(project_files(t))


@query("x17_verification", f"WITH {_FILES} SELECT project, CASE WHEN bool_or(path = 'a.sln') THEN 'dotnet' WHEN bool_or(path = 'web/package.json') THEN 'node' WHEN bool_or(path = 'pyproject.toml') THEN 'python' ELSE 'none' END AS profile FROM p GROUP BY project")
def x17(t):
    return M.verification(project_files(t))


@query("s8_doc_paths", "SELECT DISTINCT source || '.md' AS path FROM documents WHERE doc_id % 5 = 0 AND lang IS NOT NULL")
def s8(t):
    d = t.documents.select(F.when(F.col("doc_id") % 5 == 0, "agent_doc").otherwise("code").alias("source_type"), F.when(F.col("lang").isNotNull(), F.concat("source", F.lit(".md"))).alias("relative_path"))
    return M.doc_paths(d)


_LISTING = """f AS (SELECT doc_id, ['', 'src/', 'bin/', 'web/.hidden/', 'a/migrations/', 'out/', '.agent/', '.agent/deep/', 'build/x/'][doc_id % 9 + 1] || ['a.py', 'b.ts', 'c.CS', 'README.md', 'rules.md', 'd.rb', 'e.java', 'noext', 'f.tsx.bak', 'g.cs'][doc_id % 10 + 1] AS path FROM documents)"""


def listing(t):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(pick(["", "src/", "bin/", "web/.hidden/", "a/migrations/", "out/", ".agent/", ".agent/deep/", "build/x/"]), pick(["a.py", "b.ts", "c.CS", "README.md", "rules.md", "d.rb", "e.java", "noext", "f.tsx.bak", "g.cs"])).alias("path"))


def tree(t):
    """The documents as files on disk, in folders of which some are left out by each scan."""
    rows = listing(t).join(t.documents.select("doc_id", "text"), "doc_id")
    return stored.once(t, "tree", "documents", lambda folder: trees.write_tree(rows.select(F.concat(F.lit("d"), "doc_id", F.lit("/"), "path").alias("path"), "text"), folder))


def scanned(t, purpose):
    t.spark.dataSource.register(trees.SourceTree)
    return t.spark.read.format("source_tree").option("purpose", purpose).load(tree(t)).select("path", F.char_length("text").alias("n"))


def tree_sql(where):
    return f"WITH {_LISTING} SELECT 'd' || doc_id || '/' || path AS path, length(coalesce(text, ''))::INT AS n FROM f JOIN documents USING (doc_id) WHERE {where}"


@query("s1_tree", tree_sql("doc_id % 9 NOT IN (2, 4) AND doc_id % 10 IN (0, 1, 9)"))
def s1_tree(t):
    return scanned(t, "index")


@query("s2_tree", tree_sql("doc_id % 9 NOT IN (2, 4) AND doc_id % 10 IN (0, 1, 6, 9)"))
def s2_tree(t):
    return scanned(t, "profile")


@query("s3_tree", tree_sql("doc_id % 9 IN (0, 1, 4) AND doc_id % 10 IN (0, 1, 2, 5, 6, 9)"))
def s3_tree(t):
    return scanned(t, "analysis")


@query("s1_source_files", f"WITH {_LISTING} SELECT doc_id, path FROM f WHERE doc_id % 9 NOT IN (2, 4) AND doc_id % 10 IN (0, 1, 9)")
def s1(t):
    return S.scan_files(listing(t), "index")


@query("s2_profile_files", f"WITH {_LISTING} SELECT doc_id, path FROM f WHERE doc_id % 9 NOT IN (2, 4) AND doc_id % 10 IN (0, 1, 6, 9)")
def s2(t):
    return S.scan_files(listing(t), "profile")


@query("s3_analysis_files", f"WITH {_LISTING} SELECT doc_id, path FROM f WHERE doc_id % 9 IN (0, 1, 4) AND doc_id % 10 IN (0, 1, 2, 5, 6, 9)")
def s3(t):
    return S.scan_files(listing(t), "analysis")


@query("s4_doc_files", f"WITH {_LISTING} SELECT doc_id, path FROM f WHERE doc_id % 9 IN (6, 7) AND doc_id % 10 = 4")
def s4(t):
    return S.doc_files(listing(t))


def _file(t, rows, name):
    """A small text table written below the shared folder; its path."""
    path = f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    S.write_text(rows, path)
    return path


@query("s11_cases", "SELECT text AS query, CASE WHEN item_id % 2 = 0 THEN 'f' || item_id ELSE '' END AS files, CASE item_id % 3 WHEN 0 THEN 'e' WHEN 1 THEN 's' ELSE '' END AS entities, item_id % 4 AS n_tags FROM benchmark")
def s11(t):
    """Cases under either name of the question, with files, entities or symbols or neither."""
    i = F.col("item_id")
    case = F.to_json(F.struct(F.when(i % 2 == 0, F.col("text")).alias("question"), F.when(i % 2 == 1, F.col("text")).alias("query"), F.when(i % 2 == 0, F.array(F.concat(F.lit("f"), i.cast("string")))).alias("expected_files"), F.when(i % 3 == 0, F.array(F.lit("e"))).alias("expected_entities"), F.when(i % 3 == 1, F.array(F.lit("s"))).alias("expected_symbols"), F.array_repeat(F.lit("t"), (i % 4).cast("int")).alias("tags")))
    c = S.parse_cases(t.benchmark.select(F.concat(F.lit("["), case, F.lit("]")).alias("j")), "j")
    return c.select("query", F.array_join("expected_files", ",").alias("files"), F.array_join("expected_entities", ",").alias("entities"), F.size("tags").cast("long").alias("n_tags"))


@query("s14_fixtures", "SELECT 'q' || item_id AS query, 'src/f' || item_id || '.py' AS files FROM benchmark")
def s14(t):
    """Cases written as lines of JSON and read again."""
    one = t.benchmark.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), F.array(F.concat(F.lit("src/f"), F.col("item_id").cast("string"), F.lit(".py"))).alias("expected_files"))
    path = _file(t, S.case_lines(one), "cases")
    return S.eval_cases(t.spark, path, lines=True).select("query", F.array_join("expected_files", ",").alias("files"))


_PROFILES = f"""{_FILES}, q AS (SELECT project, path, regexp_extract(path, '(\\.[^./]+)$', 1) AS ext FROM p), lang AS (SELECT project, string_agg(DISTINCT 'python', ', ') AS languages, count(*) AS n_source FROM q WHERE ext = '.py' GROUP BY 1),
roots AS (SELECT project, CASE WHEN path LIKE 'src/%' THEN 'src' ELSE split_part(path, '/', 1) END AS r, count(*) AS n FROM q WHERE ext = '.py' GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, r) AS k FROM roots WHERE n >= 2),
sel AS (SELECT project, list(r ORDER BY k) AS l FROM ranked WHERE k <= 12 GROUP BY 1), has AS (SELECT project, bool_or(path LIKE 'src/%') AS src FROM p GROUP BY 1),
mr AS (SELECT has.project, CASE WHEN src AND NOT list_contains(coalesce(l, []), 'src') THEN list_prepend('src', coalesce(l, [])) ELSE coalesce(l, []) END AS roots FROM has LEFT JOIN sel USING (project))"""


@query("x7_profile", f"WITH {_PROFILES} SELECT project AS project_name, coalesce(languages, '') AS languages, array_to_string(roots[1:12], ', ') AS module_roots, coalesce(n_source, 0) AS n_source FROM mr LEFT JOIN lang USING (project)")
def x7(t):
    p = M.project_profile(project_files(t))
    return p.select("project_name", F.array_join("languages", ", ").alias("languages"), F.array_join("module_roots", ", ").alias("module_roots"), "n_source")


@query("t16_summary_chunks", f"WITH {_PROFILES} SELECT project, 'repo_summary' AS chunk_type, project || ' Repository Summary' AS name, 'summary://' || project || '/repo_summary' AS file_path FROM mr UNION ALL SELECT project, 'project_profile', project || ' Project Profile', 'summary://' || project || '/project_profile' FROM mr UNION ALL SELECT project, 'module_summary', r || ' Module Summary', 'summary://' || project || '/module/' || r FROM (SELECT project, unnest(roots[1:12]) AS r FROM mr)")
def t16(t):
    return M.summary_chunks(M.project_profile(project_files(t))).select(F.col("collection").alias("project"), "chunk_type", "name", "file_path")


@query("s13_registry", f"WITH {_PROFILES} SELECT project AS collection, project AS project_name, len(roots[1:12])::INT AS n_roots FROM mr")
def s13(t):
    """The registry written as lines of JSON and read again."""
    path = _file(t, S.registry_lines(M.project_profile(project_files(t)).drop("n_source")), "registry")
    return S.registry(t.spark, path, lines=True).select("collection", "project_name", F.size("module_roots").alias("n_roots"))


@query("h8_foundation", f"WITH {_PROFILES}, c AS (SELECT project, 2 + len(roots[1:12]) AS n FROM mr) SELECT project, n::BIGINT AS n_chunks FROM c UNION ALL SELECT 'old', 1")
def h8(t):
    """Summaries of all projects brought into an index that holds older ones of some."""
    new = M.summary_chunks(M.project_profile(project_files(t)))
    kept = t.region.where("r_regionkey = 0").select(F.lit("x").alias("chunk_id"), F.lit("old").alias("collection"))
    old = new.where("collection like 'src1%'").select("chunk_id", "collection").union(kept)
    return D.upsert(old, new.select("chunk_id", "collection"), "chunk_id").groupBy(F.col("collection").alias("project")).agg(F.count("*").alias("n_chunks"))


@query("h10_repo_map", "SELECT n_name AS collection, CASE WHEN n_nationkey % 2 = 0 THEN 'stored ' || n_name ELSE 'built ' || n_name END AS map, n_nationkey % 2 = 0 AS cached FROM nation")
def h10(t):
    """Maps by collection and version; one of an older version is no hit."""
    key = lambda v: F.sha2(F.concat_ws(":", "n_name", v), 256)
    version = F.when(F.col("n_nationkey") % 2 == 0, "v2").otherwise("v1")
    cache = t.nation.select(key(version).alias("key"), F.concat(F.lit("stored "), "n_name").alias("value"))
    wanted = t.nation.select(key(F.lit("v2")).alias("key"), "n_name")
    got = D.read_through(wanted, cache, "key", F.concat(F.lit("built "), "n_name"))
    return got.join(wanted, "key").select(F.col("n_name").alias("collection"), F.col("value").alias("map"), "cached")


@query("t1_code_chunks", "SELECT 'm' || p_partkey || '.py' AS path, k.t AS chunk_type, k.n || CASE k.t WHEN 'class' THEN p_partkey::VARCHAR ELSE '' END AS name, k.a::INT AS start_line, k.z::INT AS end_line, CASE k.n WHEN 'run' THEN 'C' || p_partkey END AS parent_class FROM part, (VALUES ('class', 'C', 2, 4), ('function', 'run', 3, 4), ('function', 'helper', 6, 7)) k(t, n, a, z)")
def t1(t):
    body = F.concat(F.lit("import os\nclass C"), F.col("p_partkey").cast("string"), F.lit("(Base):\n    def run(self):\n        return os.getenv('X')\n\ndef helper(a):\n    return len(a)\n"))
    return M.code_chunks(t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))).select("path", "chunk_type", "name", "start_line", "end_line", "parent_class")


#: A module of each brace language with the part's number and size in it; {{n}} and {{s}} are replaced.
_BRACE_CODE = {
    "ts": "import { a } from './a';\nexport class K{n} extends Base<T{s}> implements I {\n  public run(x: number): string {\n    return `}${fmt(x)}{`;\n  }\n}\nexport const g{n} = (y) => {\n  other.call{s}(y);\n};\n",
    "cs": "using System;\nnamespace N {\n  public class K{n}<T> : Base<T>, I{s} where T : class {\n    string q = @\"}\\\";\n    public K{n}(int n) : base(n) { Init(); }\n    int Twice(int x) => Mul{s}(x);\n  }\n}\n",
}


@query("t1_brace_chunks", """SELECT 'm' || p_partkey || '.' || k.e AS path, k.kind AS chunk_type, replace(k.n, '#', p_partkey::VARCHAR) AS name, k.a::INT AS start_line, k.z::INT AS end_line, CASE WHEN k.o THEN 'K' || p_partkey END AS parent_class, replace(k.b, '#', p_size::VARCHAR) AS bases, replace(k.c, '#', p_size::VARCHAR) AS calls
FROM part, (VALUES ('ts', 'class', 'K#', 2, 6, false, 'Base<T#>|I', 'fmt'), ('ts', 'function', 'run', 3, 5, true, '', 'fmt'), ('ts', 'function', 'g#', 7, 9, false, '', 'other.call#'), ('cs', 'class', 'K#', 3, 7, false, 'Base<T>|I#', 'Init|Mul#'), ('cs', 'function', 'K#', 5, 5, true, '', 'Init'), ('cs', 'function', 'Twice', 6, 6, true, '', 'Mul#')) k(e, kind, n, a, z, o, b, c)""")
def t1_braces(t):
    """A TypeScript and a C# module of each part, with braces in strings, templates, generics and an expression body."""
    number, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    files = None
    for end, code in _BRACE_CODE.items():
        text = F.replace(F.replace(F.lit(code), F.lit("{n}"), number), F.lit("{s}"), size)
        rows = t.part.select(F.concat(F.lit("m"), number, F.lit(f".{end}")).alias("path"), text.alias("content"))
        files = rows if files is None else files.union(rows)
    return M.code_chunks(files).select("path", "chunk_type", "name", "start_line", "end_line", "parent_class", F.array_join("bases", "|").alias("bases"), F.array_join("calls", "|").alias("calls"))


@query("t2_imports", "SELECT 'm' || p_partkey || '.py' AS path, k.name, CASE k.name WHEN 'C' THEN 'class' ELSE 'function' END AS chunk_type, 'from m' || p_size || ' import x|import os' AS imports, CASE k.name WHEN 'helper' THEN '' ELSE 'helper|len' END AS calls, CASE k.name WHEN 'C' THEN 'Base' || p_size ELSE '' END AS bases, CASE k.name WHEN 'run' THEN 'C' END AS parent_class FROM part, (SELECT unnest(['C', 'run', 'helper']) AS name) k")
def t2(t):
    """Imports (each once), calls and bases of the chunks of a module a part."""
    size = F.col("p_size").cast("string")
    code = F.concat(F.lit("import os\nfrom m"), size, F.lit(" import x\nimport os\n\nclass C(Base"), size, F.lit("):\n    def run(self):\n        return helper(len(self.a)) + len([])\n\ndef helper(n):\n    return n\n"))
    c = M.code_chunks(t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content")))
    return c.select("path", "name", "chunk_type", *[F.array_join(x, "|").alias(x) for x in ("imports", "calls", "bases")], "parent_class")


@query("x4_untested", "WITH f AS (SELECT DISTINCT CASE WHEN p_partkey % 8 = 0 THEN 'test_' ELSE '' END || 'm' || p_partkey // 4 || '.py' AS path FROM part) SELECT path, 'public' AS name FROM f WHERE NOT starts_with(path, 'test_') AND 'test_' || path NOT IN (SELECT path FROM f) ORDER BY path LIMIT 20")
def x4(t):
    body = F.lit("def public(a):\n    return a\n\ndef _hidden():\n    pass\n")
    name = F.concat(F.when(F.col("p_partkey") % 8 == 0, "test_").otherwise(""), F.lit("m"), F.floor(F.col("p_partkey") / 4).cast("string"), F.lit(".py"))
    return M.untested(M.code_chunks(t.part.select(name.alias("path"), body.alias("content"))))


_FUNCTIONS = "WITH f AS (SELECT CASE WHEN p_partkey % 8 = 0 THEN 'test_' ELSE '' END || 'm' || p_partkey // 4 || '.py' AS path, p_size FROM part)"


@query("h29_suggest_tests", _FUNCTIONS + " SELECT DISTINCT path, name FROM (SELECT path, unnest(['f' || p_size, 'g' || p_size]) AS name FROM f) WHERE path = 'm3.py' AND 'test_m3.py' NOT IN (SELECT path FROM f) ORDER BY name LIMIT 5")
def h29(t):
    """Four parts share a file, each with two public functions."""
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit("def f"), size, F.lit("(a):\n    return a\n\ndef g"), size, F.lit("(a):\n    return a\n\ndef _h():\n    pass\n"))
    name = F.concat(F.when(F.col("p_partkey") % 8 == 0, "test_").otherwise(""), F.lit("m"), F.floor(F.col("p_partkey") / 4).cast("string"), F.lit(".py"))
    return M.suggest_tests(M.code_chunks(t.part.select(name.alias("path"), body.alias("content"))), "m3.py")
