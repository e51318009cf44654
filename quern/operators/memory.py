"""Memory records with validity, code chunk extraction, project profiles and task states."""

from __future__ import annotations

import ast
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import braces, fixed
from quern.functions.text import ladder, lookup
from quern.operators import retrieval
from quern.operators.aggregates import folded

LAYERS = {"architecture_decision": "decision", "architectural_decision": "decision", "general": "episodic", "episodic": "episodic", "semantic": "semantic", "decision": "decision"}


def entry_id(title: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", title, F.substring(content, 1, 200)), 256), 1, 16)


def layer(kind: Column) -> Column:
    return ladder([(kind == k, v) for k, v in LAYERS.items()], "episodic")


def valid(as_of: Column) -> Column:
    """Active and not past its end; no end means for ever."""
    return (F.col("status") == "active") & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of))


def recall(memories: DataFrame, as_of: Column, layers: list[str] | None = None, include_invalid: bool = False) -> DataFrame:
    rows = memories if include_invalid else memories.where(valid(as_of))
    return rows.where(F.col("layer").isin(layers)) if layers else rows


def prune(memories: DataFrame, as_of: Column) -> DataFrame:
    """Active entries past their end become expired."""
    over = (F.col("status") == "active") & F.col("valid_to").isNotNull() & (F.col("valid_to") < as_of)
    return memories.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def search(queries: DataFrame, memories: DataFrame, k: int = 5, kind: str | None = None, layer_: str | None = None, collection: str | None = None, include_invalid: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rn: the k best memories (id, content, ...) for each query, restricted before any ranking.

    Only active entries count unless ``include_invalid``; a layer (given, or that of a known ``kind``) goes before a kind. With
    ``vectors`` (id, vec) the ranking is hybrid, else sparse.
    """
    rows = memories if include_invalid else memories.where("status = 'active'")
    layer_ = layer_ or LAYERS.get(kind or "")
    if layer_:
        rows = rows.where(F.col("layer") == layer_)
    elif kind:
        rows = rows.where(F.col("memory_type") == kind)
    if collection is not None:
        rows = rows.where(F.col("collection") == collection)
    texts = rows.select("id", F.col("content").alias("text"))
    if vectors is None:
        return retrieval.bm25(queries, texts, k)
    return retrieval.hybrid(queries, vectors.join(texts.select("id"), "id", "left_semi"), texts, k=k)


def patches(queries: DataFrame, memories: DataFrame, collection: str | None = None, limit: int = 3) -> DataFrame:
    """The patches most like each goal, as records: query_id, rn, task_id, goal, task_type, language, patch, tier."""
    hits = search(queries, memories, limit, kind="code_patch", collection=collection)
    part = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in memories.columns else F.lit(default)
    tier = F.replace(part("provenance", ""), F.lit("agent-"), F.lit(""))
    rec = memories.select("id", part("task_id", "").alias("task_id"), part("name", "").alias("goal"), part("chunk_type", "unknown").alias("task_type"), part("language", "python").alias("language"), F.col("content").alias("patch"), F.when(tier == "", "TIER_CHEAP").otherwise(tier).alias("tier"))
    return hits.join(rec, "id").drop("id", "score")


def compact(queries: DataFrame, memories: DataFrame, merge: int = 5, found: int = 20) -> tuple[DataFrame, DataFrame]:
    """For each query (query_id, text) the new semantic record of its first ``merge`` of ``found`` hits, and the memories with
    those that were merged archived. A query with fewer than two hits compacts nothing."""
    hits = search(queries, memories, found)
    n = F.count("*").over(Window.partitionBy("query_id"))
    first = hits.withColumn("_n", n).where((F.col("_n") >= 2) & (F.col("rn") <= merge)).join(memories.select("id", "content"), "id")
    text = F.transform(F.array_sort(F.collect_list(F.struct("rn", "content"))), lambda x: x["content"])
    new = first.groupBy("query_id").agg(F.array_join(text, "\n").alias("content"), F.count("*").alias("merged"))
    new = new.join(queries.select("query_id", "text"), "query_id").select("query_id", F.concat(F.lit("Compacted Memory: "), "text").alias("title"), "content", F.lit("semantic").alias("layer"), F.array(F.lit("compacted")).alias("tags"), "merged")
    gone = first.select("id", F.lit("archived").alias("_s")).distinct()
    return new, memories.join(gone, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def cycle(memories: DataFrame, queries: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """One run of upkeep: expire, then compact what is left. The new records and the old ones with their new states."""
    return compact(queries, prune(memories, as_of))


def facts(memories: DataFrame, id_col: str, content: str) -> DataFrame:
    """One row for each line of a text, bullets stripped, blank lines dropped: id, at, fact."""
    rows = memories.select(F.col(id_col).alias("id"), F.posexplode(F.split(content, "\n", -1)).alias("at", "line"))
    return rows.select("id", "at", F.trim(F.regexp_replace("line", r"^\s*(?:[-*•]|\d+[.)])\s+", "")).alias("fact")).where("fact <> ''")


CHUNK_SCHEMA = "path string, language string, chunk_type string, name string, start_line int, end_line int, parent_class string, docstring string, imports array<string>, calls array<string>, bases array<string>, n_methods int, code string"


def _python_chunks(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines = source.split("\n")
    imports: set[str] = set()
    found: list[list] = []
    # (node, its owner, the definitions that it is in): every node is visited once, its calls are of all definitions around it
    todo: list[tuple[ast.AST, str | None, tuple]] = [(tree, None, ())]
    while todo:
        node, owner, around = todo.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            around = (*around, (node, owner, set()))
            found.append(around[-1])
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            imports.add(ast.unparse(node))
        elif isinstance(node, ast.Call) and around:
            name = _name(node.func)
            for _, _, calls in around:
                calls.add(name)
        inner = node.name if isinstance(node, ast.ClassDef) else owner
        todo += [(c, inner, around) for c in reversed(list(ast.iter_child_nodes(node)))]
    out: list[tuple] = []
    every = sorted(imports)
    for node, owner, calls in found:
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        bases = [_name(b) for b in node.bases] if kind == "class" else []
        methods = sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in node.body)
        first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
        out.append((path, "python", kind, node.name, first, node.end_lineno, owner, ast.get_docstring(node), every, sorted(calls), bases, methods, "\n".join(lines[first - 1 : node.end_lineno])))
    return out


def _name(node: ast.AST) -> str:
    """``ast.unparse``, without it for names with dots."""
    parts, at = [], node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(parts)]) if isinstance(at, ast.Name) else ast.unparse(node)


def _brace_chunks(path: str, source: str, language: str) -> list[tuple]:
    """Definitions of a brace language, with the imports of the file."""
    imports = sorted(set(re.findall(r"^(?:import\s.+|using\s+[\w.]+;)", source, re.M)))
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: braces.line_of(starts, at)
    return [(path, language, c["kind"], c["name"], line(c["start"]), line(max(c["start"], c["end"] - 1)), c["owner"], None, imports, c["calls"], c["bases"], c["methods"], source[c["start"] : c["end"]]) for c in braces.definitions(source, language)]


#: The languages by extension; how many different files with how many characters in all a task remembers; rows that it sends on at once.
LANGUAGE_OF = {"py": "python", "ts": "typescript", "tsx": "typescript", "cs": "csharp"}
KNOWN, KNOWN_CHARS, ROWS = 4096, 1 << 23, 4096


def code_chunks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Classes, interfaces and functions of Python, TypeScript and C# files, with imports, calls and bases.

    Files are dealt to tasks by a hash of their path, since a table of many small ones may be read in one task. Copies of a file are
    parsed once in a task, as long as it remembers them.
    """

    def parsed(language: str, source: str) -> list[tuple]:
        return _python_chunks("", source) if language == "python" else _brace_chunks("", source, language)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

    def run(batches):
        known: dict[tuple[str, str], list[tuple]] = {}
        held = 0
        for pdf in batches:
            rows: list[tuple] = []
            for p, c in zip(pdf["path"], pdf["content"]):
                language = LANGUAGE_OF.get(p.rsplit(".", 1)[-1].lower())
                if language is None:
                    continue
                key = (language, c or "")
                if key not in known:
                    if len(known) >= KNOWN or held > KNOWN_CHARS:
                        known.clear()
                        held = 0
                    known[key] = parsed(*key)
                    held += len(key[1])
                rows += [(p, *r[1:]) for r in known[key]]
                if len(rows) >= ROWS:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    spark = files.sparkSession
    # a fixed number: what is coalesced by its bytes would be few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).repartition(tasks, "path").mapInPandas(run, CHUNK_SCHEMA)


def python_smells(chunks: DataFrame) -> DataFrame:
    """LONG_METHOD over 50 lines, GOD_CLASS over 500 lines or 15 methods."""
    size = F.col("end_line") - F.col("start_line") + 1
    long = chunks.where((F.col("chunk_type") == "function") & (size > 50)).select("path", "name", F.lit("LONG_METHOD").alias("smell"), size.alias("value"))
    god = chunks.where((F.col("chunk_type") == "class") & ((size > 500) | (F.col("n_methods") > 15))).select("path", "name", F.lit("GOD_CLASS").alias("smell"), size.alias("value"))
    return long.unionByName(god)


def untested_functions(chunks: DataFrame) -> DataFrame:
    """path, name: public Python functions of files without a sibling test file."""
    folder, file = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_extract("path", r"([^/]+)\.py$", 1)
    public = (F.col("language") == "python") & (F.col("chunk_type") == "function") & ~F.col("name").startswith("_") & ~file.startswith("test_")
    own, none = F.concat(folder, F.lit("test_"), file, F.lit(".py")), F.lit(None).cast("string")
    # a file under its own path, a function under that of its test: the files are parsed once
    there = F.struct(F.col("path").alias("at"), F.lit(True).alias("there"), none.alias("path"), none.alias("name"))
    asked = F.struct(F.when(public, own).alias("at"), F.lit(False).alias("there"), F.col("path").alias("path"), F.col("name").alias("name"))
    rows = chunks.select(F.inline(F.array(there, asked))).where("at is not null").distinct()
    tested = F.bool_or("there").over(Window.partitionBy("at"))
    return rows.withColumn("_tested", tested).where(~F.col("_tested")).select("path", "name")


def untested(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` untested functions by path and name."""
    return untested_functions(chunks).orderBy("path", "name").limit(limit)


def profile(files: DataFrame, path: str = "path", project: str = "project") -> DataFrame:
    """Frameworks, package managers and entry points of each project by marker files, as sorted text lists."""
    found = F.array_compact(F.array(*[F.when(F.col(path).rlike(p), F.struct(F.lit(f).alias("f"), F.lit(m).cast("string").alias("m"))) for p, f, m in fixed.MARKERS]))
    entry = F.when(F.element_at(F.split(path, "/"), -1).isin(fixed.ENTRY_FILES), F.element_at(F.split(path, "/"), -1))
    rows = files.select(F.col(project).alias("project"), found.alias("x"), entry.alias("e"))
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "|")
    each = rows.groupBy("project").agg(F.flatten(F.collect_set("x")).alias("x"), F.collect_set("e").alias("e"), F.count("*").alias("n_files"))
    return each.select("project", text(F.transform("x", lambda s: s["f"])).alias("frameworks"), text(F.filter(F.transform("x", lambda s: s["m"]), lambda m: m.isNotNull())).alias("package_managers"), F.array_join(F.array_sort("e"), "|").alias("entry_points"), "n_files")


ROOTS = ["backend/src", "frontend", "src", "apps", "services"]


def project_profile(files: DataFrame, path: str = "path", project: str = "project") -> DataFrame:
    """One row a project: name, collection, languages, frameworks, package managers, module roots (12), entry points, summary.

    Module roots are the folders (three parts deep below the well-known ones, else one) that hold two source files or more, most
    first; well-known ones that exist go before them.
    """
    p = profile(files, path, project)
    name = F.col(path)
    end = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    source = files.where(end.isin(list(fixed.LANGUAGES)) & ~F.arrays_overlap(F.split(name, "/"), F.array(*[F.lit(x) for x in fixed.PROFILE_EXCLUDED])))
    langs = source.groupBy(F.col(project).alias("project")).agg(F.array_sort(F.collect_set(lookup(end, fixed.LANGUAGES))).alias("languages"), F.count("*").alias("n_source"))
    parts = F.split(name, "/")
    deep = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.least(F.lit(3), F.size(parts) - 1), F.lit(1))), "/")
    root = F.when(F.get(parts, F.lit(0)).isin("backend", "frontend", "src", "apps", "services"), deep).otherwise(F.get(parts, F.lit(0)))
    counts = source.groupBy(F.col(project).alias("project"), root.alias("root")).agg(F.count("*").alias("n")).where("n >= 2")
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "root"))).where("k <= 12")
    chosen = top.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "root"))), lambda x: x["root"]).alias("chosen"))
    there = files.groupBy(F.col(project).alias("project")).agg(*[F.bool_or(name.startswith(r + "/")).alias(f"_r{i}") for i, r in enumerate(ROOTS)])
    known = F.array_compact(F.array(*[F.when(F.col(f"_r{i}"), r) for i, r in enumerate(ROOTS)]))
    # files of no project have a profile, too
    j = p.join(there.withColumnRenamed("project", "_p"), F.col("project").eqNullSafe(F.col("_p"))).join(langs, "project", "left").join(chosen, "project", "left")
    none = F.array().cast("array<string>")
    chosen_ = F.coalesce("chosen", none)
    roots = F.slice(F.concat(F.filter(known, lambda r: ~F.array_contains(chosen_, r)), chosen_), 1, 12)
    listed = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    out = j.select(F.col("project").alias("project_name"), F.col("project").alias("collection"), F.col("project").alias("project_path"), F.coalesce("languages", none).alias("languages"), listed("frameworks").alias("frameworks"), listed("package_managers").alias("package_managers"), roots.alias("module_roots"), listed("entry_points").alias("entrypoints"), F.coalesce("n_source", F.lit(0)).alias("n_source"))
    said = lambda c, default: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(default)
    summary = F.format_string(fixed.PROFILE_SUMMARY, "project_name", "n_source", said("languages", fixed.UNKNOWN), said("frameworks", fixed.NOT_FOUND), said(F.slice("module_roots", 1, 6), fixed.NONE))
    return out.withColumn("summary", summary).withColumn("indexed_at", F.lit(0.0))


def summary_chunks(profiles: DataFrame) -> DataFrame:
    """collection, chunk_id, file_path, chunk_type, name, code: a profile, a summary and a chunk for each module root."""
    said = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(fixed.NOT_DETECTED)
    n, c, m = F.col("project_name"), F.col("collection"), F.col("root")
    whole = F.format_string(fixed.PROFILE_TEXT, n, c, "project_path", said("languages"), said("frameworks"), said("package_managers"), said("entrypoints"), "summary")
    roots = F.when(F.size("module_roots") > 0, F.array_join("module_roots", ", ")).otherwise(fixed.NONE)
    repo, module = F.format_string(fixed.REPO_TEXT, n, roots), F.format_string(fixed.MODULE_TEXT, m, n, c, n)

    def chunk(df: DataFrame, kind: str, place: Column, name: Column, code: Column, *ids: Column) -> DataFrame:
        return df.select("collection", F.sha2(F.concat_ws("|", c, F.lit(kind), *ids), 256).alias("chunk_id"), F.concat(F.lit("summary://"), c, F.lit("/"), place).alias("file_path"), F.lit(kind).alias("chunk_type"), name.alias("name"), code.alias("code"))

    out = chunk(profiles, "project_profile", F.lit("project_profile"), F.concat(n, F.lit(" Project Profile")), whole)
    out = out.unionByName(chunk(profiles, "repo_summary", F.lit("repo_summary"), F.concat(n, F.lit(" Repository Summary")), repo))
    each = profiles.withColumn("root", F.explode("module_roots"))
    return out.unionByName(chunk(each, "module_summary", F.concat(F.lit("module/"), m), F.concat(m, F.lit(" Module Summary")), module, m))


def doc_paths(points: DataFrame) -> DataFrame:
    """Different paths of the document chunks in an index."""
    return points.where((F.col("source_type") == "agent_doc") & F.col("relative_path").isNotNull() & (F.col("relative_path") != "")).select(F.col("relative_path").alias("path")).distinct()


def verification(files: DataFrame, path: str = "path", project: str = "project") -> DataFrame:
    """Verification profile of each project: dotnet before flutter before node before python."""
    has = lambda p: F.bool_or(F.col(path).rlike(p))
    return files.groupBy(project).agg(ladder([(has(fixed.MARKERS[0][0]), "dotnet"), (has(fixed.MARKERS[3][0]), "flutter"), (has(fixed.MARKERS[1][0]), "node"), (has(fixed.MARKERS[4][0]), "python")], "none").alias("profile"))


def task_start() -> tuple:
    """(node, status, reflections) of a task without results."""
    return 0, "PLANNING", 0


def task_step(state: tuple, ok: bool) -> tuple:
    """The state of a task after the result of a step.

    Steps follow TASK_NODES; a failed verifier goes back to the editor up to three times, then the task has FAILED, which is final;
    a failed reviewer waits for approval, which continues with the summarizer.
    """
    nodes = fixed.TASK_NODES
    editor, last = nodes.index("editor"), len(nodes) - 1
    node, status, reflections = state
    if status in ("DONE", "FAILED"):
        return state
    if status == "WAITING_APPROVAL":
        return (last, "EXECUTING", reflections) if ok else (node, "FAILED", reflections)
    if ok:
        return (node, "DONE", reflections) if node == last else (node + 1, "EXECUTING", reflections)
    if nodes[node] == "verifier":
        return (node, "FAILED", reflections + 1) if reflections >= 3 else (editor, "EXECUTING", reflections + 1)
    return node, "WAITING_APPROVAL" if nodes[node] == "reviewer" else "FAILED", reflections


def task_shown(state: tuple) -> tuple:
    return fixed.TASK_NODES[state[0]], state[1], state[2]


def task_states(events: DataFrame) -> DataFrame:
    """Final state of each task from its step results (task_id, step, ok), by ``task_step``.

    Tasks are folded one after the other from sorted partitions, so a task of any length takes no memory.
    """
    return folded(events, ["task_id"], ["step"], ["ok"], task_start(), lambda s, r: task_step(s, r[0]), task_shown, "task_id long, node string, status string, reflections int")


#: Fixed reasons why a command is not run.
VERDICTS = ["ok", "dangerous part", "blocked folder", "blocked argument", "bad syntax", "empty", "unknown program", "blocked shell flag"]


def command_verdict(command: Column, cwd: Column, programs: dict[str, str] | None = None) -> Column:
    """Why a command would not be run, or 'ok'.

    The rules in order: dangerous parts anywhere; a blocked name in the folder; blocked arguments; Python code after -c that
    does not parse; then the program must resolve (``programs``: path by name; absolute paths are themselves) to an allowed
    path, and a shell must not get code inline. Quoting needs a shell's tokens, hence an Arrow UDF.
    """
    known = dict(programs or {"python3": "/usr/bin/python3", "node": "/usr/bin/node", "bash": "/bin/bash"})

    @F.pandas_udf("string")
    def verdict(commands: pd.Series, folders: pd.Series) -> pd.Series:
        return pd.Series([_verdict(c, f, known) for c, f in zip(commands, folders)])

    return verdict(command, cwd)


def _verdict(command: str | None, folder: str | None, programs: dict[str, str]) -> str:
    command = command or ""
    if any(x in command.lower() for x in fixed.DANGEROUS_PARTS):
        return VERDICTS[1]
    if folder and any(x in folder for x in fixed.BLOCKED_FOLDERS):
        return VERDICTS[2]
    try:
        parts = shlex.split(command)
    except ValueError:
        return VERDICTS[4]
    if not set(parts[1:]).isdisjoint(fixed.BLOCKED_ARGUMENTS):
        return VERDICTS[3]
    if "python" in command.lower() and "-c" in parts[:-1]:
        try:
            ast.parse(parts[parts.index("-c") + 1])
        except SyntaxError:
            return VERDICTS[4]
        except ValueError:
            pass
    if not parts:
        return VERDICTS[5]
    path = parts[0] if parts[0].startswith("/") else programs.get(parts[0])
    if path not in fixed.ALLOWED_PROGRAMS:
        return VERDICTS[6]
    return VERDICTS[7] if path in fixed.SHELLS and parts[1:2] and parts[1] in fixed.BLOCKED_SHELL_FLAGS else VERDICTS[0]


def suggest_tests(chunks: DataFrame, path: str, k: int = 5) -> DataFrame:
    """The first ``k`` untested functions of a file, as context for suggestions."""
    return untested_functions(chunks).where(F.col("path") == path).orderBy("name").limit(k)
