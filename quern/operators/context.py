"""What a reader is handed: hits by record shape, parsed tool results, session context, assembled context, rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions.text import ladder

MAX_CHUNKS, MAX_MEMORY = 20, 10
SEARCH_RESULTS, SEARCH_QUERIES = 8, 3


def hit_shapes(hits: DataFrame) -> DataFrame:
    """Hits projected by the shape of their record: documents, summaries, memories, and code for all else.

    Fields that a shape has are '' if missing (a summary's language 'markdown'); fields that it lacks are null.
    """

    def field(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in hits.columns else F.lit(default)

    kind = F.coalesce(F.when(F.col("source_type") != "", F.col("source_type")), F.lit("source_code"))
    doc, summary, memory = (kind == x for x in ("agent_doc", "repo_summary", "episodic_memory"))
    code = ~(doc | summary | memory)
    lines = F.concat(field("start_line", "0"), F.lit("-"), field("end_line", "0"))
    cols = {
        "relative_path": F.when(doc, field("relative_path")), "layer": F.when(doc, field("layer")), "doc_priority": F.when(doc, field("doc_priority")),
        "h1": F.when(doc, field("h1")), "h2": F.when(doc, field("h2")), "h3": F.when(doc, field("h3")), "chunk_id": F.when(doc, field("chunk_id")),
        "content": F.when(doc, field("content")).when(memory, field("code")), "file": F.when(summary | code, field("file_path")), "name": F.when(summary | code, field("name")),
        "type": F.when(summary | code, field("chunk_type")), "code": F.when(summary | code, field("code")), "lines": F.when(summary | code, lines),
        "language": F.when(summary, field("language", "markdown")).when(code, field("language")), "project_name": F.when(summary, field("project_name")),
        "title": F.when(memory, field("name")), "memory_type": F.when(memory, field("memory_type")), "memory_layer": F.when(memory, field("memory_layer")), "provenance": F.when(memory, field("provenance")),
    }
    return hits.select("id", "score", kind.alias("source_type"), *[c.alias(k) for k, c in cols.items()])


def parse_results(rows: DataFrame, id_col: str, result: str) -> DataFrame:
    """id, at, file_path, content, relevance from the JSON of search results in any of the forms that tools return.

    A list, or an object with the list under results, items or chunks; elements are objects with alternative keys or plain
    strings; a string in place of the list is one chunk. At most SEARCH_RESULTS elements count.
    """
    j = F.col("_j")
    inner = F.coalesce(F.get_json_object(j, "$.results"), F.get_json_object(j, "$.items"), F.get_json_object(j, "$.chunks"))
    is_list = F.ltrim(j).startswith("[")
    body = F.when(is_list, j).otherwise(inner)
    plain = ~is_list & body.isNotNull() & ~F.ltrim(body).startswith("[")
    item = F.col("_x")
    key = lambda *names: F.coalesce(*[F.get_json_object(item, f"$.{n}") for n in names])
    obj = F.ltrim(item).startswith("{")
    base = rows.select(F.col(id_col).alias("id"), F.col(result).cast("string").alias("_j")).withColumn("_body", body).withColumn("_plain", plain)
    whole = base.where("_plain").select("id", F.lit(0).alias("at"), F.lit("search_result").alias("file_path"), F.substring("_body", 1, 2000).alias("content"), F.lit(1.0).alias("relevance"))
    each = base.where("not _plain").select("id", F.posexplode(F.from_json("_body", "array<string>")).alias("at", "_x")).where(F.col("at") < SEARCH_RESULTS)
    found = each.select(
        "id", "at",
        F.when(obj, F.coalesce(key("file_path", "path"), F.lit("unknown"))).otherwise(F.lit("search")).alias("file_path"),
        F.substring(F.when(obj, F.coalesce(key("content", "text"), item)).otherwise(item), 1, 1500).alias("content"),
        F.when(obj, F.coalesce(key("score", "relevance").cast("double"), F.lit(0.8))).otherwise(F.lit(0.7)).alias("relevance"),
    )
    return whole.unionByName(found)


def _joined(df: DataFrame, by: str, order: list[str], piece: Column, separator: str, name: str) -> DataFrame:
    """One text a group from its few pieces in order."""
    rows = df.select(by, F.struct(*order, piece.alias("piece")).alias("r"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["piece"]), separator).alias(name))


def session_text(chunks: DataFrame, memories: DataFrame, budget: Column, by: str = "task_id") -> DataFrame:
    """by, context: the task's last memories and best chunks as text, cut at ``budget`` tokens.

    ``chunks`` (by, at, file_path, content, relevance): in order of arrival, or the MAX_CHUNKS best by relevance once there are
    more. ``memories`` (by, at, title, content): the last MAX_MEMORY are kept, of which the first five are shown.
    """
    arrival, best = Window.partitionBy(by).orderBy("at"), Window.partitionBy(by).orderBy(F.desc("relevance"), "at")
    n = F.count("*").over(Window.partitionBy(by))
    few = chunks.withColumn("_n", n).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= MAX_CHUNKS)
    few = few.withColumn("_o", F.when(F.col("_n") > MAX_CHUNKS, F.col("_r")).otherwise(F.row_number().over(arrival)))
    code = _joined(few, by, ["_o"], F.concat(F.lit("### "), F.coalesce("file_path", F.lit("?")), F.lit("\n```\n"), F.coalesce("content", F.lit("")), F.lit("\n```")), "\n\n", "code")
    last = memories.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at")))).where(F.col("_r") <= MAX_MEMORY)
    last = last.withColumn("_o", F.row_number().over(arrival)).where("_o <= 5")
    memory = _joined(last, by, ["_o"], F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("content", F.lit(""))), "\n", "memory")
    both = memory.join(code, by, "full_outer")
    raw = F.concat_ws("\n\n", F.concat(F.lit(fixed.MEMORY_HEAD + "\n"), "memory"), F.col("code"))
    limit = (budget * fixed.CHARS_PER_TOKEN).cast("int")
    return both.select(by, F.when(F.length(raw) > limit, F.concat(F.substring(raw, F.lit(1), limit), F.lit(fixed.CONTEXT_CUT))).otherwise(raw).alias("context"))


def assemble(found: DataFrame, memories: DataFrame, budget: int, widen: bool = False) -> DataFrame:
    """task_id, n_chunks, n_memory, tokens_used, context of each task.

    ``found`` (task_id, query_no, rn, file_path, content, relevance): the first SEARCH_QUERIES queries count, in order, until
    SEARCH_RESULTS chunks are there. ``memories`` (task_id, at, title, content). ``widen`` raises the budget by half.
    """
    budget = int(budget * 1.5) if widen else budget
    w = Window.partitionBy("task_id").orderBy("query_no", "rn")
    chunks = found.where(F.col("query_no") < SEARCH_QUERIES).withColumn("at", F.row_number().over(w)).where(F.col("at") <= SEARCH_RESULTS).withColumn("content", F.substring("content", 1, 1500))
    few = memories.withColumn("_r", F.row_number().over(Window.partitionBy("task_id").orderBy("at"))).where("_r <= 5").withColumn("content", F.substring("content", 1, 500))
    text = session_text(chunks, few, F.lit(budget))
    n = lambda df, name: df.groupBy("task_id").agg(F.count("*").alias(name))
    out = text.join(n(chunks, "n_chunks"), "task_id", "left").join(n(few, "n_memory"), "task_id", "left")
    return out.select("task_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_memory", F.lit(0)).alias("n_memory"), F.floor(F.length("context") / 4).alias("tokens_used"), "context")


def render(hits: DataFrame) -> DataFrame:
    """query_id, text: ranked hits (query_id, query, rn, name, type, final_score, ratio, file, lines, language, code) as markdown."""
    note = F.when(F.col("ratio") < 1.0, F.format_string(" 📦 %.0f%%", F.col("ratio") * 100)).otherwise("")
    block = F.concat(
        F.lit("### `"), "name", F.lit("` ("), "type", F.lit(") — final_score: "), F.format_string("%.3f", "final_score"), note, F.lit("\n📄 `"), "file",
        F.lit(fixed.LINES_WORD), "lines", F.lit("\n```"), "language", F.lit("\n"), F.substring("code", 1, 800), F.lit("\n```\n"),
    )
    body = _joined(hits, "query_id", ["rn"], block, "\n", "body")
    heads = hits.groupBy("query_id").agg(F.first("query").alias("query"), F.count("*").alias("n"))
    return heads.join(body, "query_id").select("query_id", F.concat(F.format_string(fixed.RESULT_HEAD, "query", "n"), F.lit("\n\n"), "body").alias("text"))


def impact_text(impacts: DataFrame, by: str, limit: int = 12) -> DataFrame:
    """by, text: the ``limit`` strongest impacts (by, file_path, score) of each change, a line each below their number."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "file_path")
    all_ = impacts.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.7).alias("high"))
    top = impacts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    risk = ladder([(F.col("score") >= 0.7, "high"), (F.col("score") >= 0.4, "medium")], "low")
    lines = _joined(top, by, ["_r"], F.format_string(fixed.IMPACT_LINE, "file_path", "score", risk), "\n", "lines")
    return all_.join(lines, by).select(by, F.concat(F.format_string(fixed.IMPACT_HEAD, "n", "high"), F.lit("\n"), "lines").alias("text"))
