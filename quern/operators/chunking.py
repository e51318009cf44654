"""Markdown and text chunking, extraction, redaction, scans.

Lines are rows with a place; headers, fences and blocks are carried along by windows within one document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions.text import basename, contains_any, extension, ladder, lookup


def lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, at (from 0), line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))


def sections(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """id, section, h1, h2, h3, body: markdown sections. Headers within fences don't count; an h1 resets h2 and h3, an h2 h3."""
    w = Window.partitionBy("id").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs, id_col, text).withColumn("fence", F.col("line").rlike(r"^\s*```"))
    rows = rows.withColumn("inside", (F.sum(F.col("fence").cast("int")).over(upto) - F.col("fence").cast("int")) % 2 == 1)
    level = F.when(F.col("inside") | F.col("fence"), 0).otherwise(F.length(F.regexp_extract("line", r"^(#{1,3})\s+\S", 1)))
    rows = rows.withColumn("level", level).withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_extract("line", r"^#{1,3}\s+(.*)$", 1))))
    rows = rows.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto))

    def head(n: int) -> Column:
        # a marker at every header of this level or above: the title, or '' where a higher one resets it
        mark = F.when(F.col("level") == n, F.col("title")).when((F.col("level") > 0) & (F.col("level") < n), F.lit(""))
        return F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(""))

    rows = rows.select("id", "at", "line", "level", "section", *[head(n).alias(f"h{n}") for n in (1, 2, 3)])
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "line")))), lambda x: x["line"])
    return rows.groupBy("id", "section").agg(*[F.max(f"h{n}").alias(f"h{n}") for n in (1, 2, 3)], F.array_join(body, "\n").alias("body"))


def blocks(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """id, block, kind, body: fences and runs of table lines stay whole; a paragraph runs up to the next blank line, which begins
    the next paragraph. Blank paragraphs are left out."""
    w = Window.partitionBy("id").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs, id_col, text).withColumn("fence", F.col("line").rlike(r"^\s*```").cast("int"))
    rows = rows.withColumn("closed", F.sum("fence").over(upto))
    inside = ((F.col("closed") - F.col("fence")) % 2 == 1) | (F.col("fence") == 1)
    rows = rows.withColumn("kind", ladder([(inside, "fence"), (F.col("line").startswith("|"), "table")], "paragraph"))
    opens = (F.col("fence") == 1) & (F.col("closed") % 2 == 1)
    other = F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True))
    start = F.when(F.col("kind") == "fence", opens).otherwise(other | ((F.col("kind") == "paragraph") & (F.trim("line") == "")))
    rows = rows.withColumn("block", F.sum(start.cast("int")).over(upto))
    body = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return rows.groupBy("id", "block", "kind").agg(F.array_join(body, "\n").alias("body")).where(F.trim(F.replace("body", F.lit("\n"), F.lit(" "))) != "")


def pack_lengths(lengths: Column, limit: int = 3200, separator: int = 2) -> Column:
    """Chunk number of each block by greedy packing of an array of lengths, each counted with its separator.

    A block over the limit stands alone; the first block of a chunk that a full one was closed for counts without separator.
    """
    none = F.array().cast("array<int>")

    def step(acc: Column, n: Column) -> Column:
        over = n > limit
        fits = ~over & (acc["used"] + n + separator <= limit)
        out = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + acc["open"])
        used = F.when(over, 0).when(fits, acc["used"] + n + separator).otherwise(n)
        return F.struct(F.when(over, out + 1).otherwise(out).alias("chunk"), F.when(over, 0).otherwise(1).alias("open"), used.alias("used"), F.array_append(acc["out"], out).alias("out"))

    return F.aggregate(lengths, F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("open"), F.lit(0).alias("used"), none.alias("out")), step, lambda a: a["out"])


def split_sections(sections_: DataFrame, limit: int = 3200) -> DataFrame:
    """id, section, part, text of sections (id, section, body): whole up to ``limit`` characters, else their blocks packed.

    An oversized table is split into parts with its header repeated, which stay one block. Empty sections are left out.
    """
    rows = sections_.select("id", "section", F.regexp_replace("body", r"\A\s+|\s+\z", "").alias("body")).where("body <> ''")
    short = rows.where(F.length("body") <= limit).select("id", "section", F.lit(0).alias("part"), F.col("body").alias("text"))
    long = rows.where(F.length("body") > limit).select(F.struct("id", "section").alias("id"), F.col("body").alias("text"))
    b = blocks(long)
    big = (F.col("kind") == "table") & (F.length("body") > limit)
    # only oversized tables go to Python
    tables = b.where(big).withColumn("body", F.array_join(split_table(F.col("body"), limit), "\n\n"))
    b = b.where(~big).unionByName(tables)
    whole = b.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda x: x["body"]).alias("bodies"))
    numbered = whole.withColumn("chunk", pack_lengths(F.transform("bodies", lambda x: F.length(x)), limit))
    parts = numbered.select("id", F.posexplode(F.arrays_zip("bodies", "chunk")).alias("at", "x")).select("id", "at", "x.bodies", "x.chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bodies"))), lambda x: x["bodies"]), "\n\n")
    out = parts.groupBy("id", "chunk").agg(F.regexp_replace(text, r"\A\s+|\s+\z", "").alias("text")).where("text <> ''")
    return short.unionByName(out.select("id.id", "id.section", F.col("chunk").alias("part"), "text"))


def ranked_findings(findings: DataFrame, limit: int = 50) -> DataFrame:
    """The first findings by severity, then file and line, with their rank."""
    order = [lookup(F.col("severity"), fixed.SEVERITY, 3), F.col("id"), F.col("line_no"), F.col("rule")]
    # the sorted top only; the rank is over these few rows
    return findings.orderBy(*order).limit(limit).withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


def split_rows(rows: list[str], limit: int) -> list[list[str]]:
    """Table rows packed greedily into parts of at most ``limit`` characters with their line breaks."""
    parts: list[list[str]] = []
    used = 0
    for r in rows:
        if not parts or used + 1 + len(r) > limit:
            parts.append([])
            used = -1
        parts[-1].append(r)
        used += 1 + len(r)
    return parts


def split_table(body: Column, limit: int = 3200) -> Column:
    """Parts of an oversized table, each with the two header lines repeated; one pass over its rows."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None or len(t) <= limit:
                out.append([t] if t is not None else [])
                continue
            rows = t.split("\n")
            head = "\n".join(rows[:2])
            out.append(["\n".join([head, *part]) for part in split_rows(rows[2:], limit - len(head) - 1)] or [head])
        return pd.Series(out)

    return split(body)


def doc_metadata(docs: DataFrame, path: str = "path") -> DataFrame:
    """layer, doc_priority and required_on_session_start by file name; unknown files are normal."""
    table = docs.sparkSession.createDataFrame(fixed.DOC_FILES, "file string, layer string, doc_priority string, required_on_session_start boolean")
    j = docs.withColumn("_file", basename(F.col(path))).join(F.broadcast(table), F.col("_file") == F.col("file"), "left")
    return j.drop("_file", "file").withColumns({"layer": F.coalesce("layer", F.lit("general")), "doc_priority": F.coalesce("doc_priority", F.lit("normal")), "required_on_session_start": F.coalesce("required_on_session_start", F.lit(False))})


def chunk_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


#: Own redaction rules: name, pattern, weight.
REDACTIONS = [
    ("assignment", r"(?i)\b(token|secret|password|passwd|api_key)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{6,}[\"']?", 0.9),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.3),
    ("long_number", r"\b[0-9]{13,16}\b", 0.5),
    ("ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.4),
]


def redact(text: Column) -> tuple[Column, Column]:
    """Redacted text and the risk (largest weight of a rule that matches)."""
    out, risk = text, F.lit(0.0)
    for name, pattern, weight in REDACTIONS:
        risk = F.greatest(risk, F.when(text.rlike(pattern), weight).otherwise(0.0))
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return out, risk


def scan(files: DataFrame, id_col: str, text: str, rules: list[tuple[str, str, str]] = fixed.SECURITY_RULES) -> DataFrame:
    """rule, severity, id, line_no, snippet (120) for every line that a rule matches.

    A text that no rule matches isn't split at all; each line is tested once by every rule, in one pass.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    hit = lines(rows, "id", "text").withColumn("r", F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules])))
    return hit.where(F.size("r") > 0).select("id", (F.col("at") + 1).cast("long").alias("line_no"), F.substring("line", 1, 120).alias("snippet"), F.inline("r"))


def roles(name: Column, code: Column, path: Column) -> dict[str, Column]:
    """The five role detectors."""
    low, has = F.lower(path), name.isNotNull()
    n = F.coalesce(name, F.lit(""))
    ends = lambda c, xs: c.rlike("(" + "|".join(xs) + ")$")
    return {
        "is_dto": ends(n, fixed.DTO_SUFFIXES) | contains_any(low, fixed.DTO_PATHS),
        "is_migration": contains_any(low, fixed.MIGRATION_PATHS) | F.lower(n).contains("migration"),
        "is_ui_component": has & extension(path).isin(".tsx", ".jsx", ".vue") & n.rlike(r"^\p{Lu}") & (code.contains("return ") | code.contains("<>") | code.contains("React")),
        "is_business_rule": has & (contains_any(F.lower(n), fixed.RULE_WORDS) | contains_any(low, fixed.RULE_PATHS)),
        "is_entity": has & (n.endswith("Entity") | contains_any(low, fixed.ENTITY_PATHS) | code.rlike(r"class\s+\w+\s*\([^)]*Entity[^)]*\)")),
    }


def config_keys(code: Column, language: Column) -> Column:
    """Names of environment variables and settings that a piece of code reads, each once, sorted."""
    all_of = lambda *ps: F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in ps])
    py = all_of(*fixed.PYTHON_ENV)
    ts = all_of(*fixed.TYPESCRIPT_ENV)
    cs = all_of(*fixed.CSHARP_ENV)
    return F.array_sort(F.array_distinct(F.when(language == "python", py).when(language == "typescript", ts).when(language == "csharp", cs).otherwise(F.array().cast("array<string>"))))


def endpoints(code: Column, language: Column, name: Column) -> Column:
    """HTTP routes in decorators and attributes, each once, sorted."""
    found = lambda pattern: F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
    deco = F.filter(found(fixed.ENDPOINT_PATH), lambda v: v.startswith("/") | v.startswith("http") | v.startswith("api"))
    verbs = F.transform(found(fixed.ENDPOINT_METHOD), lambda v: F.concat(F.lit("["), v, F.lit("] "), F.coalesce(name, F.lit(""))))
    attrs = F.transform(found(fixed.ENDPOINT_ATTRIBUTE), lambda v: F.when(v == "", F.concat(F.lit("["), F.coalesce(name, F.lit("unnamed")), F.lit("]"))).otherwise(v))
    return F.array_sort(F.array_distinct(F.when(language == "python", F.concat(deco, verbs)).when(language.isin("typescript", "csharp"), attrs).otherwise(F.array().cast("array<string>"))))


def smells(files: DataFrame, id_col: str, text: str, max_lines: int = 800, depth: int = 5) -> DataFrame:
    """LARGE_FILE and DEEP_NESTING (first line indented by ``depth`` levels of four) for any language."""
    body = F.split(text, "\n", -1)
    rows = files.select(F.col(id_col).alias("id"), F.size(body).alias("n"), F.filter(F.transform(body, lambda x, i: F.struct((i + 1).alias("line_no"), F.floor((F.length(x) - F.length(F.ltrim(x))) / 4).alias("level"), (F.trim(x) != "").alias("full"))), lambda s: s["full"] & (s["level"] >= depth)).alias("deep"))
    big = rows.where(F.col("n") > max_lines).select("id", F.lit("LARGE_FILE").alias("smell"), F.lit(1).cast("long").alias("line_no"), F.col("n").cast("long").alias("value"))
    deep = rows.where(F.size("deep") > 0).select("id", F.lit("DEEP_NESTING").alias("smell"), F.get("deep", F.lit(0))["line_no"].cast("long").alias("line_no"), F.get("deep", F.lit(0))["level"].cast("long").alias("value"))
    return big.unionByName(deep)
