"""Readers and writers: source trees, JSON cases, JSON-line logs, registries, tables with versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed

def wanted(path: Column, extensions: list[str], excluded: list[str], hidden: bool = True) -> Column:
    """Whether a file (path below the root) is one of ``extensions`` (in any case where hidden folders are left out, too), outside
    all ``excluded`` folders."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    end = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in excluded]))
    if hidden:
        return end.isin(extensions) & keep
    return F.lower(end).isin(extensions) & keep & ~F.exists(folders, lambda x: x.startswith("."))


#: The scans by purpose: extensions, excluded folders, and whether hidden folders are read.
SCANS = {
    "index": (fixed.SOURCE_EXTENSIONS, fixed.SOURCE_EXCLUDED, True),
    "profile": (list(fixed.LANGUAGES), fixed.PROFILE_EXCLUDED, True),
    "analysis": (fixed.ANALYSIS_EXTENSIONS, fixed.ANALYSIS_EXCLUDED, False),
}


def scan_files(listing: DataFrame, purpose: str, path: str = "path") -> DataFrame:
    """The files of a listing that a scan reads."""
    return listing.where(wanted(F.col(path), *SCANS[purpose]))


def doc_files(listing: DataFrame, folder: str = ".agent", path: str = "path") -> DataFrame:
    """Markdown files anywhere below the folder, but for the excluded names."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return listing.where(F.col(path).startswith(folder + "/") & name.endswith(".md") & ~name.isin(fixed.DOCS_EXCLUDED))


def source_files(spark: SparkSession, root: str, purpose: str = "index") -> DataFrame:
    """path (below root), content of all files that a scan of ``root`` reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^" + r"(?:file:)?/*" + _escape(root.strip("/")) + "/*", "")
    return scan_files(rows.select(path.alias("path"), F.col("content").cast("string").alias("content")), purpose)


def _escape(s: str) -> str:
    import re

    return re.escape(s)


def agent_docs(spark: SparkSession, root: str, folder: str = ".agent") -> DataFrame:
    """path (below root), text of the markdown files of a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(f"{root}/{folder}")
    path = F.regexp_replace("path", "^" + r"(?:file:)?/*" + _escape(root.strip("/")) + "/*", "")
    return doc_files(rows.select(path.alias("path"), F.col("content").cast("string").alias("text")), folder)


_CASES = "array<struct<question: string, query: string, expected_files: array<string>, expected_symbols: array<string>, expected_entities: array<string>, tags: array<string>>>"


def parse_cases(rows: DataFrame, json: str) -> DataFrame:
    """query, expected_files, expected_entities, tags of JSON arrays of cases; ``question`` and ``query`` name the same."""
    none = F.array().cast("array<string>")
    c = rows.select(F.explode(F.from_json(json, _CASES)).alias("c")).select("c.*")
    return c.select(F.coalesce("question", "query", F.lit("")).alias("query"), F.coalesce("expected_files", none).alias("expected_files"), F.coalesce("expected_entities", "expected_symbols", none).alias("expected_entities"), F.coalesce("tags", none).alias("tags"))


def eval_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``parse_cases`` of the JSON files at a path: an array a file, or a case (or an array) a line, which is read in parts."""
    return parse_cases(spark.read.option("wholetext", str(not lines).lower()).text(path), "value")


def case_lines(cases: DataFrame) -> DataFrame:
    """value: each case as a line of JSON."""
    return cases.select(F.to_json(F.struct(*cases.columns)).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """Write the one text column of a table as lines, in as many files as it has parts."""
    rows.write.mode("overwrite").option("lineSep", "\n").text(path)


LOG = "ts string, level string, logger string, msg string, correlation_id string, tool string, duration_ms double, collection string"


def parse_log(line: Column, ts: Column) -> Column:
    """A log record from a JSON line; a malformed line becomes an INFO record with the line as message."""
    got = F.from_json(line, LOG)
    bad = got.isNull() | (got["msg"].isNull() & got["level"].isNull() & got["tool"].isNull())
    return F.when(bad, F.struct(ts.cast("string").alias("ts"), F.lit("INFO").alias("level"), F.lit(None).cast("string").alias("logger"), line.alias("msg"), F.lit(None).cast("string").alias("correlation_id"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("double").alias("duration_ms"), F.lit(None).cast("string").alias("collection"))).otherwise(got)


def log_lines(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return spark.read.text(path).select(parse_log(F.col("value"), F.lit(as_of)).alias("r")).select("r.*")


_PROFILE = "struct<project_name: string, collection: string, project_path: string, languages: array<string>, frameworks: array<string>, package_managers: array<string>, module_roots: array<string>, entrypoints: array<string>, summary: string, indexed_at: double>"


def parse_registry(rows: DataFrame, json: str) -> DataFrame:
    """One row a project from a JSON object of profiles by collection."""
    return rows.select(F.explode(F.from_json(json, f"map<string, {_PROFILE}>")).alias("key", "p")).select("p.*")


def registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``parse_registry`` of the files at a path: an object a file, or one a line."""
    return parse_registry(spark.read.option("wholetext", str(not lines).lower()).text(path), "value")


def registry_lines(profiles: DataFrame) -> DataFrame:
    """value: each project as a line of JSON, an object by its collection."""
    return profiles.select(F.to_json(F.create_map(F.coalesce("collection", F.lit("")), F.struct(*profiles.columns))).alias("value"))


def replace(df: DataFrame, path: str) -> None:
    """Write ``df`` as a new version of the table at ``path``, then point to it; ``df`` may read the old version.

    Versions are folders of their own; the pointer is a small file that one rename replaces, so a reader finds the old or
    the new version at any time. The version before the last one is deleted.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    J = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = J.Path(path).getFileSystem(conf)
    before = current(spark, path)
    out = fs.create(J.Path(f"{path}/{version}.pointer"), True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(J, "Options$Rename"), 1)
    overwrite[0] = getattr(getattr(J, "Options$Rename"), "OVERWRITE")
    context = J.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(J.Path(f"{path}/{version}.pointer"), J.Path(f"{path}/current"), overwrite)
    for old in fs.listStatus(J.Path(f"{path}/versions")):
        if old.getPath().getName() not in (version, before):
            fs.delete(old.getPath(), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names, if there is one."""
    J = spark._jvm.org.apache.hadoop.fs
    fs = J.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(J.Path(f"{path}/current")):
        return None
    file = fs.open(J.Path(f"{path}/current"))
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``replace`` writes."""
    return spark.read.parquet(f"{path}/versions/{current(spark, path)}")
