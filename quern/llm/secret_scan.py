"""Secrets in every version of every document, scanned once per content.

A text's address is its SHA-256. The ledger (a Parquet table) has a row for each scanned blob: the rules with their versions, and the
spans found. Of a new set of documents only pairs of a blob and a rule version that the ledger lacks are scanned, each once however
many paths and versions hold the blob; findings are then joined back to all of them. A changed rule gets a new version and is run
on its own.

Addresses (32 bytes) decide what is to be scanned before any text moves. A task passes on only its first copy of a text. If few
blobs are unseen their addresses are broadcast, else texts are exchanged by address once; copies that meet are scanned once.
A row is appended only with its scan, so a run that is stopped leaves the ledger right and the next one does the rest; a blob
that two runs have scanned counts once.

Defined results: null counts as empty; texts are scanned whole, long ones too; rows that repeat an id, or are equal, each have
their row; an empty table gives an empty result; other columns are ignored. Spans are in code points, their end is exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tables import BROADCAST_ROWS, arrow_schema, parquet, shared_dir, small_batches, spread_join, stage


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose group ``group`` is shorter than ``least`` are dropped."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The first three are fixed by the query's contract; the others are of our own choice.
BASE = [
    Rule("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,900}\.eyJ[A-Za-z0-9_-]{10,900}\.[A-Za-z0-9_-]{10,900}"),
    Rule("url", r"://[A-Za-z0-9_.%+-]{1,100}:[A-Za-z0-9_.%+!$-]{1,100}@[A-Za-z0-9]"),
]
RULES = [*BASE, *MORE]


def quick(pattern: str, least: int, group: int) -> re.Pattern:
    """The compiled pattern. One run of a class that must reach ``least`` says so itself: the same matches, without those to drop."""
    run = re.fullmatch(r"((?:AKIA)?)(\[[^]]+\])\+", pattern)
    if run and not group and least > len(run[1]):
        pattern = f"{run[1]}{run[2]}{{{least - len(run[1])},}}"
    return re.compile(pattern)


def find(text: str, rule: Rule, compiled: re.Pattern | None = None) -> list[tuple[int, int]]:
    """Spans of ``rule`` in ``text``."""
    got = (compiled or quick(rule.pattern, rule.least, rule.group)).finditer(text)
    return [m.span() for m in got if m.end(rule.group) - m.start(rule.group) >= rule.least]


SCANS = "blob binary, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


class Ledger:
    """Which rules have been run on which blobs, and what they found. ``path``: a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def scans(self) -> DataFrame:
        return self.spark.read.schema(SCANS).parquet(self.path) if self._exists() else self.spark.createDataFrame([], SCANS)

    def append(self, scans: DataFrame) -> None:
        scans.write.mode("append").parquet(self.path)

    def unseen(self, blobs: DataFrame, rules: list[Rule]) -> DataFrame:
        """(blob, todo): the rules that are still to be run on each of ``blobs`` (blob); blobs without any are left out."""
        wanted = F.array(*[F.lit(r.key) for r in rules])
        if not self._exists():
            return blobs.distinct().select("blob", wanted.alias("todo"))
        done = self.scans().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        return blobs.distinct().join(done, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)

    def findings(self, rules: list[Rule]) -> DataFrame:
        """(blob, spans) of these rule versions, for blobs in which something was found; spans ascend by start, then by rule."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
        spans = F.filter("spans", lambda s: order[s["rule"]].isNotNull())
        rows = self.scans().select("blob", spans.alias("spans")).where(F.size("spans") > 0)
        every = rows.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        keyed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("no"), s["end"].alias("end"), F.split_part(s["rule"], F.lit("@"), F.lit(1)).alias("kind")))
        return every.select("blob", F.array_sort(F.array_distinct(keyed)).alias("spans"))


def address(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def _first_copies(rows: DataFrame) -> DataFrame:
    """(blob, text) without the repeats within a task."""
    small_batches(rows.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            some = []
            for i, x in enumerate(b.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    some.append(i)
            if some:
                yield b if len(some) == b.num_rows else b.take(pa.array(some))

    return rows.mapInArrow(keep, rows.schema)


def _run_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Scan (blob, text, todo), each blob once a task."""
    schema, by = arrow_schema(SCANS), {r.key: r for r in rules}
    small_batches(rows.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: quick(r.pattern, r.least, r.group) for k, r in by.items()}
        seen: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            for blob, text, todo in zip(*(c.to_pylist() for c in b.columns)):
                if blob not in seen:
                    seen.add(blob)
                    out.append((blob, todo, [{"rule": k, "start": s, "end": e} for k in todo for s, e in find(text, by[k], compiled[k])]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(scan, SCANS)


def update(docs: DataFrame, ledger: Ledger, rules: list[Rule] = RULES, text: str = "text", versions: DataFrame | None = None) -> DataFrame:
    """Scan what the ledger lacks of ``docs``; returns the (blob, todo) that were unseen. ``versions``: the addresses, if known."""
    blob = address(text)
    blobs = docs.select(blob.alias("blob")) if versions is None else versions.select("blob")
    unseen = stage(ledger.unseen(blobs, rules), "unseen")
    n = unseen.count()
    if n:
        texts = docs.select(blob.alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        if n <= BROADCAST_ROWS:
            todo = _first_copies(texts.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")).repartition("blob").join(F.broadcast(unseen), "blob")
        else:
            todo = _first_copies(texts).join(unseen.hint("shuffle_hash"), "blob")
        ledger.append(_run_rules(todo.select("blob", "text", "todo"), rules))
    return unseen


def scan(docs: DataFrame, ledger: Ledger, keys: list[str], rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """A row for each of ``docs``: its ``keys``, blob and spans (start, no, end, kind), after the ledger is brought up to date."""
    versions = stage(docs.select(*keys, address(text).alias("blob")), "versions")
    update(docs, ledger, rules, text, versions)
    found = stage(ledger.findings(rules), "findings")
    none = F.array().cast(found.schema["spans"].dataType)
    return spread_join(versions, found, "blob", "left").select(*keys, "blob", F.coalesce("spans", none).alias("spans"))


def findings(docs: DataFrame, ledger: Ledger, keys: list[str], rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """A row for each secret of each of ``docs``: keys, blob, kind, start, end."""
    return scan(docs, ledger, keys, rules, text).select(*keys, "blob", F.explode("spans").alias("s")).select(*keys, "blob", "s.kind", "s.start", "s.end")


def as_text(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    got = scan(docs, ledger, [id_col], rules, text)
    names = [r.name for r in BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return got.select(id_col, *[count(k) for k in names], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def new_ledger(spark: SparkSession) -> Ledger:
    """An empty ledger in the shared folder, for one run."""
    return Ledger(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as the first snapshot of a new ledger."""
    return digest(parquet(spark, sf_dir, "documents"), new_ledger(spark))


def _sql() -> str:
    """Matches and what stands between them alternate, which gives the places."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts, names = [], [r.name for r in BASE]
    for no, r in enumerate(RULES):
        p = quote(r.pattern)
        parts.append(f"a{no} AS (SELECT t, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS v, regexp_split_to_array(t, {p}) AS g FROM texts)")
        parts.append(f"r{no} AS (SELECT t, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g FROM a{no} WHERE len(m) > 0)")
        parts.append(f"s{no} AS (SELECT t, {no} AS no, '{r.name}' AS kind, v, sum(length(g) + length(m)) OVER (PARTITION BY t ORDER BY i) AS e, length(m) AS n FROM r{no})")
    every = " UNION ALL ".join(f"SELECT t, no, kind, e - n AS b, e FROM s{no} WHERE length(v) >= {r.least}" for no, r in enumerate(RULES))
    among = ", ".join(f"'{n}'" for n in names)
    joined = "string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, no)"
    counts = ", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names)
    own = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in names)
    return f"""WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents), {', '.join(parts)}, f AS ({every}),
x AS (SELECT t, {own}, {joined} FILTER (kind IN ({among})) AS base, {joined} AS spans FROM f GROUP BY t)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN x ON t = coalesce(text, '')"""


OP12_SQL = _sql()
