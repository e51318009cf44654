"""Merkle manifest of a dataset: a tree of digests per source, one over the sources, and an authentication path for every row.

A leaf is the digest of a row's fields. Within a source, leaves ascend by id; every FAN consecutive nodes become one, until one is
left, the subroot; the subroots in the order of their sources become the root in the same way.

Rows get their places by a range exchange on (source, id) and the counts of each partition, so a source of any size is spread. Aligned
blocks of BLOCK = FAN ** HEIGHT leaves are one packed row each. Their roots are the leaves of a tree BLOCK times smaller, to which the
same steps are applied until each tree is one block; so the rounds grow with the logarithm of the rows. Then the blocks are
traversed on their own: for each level a treehash stack takes one leaf per step, so that the siblings of the next run are ready
when the traversal gets there. State is under FAN digests a level and stack, beside the block's own leaves. The siblings above the
block are shared by all its leaves and appended.

Defined results: null fields are ``-``; a null id comes first in its source, a null source before all others; rows that repeat an id
follow one another by their leaves, equal rows in any order; a lone leaf is the subroot and its path is empty; texts of any length
are hashed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.tables import arrow_schema, parquet, runs, small_batches, small_side, spread_join, stage

FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
SIZE = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Paths to block or source roots are broadcast up to so many rows (about 1 KB each).
PATHS = 8_000


def node(children: Sequence[bytes]) -> bytes:
    """H of digests as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


class Treehash:
    """The nodes of one run on ``level`` from the leaves below it, fed one by one; under FAN digests a level are held."""

    __slots__ = ("level", "open")

    def __init__(self, level: int):
        self.level, self.open = level, [[] for _ in range(level + 1)]

    def feed(self, leaf: bytes) -> None:
        self.open[0].append(leaf)
        for h in range(self.level):
            if len(self.open[h]) < FAN:
                return
            self._up(h)

    def _up(self, h: int) -> None:
        self.open[h + 1].append(node(self.open[h]))
        self.open[h] = []

    def close(self) -> list[bytes]:
        """The run; what is not full on lower levels is completed first."""
        for h in range(self.level):
            if self.open[h]:
                self._up(h)
        out, self.open[self.level] = self.open[self.level], []
        return out


def height_of(n: int) -> int:
    """Levels from ``n`` nodes to one."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def climbs(size: int) -> int:
    """Levels that a block climbs in a tree of ``size`` leaves."""
    return HEIGHT if size > BLOCK else height_of(size)


def root_of(leaves: Sequence[bytes], height: int) -> bytes:
    """The node ``height`` levels above the leaves of one block."""
    t = Treehash(height)
    for leaf in leaves:
        t.feed(leaf)
    return t.close()[0]


def traverse(leaves: Sequence[bytes], height: int) -> Iterator[list[list[bytes]]]:
    """For each leaf in turn, its run on each level. Level h is due every FAN ** (h + 1) leaves, and its stack takes a leaf a step."""
    n, stacks = len(leaves), [Treehash(h) for h in range(height)]
    now: list[list[bytes]] = []
    for h, t in enumerate(stacks):
        for leaf in leaves[: FAN ** (h + 1)]:
            t.feed(leaf)
        now.append(t.close())
    for i in range(n):
        for h, t in enumerate(stacks):
            if i and i % FAN ** (h + 1) == 0:
                now[h] = t.close()
        yield now
        for h, t in enumerate(stacks):
            if (ahead := i + FAN ** (h + 1)) < n:
                t.feed(leaves[ahead])


def pack_path(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: for each level the place in the run, the number of siblings, the siblings."""
    return b"".join(bytes((place, len(rest))) + b"".join(rest) for place, rest in steps)


def unpack_path(path: bytes) -> list[tuple[int, list[bytes]]]:
    at, out = 0, []
    while at < len(path):
        place, n = path[at], path[at + 1]
        at += 2
        out.append((place, [path[at + SIZE * k : at + SIZE * (k + 1)] for k in range(n)]))
        at += SIZE * n
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for place, rest in unpack_path(path):
        leaf = node([*rest[:place], leaf, *rest[place:]])
    return leaf


def proofs(leaves: Sequence[bytes], height: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(place, siblings) on each level, for each leaf of a block."""
    for i, now in enumerate(traverse(leaves, height)):
        steps = []
        for h, run in enumerate(now):
            p = i // FAN**h % FAN
            steps.append((p, run[:p] + run[p + 1 :]))
        yield steps


def split(packed: bytes) -> list[bytes]:
    return [packed[k : k + SIZE] for k in range(0, len(packed), SIZE)]


# --- leaves and places


def leaf(fields: list[Column]) -> Column:
    """Digest (binary) of fields: ``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = [f.cast("string") for f in fields]
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[one(c) for c in text]), 256))


def _numbered(rows: DataFrame, tree: str) -> DataFrame:
    """Sorted rows plus _part (the task) and _pos (the row's number within its tree in this task)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _part int, _pos long"
    place, want = rows.columns.index(tree), arrow_schema(schema)
    small_batches(rows.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            pos = []
            for key in b.column(place).to_pylist():
                n = n + 1 if key == last else 0
                last = key
                pos.append(n)
            columns = [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(pos, pa.int64())]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, want)], schema=want)

    return rows.mapInArrow(number, schema)


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` plus idx (place in the tree, from 0) and size (rows of the tree). ``rows`` must be a staged table.

    A range exchange spreads each tree over as many tasks as it needs; equal rows are told apart by their place in the table.
    """
    some = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [tree, *order, "_row"]
    numbered = stage(_numbered(some.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row"), tree), "places")
    counts = numbered.groupBy(tree, "_part").agg((F.max("_pos") + 1).alias("_n"))
    w = Window.partitionBy(tree)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stage(counts.select(tree, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("size")), "counts")
    return numbered.join(small_side(counts), [tree, "_part"]).withColumn("idx", F.col("_pos") + F.col("_before")).drop("_part", "_pos", "_before")


# --- blocks


PACKED = "tree string, block long, size long, ids array<bigint>, leaves binary, others binary, root binary"


def pack(nodes: DataFrame) -> DataFrame:
    """A row for each aligned block of ``nodes`` (tree, idx, size, id, leaf, other), with the block's root.

    ``others`` has for each leaf the digest that is to be verified in its place.
    """
    schema = arrow_schema(PACKED)
    block = F.floor(F.col("idx") / BLOCK).cast("long")
    rows = nodes.select(F.struct("tree", block.alias("block")).alias("at"), "tree", block.alias("block"), "idx", "size", "id", "leaf", F.coalesce("other", "leaf").alias("other"))
    small_batches(nodes.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            tree, number, size = run[0][1], run[0][2], run[0][4]
            leaves = [r[6] for r in run]
            row = [tree, number, size, [r[5] for r in run], b"".join(leaves), b"".join(r[7] for r in run), root_of(leaves, climbs(size))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(make, PACKED)


def _paths_in(rows: DataFrame) -> DataFrame:
    """(tree, idx, path, top) of the leaves of blocks with path and top."""
    out = arrow_schema("tree string, idx long, path binary, top binary")
    small_batches(rows.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, block, size, leaves, path, top in zip(*(c.to_pylist() for c in b.columns)):
                got = [pack_path(steps) + path for steps in proofs(split(leaves), climbs(size))]
                n = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64()), pa.array(got, pa.binary()), pa.array([top] * n, pa.binary())], schema=out)

    return rows.select("tree", "block", "size", "leaves", "path", "top").mapInArrow(make, "tree string, idx long, path binary, top binary")


def with_upper(packed: DataFrame) -> DataFrame:
    """``packed`` (staged) plus path (from the block's root to the tree's) and top (the tree's root)."""
    many = packed.where(F.col("size") > BLOCK)
    if many.isEmpty():
        return packed.withColumns({"path": F.lit(b""), "top": F.col("root")})
    nodes = many.select("tree", F.col("block").alias("idx"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("other"))
    up = stage(_paths_in(with_upper(stage(pack(nodes), "blocks"))), "paths")
    up = up.withColumnRenamed("idx", "block")
    up = F.broadcast(up) if up.count() <= PATHS else up
    joined = packed.join(up, ["tree", "block"], "left")
    return joined.withColumns({"path": F.coalesce("path", F.lit(b"")), "top": F.coalesce("top", "root")})


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with their paths to their tree's root, and (tree, size, subroot, path, root) for each tree.

    ``leaves``: a staged table (tree, id, leaf, other); ``tree`` is not null, trees are ordered by its bytes.
    """
    blocks = stage(with_upper(stage(pack(placed(leaves, "tree", ["id", "leaf"])), "blocks")), "blocks")
    trees = stage(blocks.where("block = 0").select(F.lit("").alias("all"), "tree", F.col("size").alias("n"), F.col("top").alias("subroot")), "trees")
    order = stage(placed(trees, "all", ["tree"]), "trees")
    nodes = order.select(F.col("all").alias("tree"), "idx", "size", F.lit(None).cast("long").alias("id"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("other"))
    up = _paths_in(with_upper(stage(pack(nodes), "blocks"))).select("idx", "path", F.col("top").alias("root"))
    return blocks, stage(order.join(up, "idx").select("tree", F.col("n").alias("size"), "subroot", "path", "root"), "trees")


AUDIT = "id bigint, tree string, leaf binary, subroot binary, root binary, proof binary, folded binary, path binary"


def authenticate(blocks: DataFrame, trees: DataFrame, paths: bool = False) -> DataFrame:
    """A row for each leaf: its path's digest and the root that its ``other`` digest and its path give.

    ``paths``: return the whole path as well (``fold`` checks one), else null.
    """
    up = trees.select("tree", "subroot", F.col("path").alias("above"), F.col("root").alias("whole"))
    both = spread_join(blocks, up, "tree", small=PATHS)
    schema = arrow_schema(AUDIT)
    small_batches(blocks.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, size, ids, packed, others, own, path, subroot, above, whole in zip(*(c.to_pylist() for c in b.columns)):
                leaves, other, upper = split(packed), split(others), path + above
                tail = b"".join(b"".join(rest) for _, rest in unpack_path(upper)).hex().encode()
                beyond = {own: fold(own, upper)}
                rows: list[list] = [[], [], []]
                for i, steps in enumerate(proofs(leaves, climbs(size))):
                    rows[0].append(hashlib.sha256(b"".join(s for _, rest in steps for s in rest).hex().encode() + tail).digest())
                    d = other[i]
                    for place, rest in steps:
                        d = node([*rest[:place], d, *rest[place:]])
                    rows[1].append(beyond[d] if d in beyond else fold(d, upper))
                    rows[2].append(pack_path(steps) + upper if paths else None)
                n = len(ids)
                columns = [ids, [tree] * n, leaves, [subroot] * n, [whole] * n, *rows]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    return both.select("tree", "size", "ids", "leaves", "others", F.col("root").alias("own"), "path", "subroot", "above", "whole").mapInArrow(make, AUDIT)


def audit(rows: DataFrame, now: dict[str, Column] | None = None, when: Column | None = None, id_col: str = "doc_id", group: str = "source", fields: list[str] = FIELDS, paths: bool = False) -> DataFrame:
    """The manifest of ``rows`` and, for each row, whether its present content verifies.

    ``now``: the present value of fields that may differ from those in the manifest, where ``when`` holds (default: everywhere).
    """
    given = [F.col(c) for c in fields]
    other = F.lit(None).cast("binary")
    if now:
        other = F.when(F.lit(True) if when is None else when, leaf([now.get(c, F.col(c)) for c in fields]))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stage(rows.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf(given).alias("leaf"), other.alias("other")), "leaves")
    got = authenticate(*build(leaves), paths=paths)
    text = lambda c: F.lower(F.hex(c))
    out = got.select(F.col("id").alias(id_col), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"), "path")
    return out if paths else out.drop("path")


def manifest(rows: DataFrame, id_col: str = "doc_id", group: str = "source", fields: list[str] = FIELDS) -> DataFrame:
    """A row for each source: its rows, its subroot and the root of the dataset."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stage(rows.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf([F.col(c) for c in fields]).alias("leaf"), F.lit(None).cast("binary").alias("other")), "leaves")
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return build(leaves)[1].select(source.alias(group), "size", F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row, by the CRC of its id, has lost its capitals."""
    return audit(parquet(spark, sf_dir, "documents"), {"text": F.translate("text", UPPER, LOWER)}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def _sql(levels: int = 6) -> str:
    """The trees, level by level; ``levels`` are enough for FAN ** levels rows a source and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    digest = lambda cs: f"sha256({' || '.join(field(c) for c in cs)})"
    # CRC-32 of the id's digits: the table of 256 entries by its rule, then a byte at a time
    parts = ["b0 AS (SELECT k, k AS v FROM range(256) r(k))"]
    parts += [f"b{k + 1} AS (SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM b{k})" for k in range(8)]
    parts.append("c0 AS (SELECT DISTINCT doc_id AS id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL)")
    for k in range(20):
        at = f"CASE WHEN length(s) > {k} THEN xor(c % 256, ascii(substr(s, {k + 1}, 1))::BIGINT) ELSE 0 END"
        parts.append(f"c{k + 1} AS (SELECT id, s, CASE WHEN length(s) > {k} THEN xor(c // 256, v) ELSE c END AS c FROM c{k} JOIN b8 ON k = {at})")
    now = digest([*FIELDS[:-1], f"translate(text, '{UPPER}', '{LOWER}')"])
    parts.append(f"d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {digest(FIELDS)} AS leaf, CASE WHEN xor(c, 4294967295) % 5 = 0 THEN {now} ELSE {digest(FIELDS)} END AS x FROM documents LEFT JOIN c20 ON id = doc_id)")
    parts.append("l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS path FROM d)")

    def tree(t: str, start: str) -> None:
        for k in range(levels + 1):
            run = "(PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(f"{t}{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS z, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS p, coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS q FROM ({start}))")
            start = f"SELECT g, i // 16 AS i, CASE WHEN max(z) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {t}{k} GROUP BY g, i // 16"

    def climb(t: str, u: str, start: str) -> None:
        for k in range(levels):
            parts.append(f"{u}{k} AS (SELECT a.doc_id, a.g, a.i, a.leaf, a.path || p || q AS path, CASE WHEN z = 1 THEN a.x ELSE sha256(p || a.x || q) END AS x FROM ({start}) a JOIN {t}{k} b ON b.g = a.g AND b.i = a.i // {FAN**k})")
            start = f"SELECT * FROM {u}{k}"

    tree("n", "SELECT g, i, leaf AS h FROM l")
    climb("n", "u", "SELECT * FROM l")
    parts.append(f"s AS (SELECT g AS tree, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM n{levels})")
    tree("m", "SELECT '' AS g, j AS i, subroot AS h FROM s")
    parts.append(f"e AS (SELECT doc_id, '' AS g, j AS i, leaf || subroot AS leaf, path, x FROM u{levels - 1} JOIN s ON tree = g)")
    climb("m", "v", "SELECT * FROM e")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf[1:64] AS leaf, leaf[65:128] AS subroot, h AS root, sha256(path) AS proof_sha256, x AS folded_root, x = h AS verified FROM v{levels - 1}, m{levels}"


OP11_SQL = _sql()
