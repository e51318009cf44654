"""Near-duplicate machinery: candidates by MinHash bands, exact verification by blocks, classes by union-find.

* ``packed_stars`` and ``band_edges``: nodes that share a band key become a star around the least of them. Stars are first
  built within each map task, so a hot key reaches the shuffle with one entry per flush, not one per node; entries travel as
  packed arrays, one row per task and bucket of keys.
* ``verified``: every two nodes of a candidate component whose set sizes allow the threshold are compared by the exact
  intersection of their shingle sets. A small component is one unit of work. The nodes of a larger one are dealt by size class
  (sets whose sizes differ by more than the threshold allows never meet) and hash into blocks of bounded rows and bytes; a
  block is packed into one row, and each pair of blocks of equal or neighbouring classes is a unit. A unit gives one row per node
  (its links) and a spanning edge, never all pairs; units cover all pairs that can be links, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.tables import arrow_map, arrow_schema, runs, small_batches, small_side, stage

#: (band key, node) entries that a map task sorts at once, and that a bucket of keys should hold at most.
FLUSH, BUCKET = 600_000, 1_000_000
#: Most partitions of the exchange by bucket; a task works through its buckets one after the other.
PARTITIONS = 20_000
#: Nodes and characters of a component that is verified in one go, and rows whose sets are made at once.
UNIT_ROWS, UNIT_CHARS, ROWS_AT_ONCE = 64, 100_000, 512
#: Least items (elements of sets) of a block.
UNIT_ITEMS = 20_000
#: Blocks that a larger component is cut into about, so that its units spread over many tasks; most nodes and items of a block.
BLOCKS, BLOCK_ROWS, BLOCK_ITEMS = 32, 1024, 500_000


_PACKED = pa.schema([("bucket", pa.int32()), ("edges", pa.bool_()), ("a", pa.binary()), ("b", pa.binary())])


def _star(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and the least node of each, and for the other nodes (node, least of its key) as edges."""
    turn = np.argsort(key, kind="stable")
    key, node = key[turn], node[turn]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = np.minimum.reduceat(node, head)
    least = np.repeat(first, np.diff(head, append=len(key)))
    other = node != least
    edges = np.stack([node[other], least[other]])
    return key[head], first, np.unique(edges, axis=1) if edges.size else edges


def packed_stars(rows: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """From (keys, nodes) of a task's batches: for each bucket of keys one row of packed (key, least node) arrays, and one
    row of packed local edges. A hot key leaves a task with one entry per flush."""
    keys: list[np.ndarray] = []
    nodes: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        k, n, edges = _star(np.concatenate(keys), np.concatenate(nodes))
        bucket = ((k.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        turn = np.argsort(bucket, kind="stable")
        k, n, bucket = k[turn], n[turn], bucket[turn]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        spans = list(zip(at, [*at[1:], len(k)]))
        ids, a, b = bucket[at].tolist(), [k[i:j].tobytes() for i, j in spans], [n[i:j].tobytes() for i, j in spans]
        if edges.size:
            ids, a, b = [*ids, int(edges[0, 0] % buckets)], [*a, edges[0].tobytes()], [*b, edges[1].tobytes()]
        return pa.RecordBatch.from_pydict({"bucket": ids, "edges": [False] * len(spans) + [True] * (len(ids) - len(spans)), "a": a, "b": b}, schema=_PACKED)

    for k, n in rows:
        keys.append(k)
        nodes.append(n)
        if sum(map(len, keys)) >= FLUSH:
            yield flush()
            keys.clear()
            nodes.clear()
    if keys:
        yield flush()


def bucket_count(spark, entries: int) -> int:
    """Buckets of keys: at least the shuffle partitions, and enough for BUCKET entries each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET))


def band_edges(bands: DataFrame, buckets: int) -> DataFrame:
    """Candidate edges (a, b) from rows of ``packed_stars``: one exchange by bucket, then a star around each key's least node."""

    def star(batches):
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        last = None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for bucket, edges, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                if edges:
                    yield out(a, b)
                    continue
                if bucket != last and keys:
                    yield out(*_star(np.concatenate(keys), np.concatenate(nodes))[2])
                    keys, nodes = [], []
                last = bucket
                keys.append(a)
                nodes.append(b)
        if keys:
            yield out(*_star(np.concatenate(keys), np.concatenate(nodes))[2])

    small_batches(bands.sparkSession)
    return bands.repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(star, "a long, b long").distinct()


def links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of similar sets: left[i] and right[j], or all pairs i < j of ``left`` if there is no ``right``.

    Each set is an array of different hashes. Intersections are counted exactly, slab by slab of the vocabulary.
    """
    sets = left + (right or [])
    size = np.array([len(s) for s in sets], np.int64)
    n, cut = len(sets), len(left)
    none = np.zeros(0, np.int64)
    if n == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        hit = np.array([0] if k and k >= threshold * (size.sum() - k) - 1e-6 else [], np.int64)
        return hit, hit + (right is None)
    if n < 2 or not size.sum():
        return none, none
    item, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    turn = np.argsort(item, kind="stable")
    item, owner = item[turn], owner[turn]
    number = np.cumsum(np.concatenate([[True], item[1:] != item[:-1]])) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    owner, number = owner[keep], (np.cumsum(shared) - 1)[number[keep]]
    common = np.zeros((cut, n - cut if right is not None else n), np.float32)
    total, step = int(shared.sum()), 4096
    for low in range(0, total, step):
        a, b = np.searchsorted(number, [low, low + step])
        m = np.zeros((n, min(step, total - low)), np.float32)
        m[owner[a:b], number[a:b] - low] = 1
        common += m[:cut] @ (m[cut:] if right is not None else m).T
    other = size[cut:] if right is not None else size
    union = size[:cut, None] + other[None, :] - common
    ok = (common >= threshold * union - 1e-6) & (common > 0)
    return np.nonzero(ok if right is not None else np.triu(ok, 1))


def _unite(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root of each of n items after joining pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root != root[root]).any():
            root = root[root]
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


class Sets:
    """How sets of shingles travel: ``encode`` gives a payload and the set's size for each text, ``decode`` the sets again."""

    def __init__(self, of: Callable[[pa.Array], list[np.ndarray]], as_text: bool = False):
        self.of, self.as_text = of, as_text

    def encode(self, texts: pa.Array) -> tuple[list, list[int]]:
        sets = self.of(texts)
        return texts.cast(pa.binary()).to_pylist() if self.as_text else [x.tobytes() for x in sets], [len(x) for x in sets]

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        return self.of(pa.array(payloads, pa.binary()).cast(pa.string())) if self.as_text else [np.frombuffer(x, np.uint64) for x in payloads]


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _rows_of(node: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(node, links, root) of the nodes that the pairs (i, j) join."""
    count = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
    root = _unite(len(node), i, j)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    hit = count > 0
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(count[hit].astype(np.int64)), pa.array(least[root][hit])], schema=_FOUND)


def verified(members: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """(node, links, root) for every node of ``members`` (comp, node, weight, text) with links, and each unit that holds it.

    links: weights of the similar nodes that the unit found; root: the least node that it is joined to in the unit.
    """
    members = stage(members.select("comp", "node", "weight", "text"), "members")
    # rows of one node are equal; a component of one node has no pairs
    need = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    large = stage(need.where((F.col("n") > UNIT_ROWS) | (F.col("chars") > UNIT_CHARS)).select("comp"), "large")
    n_large = large.count()
    if not n_large:
        return _whole(members, sets, threshold)
    side = small_side(large, n_large)
    small = _whole(members.join(side, "comp", "left_anti"), sets, threshold)
    # sizes whose quotient reaches the threshold are in the same class or in neighbouring ones
    width = -np.log(threshold) * (1 + 1e-9)

    def encode(batch: pa.RecordBatch) -> dict:
        payload, size = sets.encode(batch.column(3).cast(pa.string()))
        return {"comp": batch.column(0), "node": batch.column(1), "weight": batch.column(2), "size": size, "payload": payload}

    coded = arrow_map(members.join(side, "comp", "left_semi").select("comp", "node", "weight", "text"), encode, "comp long, node long, weight long, size int, payload binary")
    classed = coded.withColumn("cls", F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(float(width))).cast("int"))
    return small.unionByName(_by_blocks(stage(classed, "classed"), sets, threshold))


def _whole(members: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """``verified`` of components that are one unit each; sets are made for many components at once."""

    def verify(units: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        made = sets.of(pa.array([r[3] for u in units for r in u], pa.string()))
        at, out = 0, []
        for unit in units:
            own = made[at : at + len(unit)]
            at += len(unit)
            i, j = links(own, None, threshold)
            if len(i):
                out.append(_rows_of(np.array([r[1] for r in unit]), np.array([r[2] for r in unit]), i, j))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    def run(batches):
        held: list[list[tuple]] = []
        n = size = 0
        for rows in runs(batches):
            unit = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
            if len(unit) > 1:
                held.append(unit)
                n, size = n + len(unit), size + sum(len(r[3]) for r in unit)
            if n >= ROWS_AT_ONCE or size >= UNIT_CHARS:
                yield from verify(held)
                held, n, size = [], 0, 0
        if held:
            yield from verify(held)

    small_batches(members.sparkSession)
    rows = members.repartition("comp").sortWithinPartitions("comp")
    return rows.mapInArrow(run, "node long, links long, root long")


_BLOCK = "comp long, cls int, block int, node binary, weight binary, size binary, payload binary"


def _by_blocks(classed: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """``verified`` of large components, block against block."""
    spark = classed.sparkSession
    totals = classed.groupBy("comp").agg(F.count("*").alias("total"), F.sum(F.col("size").cast("long")).alias("all_items"))
    per_class = classed.groupBy("comp", "cls").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("items")).join(totals, "comp")
    # about BLOCKS blocks a component, more where blocks would hold too many nodes or items
    rows = F.greatest(F.lit(UNIT_ROWS // 2), F.least(F.lit(BLOCK_ROWS), F.ceil(F.col("total") / BLOCKS)))
    items = F.greatest(F.lit(UNIT_ITEMS // 2), F.least(F.lit(BLOCK_ITEMS), F.ceil(F.col("all_items") / BLOCKS)))
    per_class = stage(per_class.select("comp", "cls", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("items") / items), F.lit(1)).cast("int").alias("blocks")), "classes")
    n = per_class.count()
    placed = classed.join(small_side(per_class, n), ["comp", "cls"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    want = arrow_schema(_BLOCK)

    def pack(batches):
        # rows are sorted by a hash of their block, its name and their nodes; equal nodes are one
        for same in runs(batches):
            blocks: dict[tuple, dict] = {}
            for r in same:
                blocks.setdefault(r[1:4], {})[r[4]] = r
            for (comp, cls, block), held in blocks.items():
                got = [held[x] for x in sorted(held)]
                arrays = [np.array([r[k] for r in got], t).tobytes() for k, t in ((4, np.int64), (5, np.int64))]
                size = np.array([len(r[6]) for r in got], np.int64).tobytes()
                yield pa.RecordBatch.from_pydict({"comp": [comp], "cls": [cls], "block": [block], "node": [arrays[0]], "weight": [arrays[1]], "size": [size], "payload": [b"".join(r[6] for r in got)]}, schema=want)

    small_batches(spark)
    key = F.xxhash64("comp", "cls", "block").alias("key")
    dealt = placed.select(key, "comp", "cls", "block", "node", "weight", "payload").repartition("key").sortWithinPartitions("key")
    packed = stage(dealt.mapInArrow(pack, _BLOCK), "blocks")
    # partners: the blocks of the same class and of the classes next to it
    near = per_class.select(F.col("comp").alias("_comp"), F.col("cls").alias("_cls"), F.col("blocks").alias("_blocks"))
    meets = packed.join(small_side(near, n), (F.col("comp") == F.col("_comp")) & F.col("_cls").isin(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1))
    meets = meets.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    mine, other = F.struct("cls", "block"), F.struct(F.col("_cls").alias("cls"), F.col("_block").alias("block"))
    pair = F.struct(F.least(mine, other).alias("lo"), F.greatest(mine, other).alias("hi"))
    units = meets.select("comp", pair.alias("pair"), (mine == F.least(mine, other)).alias("first"), "node", "weight", "size", "payload")
    units = units.select(F.xxhash64("comp", "pair").alias("unit"), "comp", F.col("pair.lo.cls").alias("a"), F.col("pair.lo.block").alias("b"), F.col("pair.hi.cls").alias("c"), F.col("pair.hi.block").alias("d"), "first", "node", "weight", "size", "payload")

    def run(batches):
        for same in runs(batches):
            parts: dict[tuple, list] = {}
            for r in same:
                parts.setdefault(r[1:6], []).append(r)
            for unit in parts.values():
                unit.sort(key=lambda r: not r[6])
                node, weight = (np.concatenate([np.frombuffer(r[k], np.int64) for r in unit]) for k in (7, 8))
                got = []
                for r in unit:
                    ends = np.cumsum(np.frombuffer(r[9], np.int64)).tolist()
                    got.append(sets.decode([r[10][x:y] for x, y in zip([0, *ends], ends)]))
                i, j = links(got[0], got[1] if len(got) > 1 else None, threshold)
                if len(i):
                    yield _rows_of(node, weight, i, j + (len(got[0]) if len(got) > 1 else 0))

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "node long, links long, root long")


def classes(found: DataFrame) -> DataFrame:
    """(node, comp) of the verified links."""
    return components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
