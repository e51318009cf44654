"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels whose score lies in
a window below that of the positive.

Candidates are sorted by norm with a range exchange and packed into buckets of rows of about the same norm. Anchors come in groups,
buckets are dealt to parts, and each pair of a group and a part is a cell, which one task works on: it holds the anchors and streams
the buckets, largest norms first. By Cauchy-Schwarz no row of a bucket scores more than the anchor's norm times the bucket's largest
norm. An anchor for which that is below what its windows still want (a window's lower limit, or the score of its kth row so far)
sits the bucket out, and a bucket that all sit out is not multiplied. Scores are matrix products, exact in integers. The best rows of
the cells are then merged. So the work is anchors times rows, less what the bounds prune, and nothing depends on the size of a label.

Defined results: rows with a null id, label, vector or component, or a component that is not finite, take no part; a row that
repeats another in id, label and components counts once; rows of the anchor's own id are not its positives or negatives; vectors
of different lengths are compared as if the shorter one had zeros; an anchor without positives, and a positive without negatives,
have no rows; ties go to the smaller id; an empty table gives an empty result; other columns are ignored. Scores have to fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.tables import arrow_schema, parquet, small_batches, stage

POSITIVES, NEGATIVES = 5, 3
#: A negative scores from LOW to HIGH hundredths of the positive.
LOW, HIGH = 50, 95
#: Rows of a bucket, anchors of a group (about), buckets of a part, and the fewest parts if there are as many buckets.
BUCKET, GROUP, PART, PARTS = 512, 2048, 64, 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, vec, norm) of the rows that take part; components become floor(scale * x)."""
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec")).dropna()
    good = some.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = good.select("id", "label", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec")).dropDuplicates(["id", "label", "vec"])
    return whole.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))))


# --- buckets


BUCKETS = "part int, seq int, dim int, norm double, ids binary, labels binary, vecs binary"


def buckets(rows: DataFrame) -> DataFrame:
    """Rows of one vector length, packed in the order of their norms, largest first; ``norm`` is the bucket's largest."""
    keys = [F.size("vec"), F.desc("norm"), F.col("id")]
    some = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "label", "vec", "norm")
    schema = arrow_schema(BUCKETS)
    small_batches(rows.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            vecs = np.array([r[2] for r in held], np.int64).reshape(len(held), -1)
            row = [part, seq, vecs.shape[1], held[0][3], *(np.array([r[k] for r in held], np.int64).tobytes() for k in (0, 1)), vecs.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (len(row[2]) != len(held[0][2]) or len(held) >= max(1, min(BUCKET, (1 << 22) // (8 * max(1, len(row[2])))))):
                    yield flush()
                    seq, held = seq + 1, []
                held.append(row)
        if held:
            yield flush()

    return some.mapInArrow(make, BUCKETS)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


# --- what a cell does


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, as integers; in floating point where that is exact."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    top = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0.0))
    if dim * top(a) * top(b) < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


class Best:
    """The best ``k`` (score, id) of each of ``n`` lists: highest scores first, then least ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), LEAST), np.zeros((n, k), np.int64)
        self.size = np.zeros(n, np.int64)

    def wanted(self) -> np.ndarray:
        """The least score that could still enter each list."""
        return np.where(self.size == self.k, self.score[:, -1], LEAST)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        rows, cols = np.nonzero(np.arange(self.k) < self.size[touched, None])
        lists = np.concatenate([touched[rows], lists])
        score, ids = np.concatenate([self.score[touched][rows, cols], score]), np.concatenate([self.id[touched][rows, cols], ids])
        order = np.lexsort((ids, -score.astype(np.float64), lists)) if np.abs(score.astype(np.float64)).max() < 2.0**53 else np.lexsort((ids, ~score, lists))
        lists, score, ids = lists[order], score[order], ids[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1])
        place = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        keep = place < self.k
        self.score[lists[keep], place[keep]], self.id[lists[keep], place[keep]] = score[keep], ids[keep]
        self.size[touched] = np.minimum(self.k, np.diff(np.append(first, len(lists))))


class Cell:
    """Anchors with their windows, and what has been found for them so far.

    ``low`` and ``high``: (anchors, windows) limits; an empty window has low > high. ``same``: rows of the anchor's label, or of others.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.vecs, self.low, self.high, self.same = ids, labels, vecs, low, high, same
        self.norm = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
        self.windows = low.shape[1]
        self.best = Best(len(ids) * self.windows, k)
        self.seen = self.skipped = 0

    def limits(self) -> np.ndarray:
        """What a row must score at least to enter each window."""
        return np.maximum(self.low, self.best.wanted().reshape(self.low.shape))

    def alive(self, norm: float) -> np.ndarray:
        """Anchors that a bucket of this largest norm could still serve."""
        reach = self.norm * norm * (1 + 1e-9) + 1e-6
        return np.flatnonzero(((self.limits() <= reach[:, None]) & (self.low <= self.high)).any(axis=1))

    def meet(self, norm: float, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        self.seen += 1
        a = self.alive(norm)
        if not len(a):
            self.skipped += 1
            return
        score = product(self.vecs[a], vecs)
        fit = ((self.labels[a, None] == labels[None, :]) == self.same) & (self.ids[a, None] != ids[None, :])
        for w in range(self.windows):
            floor = self.limits()[a, w]
            rows, cols = np.nonzero(fit & (score >= floor[:, None]) & (score <= self.high[a, w][:, None]))
            self.best.add(a[rows] * self.windows + w, score[rows, cols], ids[cols])


# --- search


FOUND = "a bigint, slot int, id bigint, score bigint"


def search(anchors: DataFrame, cands: DataFrame, n_anchors: int, n_buckets: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows of each window of each anchor: (a, slot, id, score, rank).

    ``anchors``: (a, id, label, vec, low, high), the last two arrays of one length for all; ``cands``: buckets. Both staged.
    """
    groups = max(1, -(-n_anchors // GROUP))
    parts = max(1, min(n_buckets, max(PARTS, -(-n_buckets // PART))))
    cell = lambda g, p: (g * parts + p).alias("cell")
    left = anchors.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(groups))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = left.select(cell(F.col("g"), F.col("p")), F.lit(0).alias("kind"), F.lit(0.0).alias("order"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("labels"), F.lit(None).cast("binary").alias("vecs"), "a", "id", "label", "vec", "low", "high")
    dealt = cands.withColumn("p", F.pmod(F.col("part") + F.col("seq"), F.lit(parts))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = dealt.select(cell(F.col("g").cast("long"), F.col("p")), F.lit(1).alias("kind"), (-F.col("norm")).alias("order"), "ids", "labels", "vecs", *[F.lit(None).cast(t).alias(c) for c, t in anchors.select("a", "id", "label", "vec", "low", "high").dtypes])
    both = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "kind", "order")
    schema = arrow_schema(FOUND)
    small_batches(anchors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None

        def begin() -> Cell:
            dim = max(len(r[2]) for r in held)
            vecs = np.zeros((len(held), dim), np.int64)
            for i, r in enumerate(held):
                vecs[i, : len(r[2])] = r[2]
            shape = (len(held), -1)
            return Cell(np.array([r[0] for r in held]), np.array([r[1] for r in held]), vecs, np.array([r[3] for r in held], np.int64).reshape(shape), np.array([r[4] for r in held], np.int64).reshape(shape), same, k)

        def end() -> pa.RecordBatch:
            best = state.best
            rows, cols = np.nonzero(np.arange(k) < best.size[:, None])
            name = np.array([r[5] for r in held], np.int64)
            got = [name[rows // state.windows], (rows % state.windows).astype(np.int32), best.id[rows, cols], best.score[rows, cols]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(got, schema)], schema=schema)

        for b in batches:
            for c, kind, order, ids, labels, vecs, a, i, label, vec, low, high in zip(*(x.to_pylist() for x in b.columns)):
                if c != at:
                    if state is not None:
                        yield end()
                    at, held, state = c, [], None
                if kind == 0:
                    held.append((i, label, vec, low, high, a))
                elif held:
                    state = state or begin()
                    n = len(ids) // 8
                    state.meet(-order, longs(ids), longs(labels), longs(vecs).reshape(n, -1))
        if state is not None:
            yield end()

    w = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return both.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: F.Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows of ``rows`` (id, label, vec, norm; see ``usable``) for which ``anchor`` holds."""
    rows = stage(rows, "vectors")
    cands = stage(buckets(rows), "buckets")
    anchors = stage(rows.where(anchor).select(F.monotonically_increasing_id().alias("a"), "id", "label", "vec"), "anchors")
    n, m = anchors.count(), cands.count()
    every = lambda x: F.array(F.lit(x).cast("long"))
    near = stage(search(anchors.withColumns({"low": every(LEAST), "high": every(MOST)}), cands, n, m, True, positives), "positives")
    # a window for each positive; missing ones are empty
    lists = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("pos"))
    score = lambda s: s["score"].cast("decimal(38,0)")
    slots = F.sequence(F.lit(0), F.lit(positives - 1))
    limit = lambda f, none: F.transform(slots, lambda i: F.coalesce(f(F.get("pos", i)).cast("long"), F.lit(none)))
    wide = stage(anchors.join(lists, "a").withColumns({"low": limit(lambda s: F.ceil(score(s) * low / 100), 1), "high": limit(lambda s: F.floor(score(s) * high / 100), 0)}), "windows")
    found = search(wide, cands, n, m, False, negatives)
    named = found.join(wide.select("a", F.col("id").alias("anchor_id"), "pos"), "a").withColumn("p", F.get("pos", F.col("slot")))
    return named.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id 50 divides; where 7 divides it the label is another."""
    table = parquet(spark, sf_dir, "embeddings")
    noisy = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(usable(noisy), F.col("id") % 50 == 0)


OP13_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT::DOUBLE FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""
