"""A stored vector index of inverted lists: probed for a given recall, or exact by bounds.

Centroids are fitted to a sample of at most SAMPLE vectors (spherical k-means); every vector is put into the list of its nearest
centroid, in packed blocks, so that a list of very many vectors is many blocks. How many lists a query probes is
measured: the least number by which the sample's own queries find TARGET of their true nearest. What a probe finds is scored exactly.

The exact mode goes on where the probes end. No vector of a list is farther from its centroid than the list's radius (an angle), so
none is nearer to a query than its angle to the centroid less the radius. Lists whose bound reaches the k-th score that
the probes found are read as well, and no others.

Defined results: null vectors are left out; a zero vector has score 0 with everything; ties go to the smaller id; an empty
index gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import BLOCK, _best, _matrix, _unpack, top_k
from quern.session import stage

#: Vectors that centroids are fitted to, rounds of fitting, vectors of a block, the most lists; the wanted share of true neighbours.
SAMPLE, ROUNDS, PACK, LISTS, TARGET = 20_000, 8, 1024, 4096, 0.95
_HITS = "query_id long, id long, score double"


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = nearest(sample, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        # an empty list keeps its centroid
        c = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[k : k + 4096] @ centroids.T, axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, int)])


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, queries: int = 256, seed: int = 2) -> int:
    """The least number of lists in which ``queries`` vectors of the sample have ``target`` of their k nearest others."""
    if len(sample) <= 1:
        return len(centroids)
    q = np.random.default_rng(seed).choice(len(sample), min(queries, len(sample)), replace=False)
    scores = sample[q] @ sample.T
    scores[np.arange(len(q)), q] = -2
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    order = np.argsort(np.argsort(-(sample[q] @ centroids.T), axis=1), axis=1)
    place = order[np.arange(len(q))[:, None], nearest(sample, centroids)[best]]
    share = (place[:, :, None] < np.arange(1, len(centroids) + 1)).mean(axis=(0, 1))
    return int(np.searchsorted(share, min(target, share[-1])) + 1)


class VectorIndex:
    """The index below ``path``: blocks (list, part, ids, data) and lists (list, centroid, n, radius)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._lists: tuple | None = None

    def build(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Write the index of ``vectors`` (id, vec)."""
        rows = stage(vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null and id is not null"), "vectors")
        n = rows.count()
        some = [r[0] for r in rows.orderBy(F.xxhash64("id", F.lit(7))).limit(sample).select("vec").collect()] if n else []
        unit = _matrix(some) if some else np.zeros((0, 1))
        centroids = fit(unit, min(LISTS, lists or max(1, int(np.sqrt(n))))) if n else np.zeros((0, 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1).to_pylist()) if b.num_rows else np.zeros((0, centroids.shape[1]))
                own = nearest(x, centroids)
                near = np.einsum("ij,ij->i", x, centroids[own]) if len(own) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), b.column(1), pa.array(near)], names=["list", "id", "vec", "near"])

        dealt = stage(rows.mapInArrow(assign, "list int, id long, vec array<double>, near double"), "lists")
        sizes = {r["list"]: (r.n, r.near) for r in dealt.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()}
        parts = F.create_map(*[x for i, (m, _) in sizes.items() for x in (F.lit(i), F.lit(-(-m // PACK)))]) if sizes else F.lit(None)
        if sizes:
            part = F.pmod(F.xxhash64("id"), parts[F.col("list")]).cast("int").alias("part")
            packed = dealt.select("list", part, "id", "vec").repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(_pack, "list int, part int, ids binary, data binary")
            # a task holds whole lists in order, so that readers skip files and row groups by list
            packed.repartitionByRange("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{self.path}/blocks")
        table = [(int(i), [float(x) for x in centroids[i]], int(m), float(np.arccos(np.clip(near, -1, 1)))) for i, (m, near) in sorted(sizes.items())]
        probes = probes_for(unit, centroids, 20, TARGET) if n else 0
        self.spark.createDataFrame([(*r, probes) for r in table], "list int, centroid array<double>, n long, radius double, probes int").coalesce(1).write.parquet(f"{self.path}/lists")
        return self

    def _load(self) -> tuple:
        """Lists (at most LISTS): numbers, centroids, radii, and how many to probe."""
        if self._lists is None:
            rows = self.spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()
            self._lists = ([r["list"] for r in rows], np.array([r.centroid for r in rows]), np.array([r.radius for r in rows]), rows[0].probes if rows else 0)
        return self._lists

    def _pairs(self, queries: DataFrame, probes: int, floor: DataFrame | None = None) -> DataFrame:
        """(list, pack, qi, qd): queries packed for each list that they read. ``floor`` (query_id, floor): beyond the probes, the lists
        whose bound reaches it (all, if it is null)."""
        numbers, centroids, radii, _ = self._load()
        rows = queries if floor is None else queries.join(floor, "query_id", "left")
        bounded = floor is not None
        columns = ["query_id", "vec"] + ["floor"] * bounded
        packs = max(1, -(-queries.count() // BLOCK))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1).to_pylist())
                cos = np.clip(x @ centroids.T, -1, 1)
                rank = np.argsort(np.argsort(-cos, axis=1, kind="stable"), axis=1, kind="stable")
                take = rank < probes
                if bounded:
                    least = np.array([-2.0 if f is None else f for f in b.column(2).to_pylist()])
                    bound = np.cos(np.maximum(np.arccos(cos) - radii, 0.0))
                    bound[~x.any(axis=1)] = 0.0
                    take = ~take & (bound + 2e-6 >= least[:, None])
                q, at = np.nonzero(take)
                ids, vecs = b.column(0), b.column(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int32)[at]), ids.take(pa.array(q)), vecs.take(pa.array(q))], names=["list", "id", "vec"])

        chosen = rows.select(*columns).mapInArrow(choose, "list int, id long, vec array<double>")
        pack = F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("part")
        return chosen.select("list", pack, "id", "vec").repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(_pack, "list int, part int, ids binary, data binary").select("list", F.col("ids").alias("qi"), F.col("data").alias("qd"))

    def _score(self, pairs: DataFrame, k: int) -> DataFrame:
        blocks = self.spark.read.parquet(f"{self.path}/blocks").select("list", "ids", "data")

        def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for qi, qd, vi, vd in zip(*(c.to_pylist() for c in b.columns)):
                    (q, x), (own, y) = _unpack(qi, qd), _unpack(vi, vd)
                    yield _best(np.round(_matrix(x) @ _matrix(y).T, 6) + 0.0, q, own, k, None)

        return pairs.join(blocks, "list").select("qi", "qd", "ids", "data").mapInArrow(unit, _HITS)

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, id, score, rn: cosine top k for ``queries`` (query_id, vec). ``exact``: what ``retrieval.dense`` gives."""
        numbers, *_, tuned = self._load()
        few = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
        if not numbers:
            return self.spark.createDataFrame([], _HITS + ", rn long")
        probes = min(probes or tuned, len(numbers))
        found = self._score(self._pairs(few, probes), k)
        if not exact or probes == len(numbers):
            return top_k(found, k)
        found = stage(found, "probed")
        floor = top_k(found, k).where(F.col("rn") == k).select("query_id", F.col("score").alias("floor"))
        return top_k(found.unionByName(self._score(self._pairs(few, probes, floor), k)), k)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, part, id, vec), sorted, as a row for each (list, part)."""
    held, key = [], None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"list": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int32()), "ids": [np.array([r[0] for r in held], np.int64).tobytes()], "data": [np.array([r[1] for r in held], np.float64).tobytes()]})

    for b in batches:
        for number, part, i, v in zip(*(c.to_pylist() for c in b.columns)):
            if (number, part) != key:
                if held:
                    yield row()
                held, key = [], (number, part)
            held.append((i, v))
    if held:
        yield row()


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true hits' scores that are found: hits of equal score stand for one another."""
    floor = true.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    got = found.join(floor, "query_id").where(F.col("score") >= F.col("floor")).count()
    return got / max(1, true.count())
