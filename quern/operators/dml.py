"""Upserts, tombstones, incremental sync, key-value state, filters and joins on whole tables.

Each change is a plan from old state and input to new state; ``quern.sources.tables.replace`` makes it the table's current version.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import ladder, lookup
from quern.operators.retrieval import blocks_of


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key (null keys equal nothing)."""
    return old.join(new.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def delete_where(old: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What is left, and the number deleted."""
    hit = F.coalesce(condition, F.lit(False))
    return old.where(~hit), old.where(hit).agg(F.count("*").alias("deleted"))


def tombstone(old: DataFrame, condition: Column) -> DataFrame:
    return old.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(condition, F.lit(False)))


def insert_absent(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """New rows whose key isn't there yet, each key once; blank contents are skipped."""
    good = new.where(F.trim(F.coalesce(F.col(content), F.lit(""))) != "")
    one = good.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in good.columns if c != key]))).where("_r = 1").drop("_r")
    return old.unionByName(one.join(old.select(key), key, "left_anti").select(*old.columns))


def sync(disk: DataFrame, index: DataFrame, key: str, checksum: str) -> DataFrame:
    """key and action: unchanged, upsert (new or changed) or obsolete, from one full outer join."""
    d, i = disk.select(F.col(key).alias("_k"), F.col(checksum).alias("_d")), index.select(F.col(key).alias("_k"), F.col(checksum).alias("_i"))
    action = ladder([(F.col("_d").isNull(), "obsolete"), (F.col("_d") == F.col("_i"), "unchanged")], "upsert")
    return d.join(i, "_k", "full_outer").select(F.col("_k").alias(key), action.alias("action"))


def live(state: DataFrame, as_of: Column) -> DataFrame:
    """Entries of a key-value table that haven't expired."""
    return state.where(F.col("expires_at") > as_of)


def invalidate(state: DataFrame, prefix: str) -> DataFrame:
    return state.where(~F.col("key").startswith(prefix))


def read_through(inputs: DataFrame, cache: DataFrame, key: str, value: Column) -> DataFrame:
    """Cached values where there are any, computed ones for the rest only."""
    hit = inputs.join(cache, key).select(key, "value", F.lit(True).alias("cached"))
    miss = inputs.join(cache.select(key), key, "left_anti").select(key, value.alias("value"), F.lit(False).alias("cached"))
    return hit.union(miss)


def normalise_paths(paths: DataFrame, listing: DataFrame, extensions: list[str], excluded: list[str]) -> DataFrame:
    """path, at (first position), accepted: cleaned, each once; accepted if listed, with a known extension, in no excluded folder."""
    clean = F.regexp_replace(F.translate("path", "\\", "/"), r"/{2,}", "/")
    rows = paths.select(F.regexp_replace(clean, r"^\./", "").alias("path"), "at").groupBy("path").agg(F.min("at").alias("at"))
    good = F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded]))
    return rows.join(listing.select("path", F.lit(True).alias("_there")).distinct(), "path", "left").select("path", "at", (good & F.coalesce("_there", F.lit(False))).alias("accepted"))


def clones(vectors: DataFrame, threshold: float, limit: int = 50, block: int = 2048) -> DataFrame:
    """The most similar pairs (a < b) of vectors (id, vec) at or over the threshold.

    Blocks of vectors meet on the executors, each pair of blocks in one task, which sends on its ``limit`` best pairs. Since
    only that many are asked for, the result is exact. Equal ids are one vector.
    """
    count = max(1, -(-vectors.count() // block))
    packed = blocks_of(vectors.dropDuplicates(["id"]), "id", count, "v")
    other = packed.select(F.col("v").alias("w"), F.col("ids").alias("ids2"), F.col("data").alias("data2"))
    pairs = packed.withColumn("w", F.explode(F.sequence(F.col("v"), F.lit(count - 1)))).join(other, "w").select("v", "w", "ids", "data", "ids2", "data2")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a pair of blocks at a time, from the batch's own buffers
            for k in range(b.num_rows):
                v, w = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                ids, data, ids2, data2 = (memoryview(b.column(c)[k].as_buffer()) for c in range(2, 6))
                a, x = (np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, len(data) // len(ids)))
                c, y = (np.frombuffer(ids2, np.int64), np.frombuffer(data2, np.float64).reshape(-1, len(data2) // len(ids2)))
                unit_rows = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                s = np.round(unit_rows(x) @ unit_rows(y).T, 6) + 0.0
                if v == w:
                    s[np.tril_indices(len(s))] = -2
                i, j = np.nonzero(s >= threshold)
                low, high, score = np.minimum(a[i], c[j]), np.maximum(a[i], c[j]), s[i, j]
                best = np.lexsort((high, low, -score))[:limit]
                yield pa.RecordBatch.from_arrays([pa.array(low[best]), pa.array(high[best]), pa.array(score[best])], names=["a", "b", "score"])

    return pairs.mapInArrow(unit, "a long, b long, score double").orderBy(F.desc("score"), "a", "b").limit(limit)


STATUS_ALIASES = {"open": "active", "running": "active", "in_progress": "active", "finished": "done", "completed": "done", "todo": "planned"}


def status(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.coalesce(lookup(low, STATUS_ALIASES), low)
