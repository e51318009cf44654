"""Inputs and Arrow settings that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import drop_staged, parquet, plain_unions, shared_dir, stage  # noqa: F401


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """Bound what a Python worker is handed at once by bytes, so that long texts come in small batches."""
    plain_unions(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Broadcast a table of ids only up to so many rows (a few MB).
BROADCAST_ROWS = 100_000
#: Longer tables are joined with care for frequent keys; rows from which a key is one.
SPREAD_ROWS, HOT_ROWS = 2_000_000, 100_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", small: int | None = None, frequent: DataFrame | None = None) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row a ``key``, however often a key stands in ``left``.

    A ``right`` of at most ``small`` rows is broadcast. Else, if ``left`` is long, its rows of keys that it holds HOT_ROWS times
    or more meet a broadcast of just those keys' rows (at most rows / HOT_ROWS, and the limit is raised until they are few),
    and the rest is shuffled by key. ``frequent``: (key, n) of ``left``, if known. Both sides should be staged tables.
    """
    small = BROADCAST_ROWS if small is None else small
    if small and right.count() <= small:
        return left.join(F.broadcast(right), key, how)
    if left.count() <= SPREAD_ROWS:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if frequent is None else frequent.select(key, "n")
    limit, hot = HOT_ROWS, stage(counts.where(F.col("n") >= HOT_ROWS), "hot")
    while hot.count() > BROADCAST_ROWS:
        limit *= 10
        hot = hot.where(F.col("n") >= limit)
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot.select(key))
    few = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return few.unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def arrow_map(df: DataFrame, make: Callable[..., dict], schema: str, *args) -> DataFrame:
    """``make(batch, *args)`` turns each record batch into a dict of columns of ``schema``."""
    small_batches(df.sparkSession)
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = make(batch, *args)
                yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) and got[f.name].type == f.type else pa.array(got[f.name], f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[list[tuple]]:
    """Rows of sorted batches as tuples, one list for each run of equal values in column ``key``; also across batches."""
    held, last = [], object()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[key] != last:
                yield held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield held
