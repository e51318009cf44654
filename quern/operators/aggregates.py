"""Statistics over logs, budgets and escalation: grouped aggregates and order-dependent windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from quern.functions.text import ladder


def folded(events: DataFrame, by: list[str], order: list[str], values: list[str], start: tuple, step: Callable[[tuple, tuple], tuple], last: Callable[[tuple], tuple], schema: str) -> DataFrame:
    """``last(state)`` of each group after ``step(state, values)`` for each of its rows in order.

    Rows come sorted by group to the task, which holds one group's state only, however many rows it has.
    """
    k = len(by)
    want = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, start, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), want)], schema=want)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:k] != key:
                    if key is not None:
                        out.append((*key, *last(state)))
                    key, state = row[:k], start
                state = step(state, row[k:])
            if len(out) > 10_000:
                yield flush()
                out.clear()
        if key is not None:
            out.append((*key, *last(state)))
        if out:
            yield flush()

    return events.repartition(*by).sortWithinPartitions(*by, *order).select(*by, *values).mapInArrow(run, schema)


def scanned(events: DataFrame, by: list[str], order: list[str], keep: list[str], values: list[str], start: tuple, step: Callable[[tuple, tuple], tuple], schema: str) -> DataFrame:
    """``keep`` of every row with the state after it: ``folded``, but a row a row. ``step`` gives (state, shown)."""
    k, m = len(by), len(by) + len(keep)
    want = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:k] != key:
                    key, state = row[:k], start
                state, shown = step(state, row[m:])
                out.append((*row[k:m], *shown))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), want)], schema=want)

    return events.repartition(*by).sortWithinPartitions(*by, *order).select(*by, *keep, *values).mapInArrow(run, schema)


#: Ranges of values that ``nth`` counts before it sorts one of them.
RANGES = 4096


def nth(df: DataFrame, by: list[str], value: str, index: Column, name: str) -> DataFrame:
    """The value at ``index`` (from 0, may use column n) of each group's sorted values, for groups of any size.

    Values are counted by equal ranges between the group's limits first; only those of the range that holds the index are
    then counted one by one and put in order.
    """
    some = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    lim = some.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("n"))
    at = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * RANGES), F.lit(RANGES - 1)))
    ranged = some.join(lim, by).withColumn("_r", at.cast("int"))
    w = Window.partitionBy(*by)
    counts = ranged.groupBy(*by, "n", "_r").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(w.orderBy("_r")))
    here = counts.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_c") <= index)).select(*by, "_r", (F.col("_upto") - F.col("_c")).alias("_before"))
    few = ranged.join(here, [*by, "_r"]).groupBy(*by, "n", "_before", "_v").agg(F.count("*").alias("_c"))
    run = few.withColumn("_upto", F.col("_before") + F.sum("_c").over(w.orderBy("_v")))
    return run.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_c") <= index)).select(*by, F.col("_v").alias(name), "n")


#: Rows of a group that one task puts in order.
CHUNK = 100_000


def numbered(df: DataFrame, by: str, order: list[str], part: Column) -> DataFrame:
    """``df`` with _no, the number (from 0) of each row in its group, by ``order``, which must refine ``part`` (a coarser order:
    rows of a smaller part come first). Parts are numbered by themselves, and their counts added up."""
    rows = df.withColumn("_part", part)
    before = rows.groupBy(by, "_part").agg(F.count("*").alias("_c"))
    before = before.withColumn("_base", F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = rows.withColumn("_in", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1)
    return within.join(before, [by, "_part"]).withColumn("_no", F.col("_base") + F.col("_in")).drop("_base", "_in", "_part")


def running_mean(df: DataFrame, by: str, order: list[str], value: str, part: Column, name: str = "mean") -> DataFrame:
    """``df`` with the mean of the group's values up to each row; sums of whole parts are carried on, so no task has a group."""
    rows = df.withColumn("_part", part)
    w = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "_part").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    sums = sums.select(by, "_part", F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c"))
    inside = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_s") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))
    return rows.join(sums, [by, "_part"]).withColumn(name, total / (F.col("_c") + F.count(value).over(inside))).drop("_part", "_s", "_c")


def rolling_mean(df: DataFrame, by: str, order: list[str], value: str, size: int, part: Column, name: str = "mean", chunk: int = CHUNK) -> DataFrame:
    """``df`` with the mean of the last ``size`` values of the group up to each row. Rows are dealt into chunks by their number;
    the last rows of a chunk also go to the next one, so a chunk is at least as long as the window."""
    chunk = max(chunk, size)
    rows = numbered(df, by, order, part).withColumn("_chunk", F.floor(F.col("_no") / chunk)).withColumn("_own", F.lit(True))
    tail = rows.where(F.col("_no") % chunk >= chunk - size + 1).withColumn("_chunk", F.col("_chunk") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(by, "_chunk").orderBy("_no").rowsBetween(-(size - 1), 0)
    return rows.unionByName(tail).withColumn(name, F.avg(value).over(w)).where("_own").drop("_chunk", "_own", "_no")


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "p50") -> DataFrame:
    return nth(df, by, value, F.floor(F.col("n") / 2), name)


def p95(df: DataFrame, by: list[str], value: str, name: str = "p95") -> DataFrame:
    return nth(df, by, value, F.greatest(F.floor(F.col("n") * 0.95) - 1, F.lit(0)), name)


def usage(logs: DataFrame, by: str, value: str) -> DataFrame:
    """Calls, sum and rounded mean by group, largest sums first."""
    return logs.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value)).cast("long").alias("mean"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, truncated; 0 of nothing is 0."""
    return F.floor(part * 100 / F.greatest(whole, F.lit(1))).cast("long")


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative counts up to each bound and in all (+Inf), by group: one pass, one row a bound."""
    sums = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(value).alias("_inf"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("count")))
    return sums.select(*by, F.inline(rows))


def consecutive(df: DataFrame, by: str, order: list[str], failed: Column) -> DataFrame:
    """``streak``: failures in a row up to and with each row; a success resets it."""
    w = Window.partitionBy(by).orderBy(*order)
    runs = df.withColumn("_f", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("_f").over(Window.partitionBy(by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("streak", streak).drop("_f", "_run")


def escalation(reflections: Column, tier: Column) -> tuple[Column, Column]:
    """Action and next tier by the number of reflections."""
    up = F.when(tier == "local", "cheap").otherwise("reason")
    action = ladder([(reflections < 2, "retry_same"), (reflections < 4, "escalate"), (reflections < 6, "force_reason")], "human_review")
    return action, ladder([(reflections < 2, tier), (reflections < 4, up), (reflections < 6, "reason")], tier)


def last_n(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each group, with their rank (1 is the newest)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rn") <= n)
