"""Traces of real runs: what each step of a pipeline took in, gave, and how long it ran.

A traced step is executed and staged where it stands, with its rows counted by an ``Observation`` on the write, so the figures are those of
the run itself and no step is computed twice. Steps are kept in the driver (a few a run) and written as a table on request.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.session import stage

SCHEMA = "trace_id string, no int, step string, rows long, queries long, seconds double, started double, status string, error string"


class Trace:
    """The steps of one run."""

    def __init__(self, spark: SparkSession, trace_id: str | None = None):
        self.spark, self.trace_id, self.steps = spark, trace_id or uuid.uuid4().hex, []

    def step(self, name: str, df: DataFrame) -> DataFrame:
        """Run ``df`` now and go on from its result; a failure is recorded and raised."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        counts = [F.count(F.lit(1)).alias("rows")]
        if "query_id" in df.columns:
            counts.append(F.approx_count_distinct("query_id", 0.01).alias("queries"))
        started, began = time.time(), time.perf_counter()
        try:
            out = stage(df.observe(seen, *counts), f"trace-{name}")
        except Exception as e:
            self._note(name, None, None, began, started, "error", str(e).split("\n")[0][:500])
            raise
        got = seen.get
        self._note(name, got["rows"], got.get("queries"), began, started, "ok", None)
        return out

    def _note(self, name: str, rows: int | None, queries: int | None, began: float, started: float, status: str, error: str | None) -> None:
        self.steps.append((self.trace_id, len(self.steps), name, rows, queries, time.perf_counter() - began, started, status, error))

    def table(self) -> DataFrame:
        """A row for each step so far, in order."""
        return self.spark.createDataFrame(self.steps, SCHEMA)

    def finish(self, path: str) -> None:
        """Append the trace to the table at ``path``."""
        self.table().coalesce(1).write.mode("append").parquet(path)
