"""The trace of a run has the rows of its steps, and a traced search gives what an untraced one gives."""

import pytest
from pyspark.sql import functions as F

from quern.plans.engine_plans import engine
from quern.plans.registry import Tables
from quern.plans.retrieval_plans import mixed_queries
from quern.trace import Trace


def test_traced_search_is_the_search(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    trace = Trace(spark, "one")
    got = engine(t, trace=trace).search_code(mixed_queries(t)).drop("text").collect()
    want = engine(t).search_code(mixed_queries(t)).drop("text").collect()
    rows = lambda x: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in x)
    assert rows(got) == rows(want) and got
    steps = trace.table().orderBy("no").collect()
    assert [s.step for s in steps] == ["classify", "retrieve", "augment", "rerank", "dedup", "score", "pack"]
    by = {s.step: s for s in steps}
    n = mixed_queries(t).count()
    assert by["classify"].rows == n and by["rerank"].rows <= 24 * n and by["dedup"].rows == by["score"].rows <= by["rerank"].rows
    assert by["pack"].rows == len(got) and all(s.seconds > 0 and s.status == "ok" and s.trace_id == "one" for s in steps)


def test_a_failed_step_is_recorded(spark, tmp_path):
    trace = Trace(spark)
    trace.step("fine", spark.range(5))
    with pytest.raises(Exception):
        trace.step("bad", spark.range(3).select(F.raise_error(F.lit("no good")).alias("x"), "id"))
    path = f"file://{tmp_path}/traces"
    trace.finish(path)
    got = sorted((r.no, r.step, r.rows, r.status) for r in spark.read.parquet(path).collect())
    assert got == [(0, "fine", 5, "ok"), (1, "bad", None, "error")]
