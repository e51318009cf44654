"""The vector index: exact mode against a scan, recall of the probes, bounds that leave lists unread."""

import numpy as np
import pytest

from quern.operators import retrieval, vector_index
from quern.operators.vector_index import VectorIndex


def frame(spark, x, first=0, name="id"):
    return spark.createDataFrame([(first + i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], f"{name} long, vec array<double>")


def rows(df):
    return sorted((r.query_id, r.rn, r.id, r.score) for r in df.collect())


def clusters(seed, n, dim=12, groups=15, spread=0.25):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return np.round(centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)), 3)


@pytest.fixture(scope="module")
def data(spark):
    x = list(clusters(1, 3000))
    x += [x[0]] * 1200 + [np.zeros(12), None]  # a hot vector, a zero and a null
    return frame(spark, x), frame(spark, list(clusters(1, 40)) + [np.zeros(12)], name="query_id")


def test_exact_mode_equals_a_scan(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PACK", 200)
    vectors, queries = data
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(vectors, lists=20)
    want = rows(retrieval.dense(queries, vectors, 10))
    assert rows(index.search(queries, 10, probes=1, exact=True)) == want
    assert rows(VectorIndex(spark, f"file://{tmp_path}/v").search(queries, 10, exact=True)) == want, "from the stored index"
    # bounds leave lists unread: fewer pairs than queries times lists
    numbers = index._load()[0]
    probed = index.search(queries, 10, probes=1)
    floor = probed.where("rn = 10").select("query_id", probed.score.alias("floor"))
    more = sum(len(r.qi) // 8 for r in index._pairs(queries, 1, floor).collect())
    assert more < 40 * (len(numbers) - 1) / 2


def test_probes_reach_the_recall(spark, data, tmp_path):
    vectors, queries = data
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(vectors)
    true, found = retrieval.dense(queries.where("query_id < 40"), vectors, 10), index.search(queries.where("query_id < 40"), 10)
    assert index._load()[3] < len(index._load()[0])
    assert vector_index.recall(found, true) >= 0.9
    assert index.spark.read.parquet(f"{index.path}/lists").agg({"n": "sum"}).first()[0] == 4201, "every row is indexed"


def test_empty_index(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(frame(spark, []))
    assert index.search(frame(spark, [np.ones(3)], name="query_id")).collect() == []
