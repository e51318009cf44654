"""The segment index against a scan after every change; several tables that change together."""

import random

import pytest

from quern.operators import retrieval
from quern.operators.segments import Segments
from quern.sources.manifest import Conflict, Tables

WORDS = [f"w{i}" for i in range(60)]


def text(rng):
    return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 60)))


def rows(df):
    return sorted((r.query_id, r.id, round(r.score, 6), r.rn) for r in df.collect())


def test_equals_a_scan_after_every_change(spark, tmp_path):
    rng, live = random.Random(2), {}
    index = Segments(spark, f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 3))) for i in range(6)] + [(7, "absent"), (8, "w0 w0 w1")], "query_id long, text string")
    assert index.search(queries).collect() == [] and index.count() == 0
    for step in range(6):
        batch = {rng.randrange(400): text(rng) for _ in range([500, 40, 30, 60, 5, 1][step])}
        index.upsert(spark.createDataFrame([*batch.items(), (None, "w0")], "id long, text string"))
        live |= batch
        gone = rng.sample(sorted(live), 7)
        index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        for i in gone:
            del live[i]
        if step in (2, 5):
            docs = spark.createDataFrame(list(live.items()), "id long, text string")
            assert rows(index.search(queries, 10)) == rows(retrieval.bm25(queries, docs, 10))
            assert rows(index.search(queries, 10, idf=True)) == rows(retrieval.bm25(queries, docs, 10, n_docs=len(live)))
            assert index.count() == len(live)
    assert len(index._segments(index.tables.folders())) <= 4
    index.merge()
    folders = index.tables.folders()
    assert len(index._segments(folders)) == 1 and not any(k.startswith("dead-") for k in folders)
    docs = spark.createDataFrame(list(live.items()), "id long, text string")
    keep = docs.where("id % 2 = 0").select("id")
    assert rows(index.search(queries, 10, keep=keep)) == rows(retrieval.bm25(queries, docs.join(keep, "id", "left_semi"), 10))


def test_bounds_leave_blocks_unread(spark, tmp_path):
    """A rare term with a high score: most blocks of the common one are not scored."""
    docs = spark.range(8000).selectExpr("id", "concat(repeat('common ', int(1 + id % 3)), repeat('pad ', int(id % 200)), if(id % 1000 = 0, repeat('rare ', 9), '')) as text")
    index = Segments(spark, f"file://{tmp_path}/index")
    index.upsert(docs, new=True)
    queries = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    got, read, there = index.search_counted(queries, 2)
    assert rows(got) == rows(retrieval.bm25(queries, docs, 2))
    assert there > 25 and read < there / 2


def test_postings_are_never_rows(spark, tmp_path, monkeypatch):
    """Change, merge and search keep a block's postings packed: no plan unpacks them, and tombstones meet documents."""
    from pyspark.sql import functions as F

    index = Segments(spark, f"file://{tmp_path}/index")
    docs = spark.range(600).selectExpr("id", "concat(repeat('common ', int(1 + id % 3)), 'own', id % 50) as text")
    queries = spark.createDataFrame([(1, "common own7"), (2, "own3")], "query_id long, text string")
    seen = []
    write = index.tables.write
    monkeypatch.setattr(index.tables, "write", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    index.upsert(docs)
    index.upsert(docs.where("id % 2 = 0").withColumn("text", F.lit("own7 other")))
    index.delete(docs.where("id % 5 = 0"))
    index.merge()
    got = index.search(queries, 5, idf=True)
    seen.append(got._jdf.queryExecution().optimizedPlan().toString())
    assert seen and not any("Generate" in p and "terms" in p.split("Generate", 1)[1].split("\n")[0] or "inline" in p for p in seen)
    live = docs.where("id % 2 = 1 and id % 5 > 0").union(docs.where("id % 2 = 0 and id % 5 > 0").select("id", F.lit("own7 other")))
    assert rows(got) == rows(retrieval.bm25(queries, live, 5, n_docs=live.count()))
    assert len(index._segments(index.tables.folders())) == 1


def test_more_queries_than_a_block(spark, tmp_path, monkeypatch):
    index = Segments(spark, f"file://{tmp_path}/index")
    docs = spark.range(300).selectExpr("id", "concat('common own', id % 20, ' other', id % 7) as text")
    index.upsert(docs)
    index.delete(docs.where("id % 3 = 0"))
    live, keep = docs.where("id % 3 > 0"), docs.where("id % 2 = 0")
    queries = spark.range(5).selectExpr("id as query_id", "concat('own', id, ' other', id) as text")
    want = [rows(retrieval.bm25(queries, live, 4, n_docs=live.count())), rows(retrieval.bm25(queries, live.join(keep.select("id"), "id", "left_semi"), 4))]
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    assert [rows(index.search(queries, 4, idf=True)), rows(index.search(queries, 4, keep=keep))] == want


def test_a_failed_upsert_leaves_the_index(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/index")
    index.upsert(spark.createDataFrame([(1, "a b")], "id long, text string"))
    index.tables.write(spark.range(3))  # written, never named
    other = Segments(spark, f"file://{tmp_path}/index")
    assert other.count() == 1 and other.tables.version() == 1


def test_tables_change_together(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.folders() == {}
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    ids = lambda name, v=None: sorted(r.id for r in t.read(name, v).collect())
    one = t.change({"tasks": frame(1), "steps": frame(10, 11)})
    half = t.write(frame(2))  # a crash here leaves both tables as they are
    assert ids("tasks") == [1] and ids("steps") == [10, 11] and half
    two = t.change({"tasks": t.read("tasks").union(frame(2)), "steps": t.read("steps").union(frame(12))}, since=one)
    assert ids("tasks") == [1, 2] and ids("steps") == [10, 11, 12]
    assert ids("tasks", one) == [1] and ids("steps", one) == [10, 11], "readers of the older version are not disturbed"
    with pytest.raises(Conflict):
        t.change({"tasks": frame(9)}, since=one)
    assert ids("tasks") == [1, 2]
    t.change({"tasks": frame(3)}, drop=["steps"], since=two)
    t.vacuum(keep=1)
    assert ids("tasks") == [3] and set(t.folders()) == {"tasks"}
    with pytest.raises(Exception):
        t.read("tasks", one).collect()


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """Both have seen version 1; the second manifest of that number is refused."""
    a, b = Tables(spark, f"file://{tmp_path}/t"), Tables(spark, f"file://{tmp_path}/t")
    a.change({"x": spark.range(1)})
    monkeypatch.setattr(b, "version", lambda: 1)
    a.change({"x": spark.range(2)})
    with pytest.raises(Conflict):
        b.change({"x": spark.range(3)})
    assert a.read("x").count() == 2
