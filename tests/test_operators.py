"""Truth tables and properties of operators that the tables don't exercise."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import aggregates, chunking, dml, graph, lifecycle, memory, ranking, retrieval
from quern.plans import catalogue
from quern.sources import tables


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,tier", [("fix typo", "local"), ("refactor the auth layer of a.py and b.py", "cheap"), ("update a.py and b.py: Traceback, redesign the architecture and security", "reason")])
def test_complexity_tiers(spark, text, tier):
    assert one(spark, ranking.complexity(F.col("q"))["tier"], q=text) == tier


def test_complexity_signals(spark):
    c = ranking.complexity(F.col("q"))
    assert one(spark, c["s_trace"], q="Error: x") == 1.0
    assert one(spark, c["s_arch"], q="the schema") == 0.5
    assert one(spark, c["s_tokens"], q="w " * 225) == 1.0


@pytest.mark.parametrize("r,tier,action,new", [(0, "local", "retry_same", "local"), (1, "cheap", "retry_same", "cheap"), (2, "local", "escalate", "cheap"), (3, "cheap", "escalate", "reason"), (4, "local", "force_reason", "reason"), (6, "cheap", "human_review", "cheap")])
def test_escalation(spark, r, tier, action, new):
    a, t = aggregates.escalation(F.col("r"), F.col("t"))
    assert (one(spark, a, r=r, t=tier), one(spark, t, r=r, t=tier)) == (action, new)


def test_hybrid_impact(spark):
    s = ranking.hybrid_impact(F.lit(0.8), F.lit(0.6), F.lit(0.5), F.lit(0.3))
    assert one(spark, s, q=1) == 0.63
    assert one(spark, ranking.risk(s), q=1) == "medium"


@pytest.mark.parametrize("name,path,role", [("UserDto", "a.py", "is_dto"), ("x", "src/dtos/a.py", "is_dto"), (None, "db/migrations/1.py", "is_migration"), ("AddMigration", "a.cs", "is_migration"), ("Card", "ui/Card.tsx", "is_ui_component"), ("price_validator", "a.py", "is_business_rule"), ("x", "app/policies/a.py", "is_business_rule"), ("OrderEntity", "a.cs", "is_entity"), ("x", "app/domain/a.cs", "is_entity")])
def test_roles(spark, name, path, role):
    got = {k for k, c in chunking.roles(F.col("n"), F.lit("return x"), F.col("p")).items() if one(spark, c, n=name, p=path)}
    assert role in got and len(got) == 1


def test_roles_of_a_plain_service(spark):
    assert not any(one(spark, c, n="userService", p="app/service.ts") for c in chunking.roles(F.col("n"), F.lit("return x"), F.col("p")).values())


def test_sections_keep_fences(spark):
    text = "# A\nintro\n## B\n```\n# no header\n```\n### C\nx\n## D\ny"
    rows = {r.section: r for r in chunking.sections(spark.createDataFrame([(1, text)], "id long, text string")).collect()}
    assert rows[2].h1 == "A" and rows[2].h2 == "B" and "# no header" in rows[2].body
    assert rows[3].h3 == "C" and rows[4].h2 == "D" and rows[4].h3 == ""


def test_pack_keeps_the_first_hit(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "x" * 100), (1, 2, 0.8, "y" * 10)], "query_id long, id long, score double, text string")
    assert [r.id for r in ranking.pack(hits, F.lit(50)).collect()] == [1]


def test_sync_partitions_all_keys(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "k string, c string")
    index = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "k string, c string")
    assert {r.k: r.action for r in dml.sync(disk, index, "k", "c").collect()} == {"a": "unchanged", "b": "upsert", "d": "upsert", "c": "obsolete"}


def test_strict_labels_raise(spark):
    bad = spark.createDataFrame([("Class", "a", "KNOWS", "Function", "b")], "src_label string, src string, rel string, dst_label string, dst string")
    with pytest.raises(Exception, match="ontology"):
        graph.strict_labels(bad).collect()


def test_code_chunks(spark):
    ts = "import {a} from 'b';\nexport class Shop extends Base {\n  public total(x: number): number { return sum(x); }\n}\nfunction free() { /* } */ return 1; }\n"
    files = spark.createDataFrame([("a.py", "class A(B):\n    def f(self):\n        g()\n"), ("b.ts", ts), ("c.py", "def broken(:"), ("d.py", None)], "path string, content string")
    rows = {(r.path, r.name): r for r in memory.code_chunks(files).collect()}
    assert set(rows) == {("a.py", "A"), ("a.py", "f"), ("b.ts", "Shop"), ("b.ts", "total"), ("b.ts", "free")}
    assert rows["a.py", "f"].parent_class == "A" and rows["a.py", "f"].calls == ["g"] and rows["a.py", "A"].bases == ["B"]
    assert rows["b.ts", "total"].parent_class == "Shop" and rows["b.ts", "Shop"].bases == ["Base"]
    ast.parse(rows["a.py", "A"].code)


def test_three_modules_have_central_names_and_impact(spark):
    edges = spark.createDataFrame([("auth", "DEPENDS_ON", "core"), ("ui", "CALLS", "auth")], "src string, rel string, dst string")
    assert {r.node: r.centrality for r in graph.degree(edges).collect()}["auth"] == 1.0
    callers = graph.walk(spark.createDataFrame([("core",)], "seed string"), edges, 3, reverse=True)
    assert {(r.node, r.distance) for r in callers.collect()} == {("auth", 1), ("ui", 2)}


def test_suggestions_are_of_the_file(spark):
    """Many untested functions of other files, some named like tests, don't crowd out the file's."""
    files = [(f"a/my_test_{i}.py", "def f(a):\n    return a\n") for i in range(60)] + [("b/mod.py", "def two(a):\n    return a\n\ndef one(a):\n    return a\n\ndef _no():\n    pass\n")]
    chunks = memory.code_chunks(spark.createDataFrame(files, "path string, content string"))
    assert [tuple(r) for r in memory.suggest_tests(chunks, "b/mod.py", 5).collect()] == [("b/mod.py", "one"), ("b/mod.py", "two")]
    assert memory.untested(chunks, 20).count() == 20


def test_task_states(spark):
    rows = [(1, i, True) for i in range(7)] + [(2, i, i != 4) for i in range(5)] + [(3, i, i < 4) for i in range(4)] + [(3, 4 + 2 * k, False) for k in range(4)] + [(3, 5 + 2 * k, True) for k in range(4)]
    got = {r.task_id: (r.node, r.status, r.reflections) for r in memory.task_states(spark.createDataFrame(rows, "task_id long, step int, ok boolean")).collect()}
    assert got[1] == ("summarizer", "DONE", 0) and got[2] == ("editor", "EXECUTING", 1) and got[3][1:] == ("FAILED", 4)


def test_sources(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/node_modules/b.ts").write_text("y")
    (tmp_path / "src/c.txt").write_text("z")
    assert [r.path for r in tables.source_files(spark, str(tmp_path)).collect()] == ["src/a.py"]
    (tmp_path / "cases.json").write_text('[{"question": "q1", "expected_files": ["a"]}, {"query": "q2", "expected_symbols": ["s"]}]')
    assert {(r.query, tuple(r.expected_files), tuple(r.expected_entities)) for r in tables.eval_cases(spark, str(tmp_path / "cases.json")).collect()} == {("q1", ("a",), ()), ("q2", (), ("s",))}
    (tmp_path / "log.txt").write_text('{"level": "ERROR", "msg": "m", "tool": "t"}\nnot json\n')
    assert {(r.level, r.msg) for r in tables.log_lines(spark, str(tmp_path / "log.txt"), "2024").collect()} == {("ERROR", "m"), ("INFO", "not json")}


def test_replace_reads_what_it_writes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.replace(spark.range(3), path)
    first, old = tables.current(spark, path), tables.table(spark, path)
    tables.replace(old.union(spark.range(3, 5)), path)
    assert tables.table(spark, path).count() == 5 and tables.current(spark, path) != first
    # who reads the version before still can; the one before that is gone
    assert old.count() == 3
    tables.replace(spark.range(7), path)
    assert tables.table(spark, path).count() == 7 and first not in {x.name for x in (tmp_path / "t/versions").iterdir()}


@pytest.mark.parametrize("path,purposes", [("a.py", "ipa"), ("src/b.tsx", "ipa"), ("x/.hidden/c.py", "ip"), ("bin/c.py", ""), ("migrations/m.py", "a"), ("out/m.py", "ip"), ("D.PY", "a"), ("e.rb", "a"), ("f.kt", "pa"), ("noext", ""), ("src/bin", "")])
def test_scans(spark, path, purposes):
    df = spark.createDataFrame([(path,)], "path string")
    assert "".join(k[0] for k in tables.SCANS if tables.scan_files(df, k).count()) == purposes


def breaker_states(calls, failures, recovery, successes):
    state, failed, good, last, out = "closed", 0, 0, 0.0, []
    for at, ok in calls:
        if state == "open" and at - last >= recovery:
            state, good = "half_open", 0
        if state == "open":
            out.append((False, state))
            continue
        if ok and state == "half_open":
            good += 1
            if good == successes:
                state, failed = "closed", 0
        elif ok:
            failed = 0
        else:
            failed, last = failed + 1, at
            if state == "half_open" or failed >= failures:
                state = "open"
        out.append((True, state))
    return out


def test_breaker(spark):
    import random

    rng = random.Random(5)
    calls = {k: [(float(i * 10 + rng.randint(0, 9)), rng.random() < 0.4) for i in range(120)] for k in range(4)}
    rows = [(k, i, at, ok) for k, c in calls.items() for i, (at, ok) in enumerate(c)]
    rng.shuffle(rows)
    got = lifecycle.breaker(spark.createDataFrame(rows, "k long, i long, s double, ok boolean"), "k", ["i"], ["k", "i"], "s", "ok", 3, 60.0, 2).collect()
    assert {(r.k, r.i): (r.accepted, r.state) for r in got} == {(k, i): x for k, c in calls.items() for i, x in enumerate(breaker_states(c, 3, 60.0, 2))}
    assert {r.state for r in got} == {"open", "closed", "half_open"}


@pytest.mark.parametrize("limit", [30, 60, 10_000])
def test_split_table(spark, limit):
    import random

    rng = random.Random(limit)
    head = "| a |\n|---|"
    rows = ["| " + "x" * rng.randint(1, 50) + " |" for _ in range(60)]
    text = "\n".join([head, *rows])
    want, current = [], []
    for r in rows:
        if current and len("\n".join([head, *current, r])) > limit:
            want.append("\n".join([head, *current]))
            current = []
        current.append(r)
    want.append("\n".join([head, *current]))
    got = spark.createDataFrame([(text,), (None,)], "t string").select(chunking.split_table(F.col("t"), limit).alias("p")).collect()
    assert got[0].p == ([text] if len(text) <= limit else want) and got[1].p == []


def plain_pack(blocks, limit):
    chunks, parts, used = [], [], 0
    for b in blocks:
        if b > limit:
            if parts:
                chunks.append(parts)
            chunks.append([b])
            parts, used = [], 0
        elif used + b + 2 <= limit:
            parts.append(b)
            used += b + 2
        else:
            if parts:
                chunks.append(parts)
            parts, used = [b], b
    return chunks + ([parts] if parts else [])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=25))
def test_pack_lengths(spark, blocks):
    got = spark.createDataFrame([(blocks,)], "b array<int>").select(chunking.pack_lengths(F.col("b"), 40).alias("c")).first().c
    assert got == [k for k, c in enumerate(plain_pack(blocks, 40)) for _ in c]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_nth_of_any_values(spark, values):
    df = spark.createDataFrame([(k, v) for k in (1, 2) for v in values] + [(1, None)], "k int, v double")
    got = {r.k: (r.p50, r.n) for r in aggregates.upper_median(df, ["k"], "v").collect()}
    want = (sorted(values)[len(values) // 2], len(values))
    assert got == {1: want, 2: want}
    low = {r.k: r.p95 for r in aggregates.p95(df, ["k"], "v").collect()}
    assert low == {k: sorted(values)[max(int(len(values) * 0.95) - 1, 0)] for k in (1, 2)}


def test_running_and_rolling_means(spark):
    import random

    rng = random.Random(6)
    rows = [(k, i, rng.random()) for k in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    for part in (F.floor(F.col("i") / 7), F.floor(F.col("i") / 1000)):
        run = {(r.k, r.i): r.mean for r in aggregates.running_mean(df, "k", ["i"], "v", part).collect()}
        roll = {(r.k, r.i): r.mean for r in aggregates.rolling_mean(df, "k", ["i"], "v", 20, part, chunk=32).collect()}
        wide = {(r.k, r.i): r.mean for r in aggregates.rolling_mean(df, "k", ["i"], "v", 50, part, chunk=8).collect()}
        for k in "ab":
            v = [x for kk, _, x in rows if kk == k]
            assert all(abs(run[k, i] - sum(v[: i + 1]) / (i + 1)) < 1e-9 for i in range(300))
            assert all(abs(roll[k, i] - sum(v[max(0, i - 19) : i + 1]) / min(20, i + 1)) < 1e-9 for i in range(300))
            assert all(abs(wide[k, i] - sum(v[max(0, i - 49) : i + 1]) / min(50, i + 1)) < 1e-9 for i in range(300))


def test_edge_types_of_walks(spark):
    """Forbidden edges lead nowhere, and the allowed ones do, each walk by its own list."""
    kinds = ["CONTAINS", "OWNS", "CALLS", "DEPENDS_ON", "USES_CONFIG", "AFFECTS_MODULE", "RELATES_TO_RULE", "IMPLEMENTS"]
    edges = spark.createDataFrame([("a", k, k) for k in kinds] + [(k, k, "z") for k in kinds], "src string, rel string, dst string")
    a, z = spark.createDataFrame([("a",)], "seed string"), spark.createDataFrame([("z",)], "seed string")
    names = lambda df, d: {r.node for r in df.collect() if r.distance == d}
    assert names(graph.expand(a, edges), 1) == {"CONTAINS", "OWNS", "CALLS"}
    assert names(graph.dependencies(a, edges), 1) == {"CALLS", "DEPENDS_ON", "OWNS", "USES_CONFIG"}
    assert names(graph.callers(z, edges), 1) == {"CALLS", "DEPENDS_ON", "OWNS", "AFFECTS_MODULE"}
    both = {r.node: r["size"] for r in graph.communities(edges).collect()}
    assert both == {"a": 2, "z": 2, "CALLS": 2, "DEPENDS_ON": 2}


def test_stored_postings_answer_like_a_scan(spark):
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    d = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None)], "id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 4))) for i in range(12)] + [(99, "unknown")], "query_id long, text string")
    scan = sorted(map(tuple, retrieval.bm25(q, d, 10).collect()))
    index = retrieval.Index(d, folders=8)
    assert sorted(map(tuple, index.search(q, 10).collect())) == scan == sorted(map(tuple, retrieval.bm25(q, retrieval.postings(d), 10).collect()))
    assert sorted(map(tuple, index.search(q, 10, idf=True).collect())) == sorted(map(tuple, retrieval.bm25(q, d, 10, n_docs=201).collect()))


def test_clones_of_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 6)), 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = sorted(((-s[i, j], i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.5))[:40]
    got = dml.clones(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>"), 0.5, 40, block=16).collect()
    assert [(r.a, r.b) for r in got] == [(i, j) for _, i, j in want]


def test_holders_of_passages(spark):
    d = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "quick brown fox"), (3, "a\nb"), (4, None), (5, "the quick  brown fox jumps over")], "id long, text string")
    p = spark.createDataFrame([(1, "ick brown fox jumps over the la"), (2, "fox"), (3, "brown fox"), (4, "a\nb"), (5, "absent words of a passage here"), (6, "quick brown fox jumps")], "passage_id long, text string")
    assert {tuple(r) for r in ranking.holders(p, d).collect()} == {(1, 1), (2, 1), (2, 2), (2, 5), (3, 1), (3, 2), (3, 5), (4, 3), (6, 1)}


def test_streams_survive_a_retried_batch(spark, tmp_path):
    """A batch that is written twice leaves its rows once."""
    from quern.streaming import events as S

    out = f"file://{tmp_path}/out"
    write = S.appended(out)
    for n, ids in ((0, [1, 2]), (1, [3]), (1, [3])):
        write(spark.createDataFrame([(i,) for i in ids], "id long"), n)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_compression_floor_and_short_texts(spark):
    long_ = "# license\n" + "x = 1  \n" * 40
    out, ratio = ranking.compress(F.col("t"))
    rows = spark.createDataFrame([("short  \n\n\n\n",), (long_,), ("a" + "\n" * 500 + "b",)], "t string").select(out.alias("o"), ratio.alias("r")).collect()
    assert rows[0].o == "short  \n\n\n\n" and rows[0].r == 1.0
    assert rows[1].o == ("x = 1\n" * 40).strip() and rows[1].r < 1
    assert rows[2].r == 1.0 and len(rows[2].o) == 502


def test_frames_without_headers(spark):
    frame = lambda b: bytes([1, 0, 0, 0]) + len(b).to_bytes(4, "big") + b
    df = spark.createDataFrame([(1, frame("é\n".encode()) + frame(b"b")), (2, b"plain"), (3, b""), (4, None), (5, frame(b"abc")[:9])], "id long, body binary")
    got = {r.id: r.text for r in lifecycle.frames(df, "id", "body").collect()}
    assert got == {1: "é\nb", 2: "plain", 3: "", 4: "", 5: "a"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=8))
def test_min_max_range(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "q int, s double")
    got = [r.m for r in df.select(ranking.min_max("s", "q").alias("m")).collect()]
    assert all(0.0 <= x <= 1.0 for x in got)
    if max(values) > min(values):
        assert max(got) == 1.0 and min(got) == 0.0


def test_dense_blocks_agree_with_one_pass(spark, monkeypatch):
    import random

    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id long, vec array<double>")
    q = v.where("id < 10").select(F.col("id").alias("query_id"), "vec")
    whole = sorted(map(tuple, retrieval.dense(q, v, 5).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    assert sorted(map(tuple, retrieval.dense(q, v, 5).collect())) == whole


def test_nothing_else_imports_the_training_data_package():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "quern"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "quern.llm" in p.read_text()]


def test_tables_and_smells_cover_their_whole_tables(spark):
    folder = "/root/testdata/sf0.01"
    head = "| a | b |\n|---|---|"
    parts, body = {}, {r.doc_id: "\n".join([head, *(f"| {w} | x |" for w in r.text.split(" "))]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text is not None}
    for r in catalogue.queries()["t11_tables"](spark, folder).collect():
        parts.setdefault(r.doc_id, []).append(r.n)
    # each further part repeats the header
    assert {i: sum(n) - (len(n) - 1) * len(head) for i, n in parts.items()} == {i: len(x) for i, x in body.items()}
    sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{folder}/part.parquet").collect()}
    got = {(r.path, r.smell, r.value) for r in catalogue.queries()["x2_python_smells"](spark, folder).collect()}
    god = {(f"m{k}.py", "GOD_CLASS", 1 + 2 * (n // 2 + 1)) for k, n in sizes.items() if n // 2 + 1 > 15}
    assert god and got == god | {(f"m{k}.py", "LONG_METHOD", n + 11) for k, n in sizes.items() if n + 11 > 50}


def test_faithfulness(spark):
    """By definition: items in any case, repeated ones each; empty answers and missing items are 0."""
    answers = spark.createDataFrame([(1, "The Cache is in Redis"), (2, ""), (3, None), (4, "alone")], "query_id long, answer string")
    context = spark.createDataFrame([(1, "cache"), (1, "REDIS"), (1, "qdrant"), (1, ""), (1, None), (1, "cache"), (2, "x"), (3, "x"), (9, "x")], "query_id long, item string")
    got = {r.query_id: (r.n_items, r.faithfulness) for r in ranking.faithfulness(answers, context).collect()}
    assert got == {1: (4, 0.75), 2: (1, 0.0), 3: (1, 0.0), 4: (0, 0.0)}


def test_within_names_without_a_table_of_candidates(spark):
    """each query has its own names; the candidates of 2 queries, 2 x 3,000 rows, are in no join or exchange."""
    docs = spark.range(3000).selectExpr("id", "concat('w', id % 7, ' w', id % 11) as text", "if(id % 100 = 0, null, concat('n', id % 3)) as name")
    vectors = spark.range(3000).selectExpr("id", "array(cast(id % 5 as double), cast(id % 9 as double) + 1) as vec")
    queries = spark.createDataFrame([(1, "w1 w2", [1.0, 0.0]), (2, "w3", [0.0, 1.0]), (3, "w4", [1.0, 1.0])], "query_id long, text string, vec array<double>")
    names = spark.createDataFrame([(1, "n0"), (1, "n1"), (1, "n2"), (2, "n1"), (2, "n2"), (9, "n1")], "query_id long, name string")
    got = retrieval.hybrid_within(queries, vectors, docs, names, 10)
    want = []
    for q, keep in ((1, "name is not null"), (2, "name in ('n1', 'n2')")):
        one, ids = queries.where(f"query_id = {q}"), docs.where(keep).select("id")
        want += map(tuple, retrieval.hybrid(one, vectors, docs.select("id", "text"), ids, 10).select("query_id", "id", "score", "rn").collect())
    rows = sorted(map(tuple, got.select("query_id", "id", "score", "rn").collect()))
    assert rows == sorted(want)
    assert "qv" not in got._jdf.queryExecution().toString()
    import unittest.mock as mock

    with mock.patch.object(retrieval, "NAMES", 2):
        assert sorted(map(tuple, retrieval.hybrid_within(queries, vectors, docs, names, 10).select("query_id", "id", "score", "rn").collect())) == rows


def test_files_of_one_partition_are_parsed_by_many_tasks_and_copies_once(spark, monkeypatch):
    """a table of many small files is one split; it was parsed by one task, each copy again."""
    body = "import os\nclass A(os.X):\n    def run(self):\n        return os.getenv(len('x'))()\n"
    files = spark.createDataFrame([(f"d/m{i}.py", body) for i in range(64)], "path string, content string").coalesce(1)
    got = memory.code_chunks(files)
    assert got.rdd.getNumPartitions() >= 4
    assert got.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 1
    rows = {(r.path, r.name, tuple(r.calls), tuple(r.bases), r.parent_class) for r in got.collect()}
    calls = ("len", "os.getenv", "os.getenv(len('x'))")
    assert rows == {(f"d/m{i}.py", n, calls, b, c) for i in range(64) for n, b, c in (("A", ("os.X",), None), ("run", (), "A"))}


def test_untested_parses_once(spark):
    """functions and tests come from one reading of the chunks."""
    files = spark.createDataFrame([("a/x.py", "def f():\n    pass\n"), ("a/test_x.py", "def g():\n    pass\n"), ("y.py", "def f():\n    pass\ndef f():\n    pass\n"), ("b/x.py", "def _h():\n    pass\n")], "path string, content string")
    got = memory.untested_functions(memory.code_chunks(files))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert sorted(map(tuple, got.collect())) == [("y.py", "f")]


def test_terms_are_counted_in_their_row(spark):
    """no exchange of terms; an idf search sends on k rows a query and task."""
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "C c a " * 300), (5, "\u00e9 \u00df x")], "id long, text string")
    posts = retrieval.postings(docs)
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.id, r.term, r.tf, r.doc_len) for r in posts.collect())
    assert rows == [(1, "a", 1, 3), (1, "b", 2, 3), (4, "a", 300, 900), (4, "c", 600, 900), (5, "x", 1, 1)]
    queries = spark.createDataFrame([(1, "a b"), (2, "c zzz"), (3, None)], "query_id long, text string")
    got = retrieval.bm25(queries, docs, 2, n_docs=5)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.bm25(queries, posts, 2, n_docs=5).select(got.columns).collect()))
    pairs = spark.createDataFrame([(1, 4), (1, 2), (4, 5), (1, 1), (9, 1)], "a long, b long")
    cos = {(r.a, r.b): r.cosine for r in ranking.cosine_pairs(pairs, docs).collect()}
    assert cos == {(1, 4): 0.2, (1, 2): 0.0, (4, 5): 0.0, (1, 1): 1.0, (9, 1): 0.0}


def test_batches_of_long_rows_are_small(spark):
    """a batch of 3,000 rows of 20,000 characters reached Python as one."""
    from quern.plans.registry import Tables

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    Tables(spark, "/root/testdata/sf0.001")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 20000) as text")
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5 << 20


def test_clones_of_several_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 6), 1.0, float(i % 4)]) for i in range(60)], "id long, vec array<double>")
    got = dml.clones(vectors, 0.9, limit=40, block=16)
    assert list(map(tuple, got.collect())) == list(map(tuple, dml.clones(vectors, 0.9, limit=40).collect()))


#: Rows of the queries on project files for the documents of ``test_files_of_empty_documents``.
PROJECT_ROWS = {
    "h8_foundation": [("a", 3), ("below", 2), ("empty", 2), ("old", 1), (None, 2)],
    "s13_registry": [("a", "a", 1), ("below", "below", 0), ("empty", "empty", 0), (None, None, 0)],
    "t16_summary_chunks": [(p, k, p and f"{p} {n}", p and f"summary://{p}/{k}") for p in ("a", "below", "empty", None) for k, n in (("repo_summary", "Repository Summary"), ("project_profile", "Project Profile"))] + [("a", "module_summary", "src Module Summary", "summary://a/module/src")],
    "x17_verification": [("a", "none"), ("below", "none"), ("empty", "none"), (None, "python")],
    "x6_profile": [("a", "", "", "main.py", 3), ("below", "Angular", "", "", 2), ("empty", "", "", "", 3), (None, "Python", "pip", "", 2)],
    "x7_profile": [("a", "python", "src", 2), ("below", "", "", 0), ("empty", "", "", 0), (None, "", "", 0)],
}


@pytest.mark.parametrize("name", PROJECT_ROWS)
def test_files_of_empty_documents(spark, tmp_path, name):
    """A document of no length has no path (1 GB failed by a remainder by zero); neither has a negative place of 0; files of no project count."""
    docs = [(7, "a", 100), (14, "a", 100), (1, "a", 0), (2, "empty", 0), (3, "empty", None), (None, "empty", 5), (-1, "below", 5), (-2, "below", 5), (1, None, 5), (4, None, 0)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,)], "r_regionkey long").write.parquet(f"{tmp_path}/region.parquet")
    got = catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(PROJECT_ROWS[name], key=str)
