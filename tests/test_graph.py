"""Bounded walks against whole walks, PageRank against a plain power iteration."""

import random

import pytest

from quern.operators import graph


def random_edges(seed, nodes=60, n=240):
    rng = random.Random(seed)
    kinds = ["CALLS", "OWNS", "DEPENDS_ON", "IMPLEMENTS"]
    out = [(f"n{rng.randrange(nodes)}", rng.choice(kinds), f"n{rng.randrange(nodes)}") for _ in range(n)]
    # a hub in both directions, a loop, repeats
    out += [("n0", "CALLS", f"h{k}") for k in range(80)] + [(f"h{k}", "CALLS", "n1") for k in range(80)] + [("n2", "CALLS", "n2"), ("n2", "CALLS", "n0"), ("n2", "CALLS", "n0")]
    return out


@pytest.mark.parametrize("seed,limit,skip", [(1, 3, False), (2, 10, True), (3, 1, True), (4, 100, False)])
def test_nearest_walk_equals_the_whole_walk(spark, seed, limit, skip):
    edges = spark.createDataFrame(random_edges(seed), "src string, rel string, dst string")
    seeds = [(f"n{i}", f"n{i}") for i in range(0, 60, 3)] + [("many", f"n{i}") for i in range(40)] + [("n2", "n0"), ("gone", "nowhere")]
    df = spark.createDataFrame(seeds, "seed string, node string")
    for hops, reverse in ((1, True), (3, False), (3, True)):
        whole = graph.walk(df, edges, hops, reverse, ["CALLS", "OWNS"])
        want = graph.nearest(whole.where("node <> seed") if skip else whole, limit)
        got = graph.nearest_walk(df, edges, hops, limit, reverse, ["CALLS", "OWNS"], skip)
        rows = lambda x: sorted((r.seed, r.node, r.distance, r.rn) for r in x.collect())
        assert rows(got) == rows(want)


def test_nearest_walk_makes_few_rows(spark):
    """Every seed reaches a hub of 3,000 neighbours; no hop makes more rows than seeds times limit times (limit + 1)."""
    edges = spark.range(3000).selectExpr("'hub' as src", "'CALLS' as rel", "concat('x', id) as dst").union(spark.range(50).selectExpr("concat('s', id)", "'CALLS'", "'hub'"))
    seeds = spark.range(50).selectExpr("concat('s', id) as seed")
    got = graph.nearest_walk(seeds, edges, 2, 5)
    assert got.count() == 250
    plan = got._jdf.queryExecution()
    got.collect()
    # hubs are cut before they are joined
    assert graph._adjacency(edges, False, None, 5).count() == 55
    assert "WindowGroupLimit" in plan.toString()


def test_seeds_grow_in_place(spark, monkeypatch):
    """After the first hop few neighbours are no join: no exchange holds a seed's row again; more neighbours are joined, with the same rows."""
    edges = spark.createDataFrame(random_edges(7), "src string, rel string, dst string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(60)], "seed string")
    one, three = (graph.nearest_walk(seeds, edges, h, 5, True, ["CALLS", "OWNS"])._jdf.queryExecution().optimizedPlan().toString().count("Join") for h in (1, 3))
    assert one == three
    rows = lambda: sorted((r.seed, r.node, r.distance, r.rn) for r in graph.nearest_walk(seeds, edges, 3, 5, True, ["CALLS", "OWNS"]).collect())
    got = rows()
    monkeypatch.setattr(graph, "NAMES", 3)
    assert rows() == got


def power_iteration(edges, damping=0.85, rounds=300):
    nodes = sorted({x for e in edges for x in (e[0], e[2])})
    out = {v: [e[2] for e in edges if e[0] == v] for v in nodes}
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(rounds):
        held = sum(rank[v] for v in nodes if not out[v])
        new = {v: (1 - damping + damping * held) / len(nodes) for v in nodes}
        for v in nodes:
            for w in out[v]:
                new[w] += damping * rank[v] / len(out[v])
        rank = new
    return rank


def test_pagerank_equals_power_iteration(spark):
    """Hubs, loops, repeated edges, nodes without outgoing edges."""
    rows = random_edges(5, nodes=30, n=60) + [("n3", "CALLS", "end")]
    edges = spark.createDataFrame([*rows, (None, "CALLS", "n1")], "src string, rel string, dst string")
    ranks, rounds = graph.pagerank(edges, tolerance=1e-5)
    got, want = {r.node: r.rank for r in ranks.collect()}, power_iteration(rows)
    assert set(got) == set(want) and abs(sum(got.values()) - 1) < 1e-9
    assert max(abs(got[v] - want[v]) for v in want) < 1e-5 and 3 < rounds < 100
    few, n = graph.pagerank(edges, tolerance=0.5)
    assert n < rounds and few.count() == len(want)
    assert graph.pagerank(edges.limit(0))[0].collect() == []


def test_pagerank_rounds_leave_receivers_out(spark, monkeypatch):
    """3,000 nodes that only receive: a round moves the ranks of the two others, and all ranks are right."""
    rows = [("a", "CALLS", "b"), ("b", "CALLS", "a"), *(("b" if k % 3 else "a", "CALLS", f"x{k}") for k in range(3000))]
    edges = spark.createDataFrame(rows, "src string, rel string, dst string")
    sizes, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name="stage": sizes.append((name, (out := real(df, name)).count())) or out)
    ranks, _ = graph.pagerank(edges, tolerance=1e-6)
    got = {r.node: r.rank for r in ranks.collect()}
    rank, n = {v: 1 / 3002 for v in "ab"}, 3002
    for _ in range(50):
        held = 1 - sum(rank.values())
        base = (0.15 + 0.85 * held) / n
        rank = {"a": base + 0.85 * rank["b"] / 2001, "b": base + 0.85 * rank["a"] / 1001}
    want = rank | {f"x{k}": base + 0.85 * (rank["b"] / 2001 if k % 3 else rank["a"] / 1001) for k in range(3000)}
    assert set(got) == set(want) and max(abs(got[v] - want[v]) for v in want) < 1e-6 and abs(sum(got.values()) - 1) < 1e-9
    assert max(n for name, n in sizes if name in ("shares", "links", "ranks")) <= 2
