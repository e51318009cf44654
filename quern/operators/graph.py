"""Property-graph operators on edge tables (src, rel, dst).

Walks that return the nearest nodes keep a frontier per seed that never has more nodes than are returned; ``walk`` returns all nodes.
Neither carries paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions.text import ladder
from quern.session import stage

#: Names of neighbours that go to the executors at once.
NAMES = 1_000_000


def walk(seeds: DataFrame, edges: DataFrame, hops: int, reverse: bool = False, types: list[str] | None = None) -> DataFrame:
    """(seed, node, distance): nodes reached from each seed in 1..hops steps along edges of ``types``, at their least distance.

    ``seeds``: (seed), a node that starts its own walk, or (seed, node), several start nodes under one name.
    """
    some = edges if types is None else edges.where(F.col("rel").isin(types))
    step = some.select(F.col("dst" if reverse else "src").alias("_from"), F.col("src" if reverse else "dst").alias("node")).distinct()
    at = seeds.select("seed", F.col("node" if "node" in seeds.columns else "seed").alias("node"))
    found = None
    for d in range(1, hops + 1):
        at = at.withColumnRenamed("node", "_from").join(step, "_from").select("seed", "node").distinct()
        part = at.withColumn("distance", F.lit(d))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("seed", "node").agg(F.min("distance").alias("distance"))


def _adjacency(edges: DataFrame, reverse: bool, types: list[str] | None, least: int) -> DataFrame:
    """(_from, node): the ``least`` neighbours of each node by name. A hub is cut in the tasks that read it."""
    some = edges if types is None else edges.where(F.col("rel").isin(types))
    step = some.select(F.col("dst" if reverse else "src").alias("_from"), F.col("src" if reverse else "dst").alias("node")).distinct()
    w = Window.partitionBy("_from").orderBy("node")
    return step.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= least).drop("_k")


def _grown(lists: list, limit: int):
    """Of rows (seed, front, found, known) the next front: the least names that the front's ``lists`` (_from, _next) add to the known ones, up to
    ``limit`` in all."""
    # names are compared by their numbers in the order of their bytes, as Spark sorts them
    names = sorted({n for r in lists for n in r[1]}, key=str.encode)
    code = {n: i for i, n in enumerate(names)}
    after = {r[0]: np.array([code[n] for n in r[1]], np.int64) for r in lists}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for front, known in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                reach = [after[n] for n in front if n in after] if len(known) < limit else []
                fresh = np.unique(np.concatenate(reach)) if reach else np.zeros(0, np.int64)
                fresh = fresh[~np.isin(fresh, [code[n] for n in known if n in code])]
                out.append([names[i] for i in fresh[: limit - len(known)]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string())), b.column(2)], names=["seed", "front", "found"])

    return run


def nearest_walk(seeds: DataFrame, edges: DataFrame, hops: int, limit: int, reverse: bool = False, types: list[str] | None = None, skip_seed: bool = False) -> DataFrame:
    """(seed, node, distance, rn): the ``limit`` nearest nodes of each seed within 1..hops steps, by distance, then name.

    The same rows as the first ``limit`` of ``walk``, at a bounded cost. A hop keeps no more new nodes of a seed than it still
    wants, the least names first; a seed that has all is not expanded again, and one that lacks some has its whole frontier, so
    the cut loses nothing. Of a node's neighbours only the least ``limit`` names can be known or wanted, so hubs are cut to these
    before the join. After the first hop a seed is one row, which grows where it is as long as the neighbours of all nodes that have both
    neighbours and a way in are at most NAMES names; more are joined.
    ``skip_seed``: the seed's own name is walked through like others, but is no result.
    """
    most, limit = limit, limit + 1 if skip_seed else limit
    pairs = stage(_adjacency(edges, reverse, types, limit), "adjacency")
    lists = pairs.groupBy("_from").agg(F.collect_list("node").alias("_next"))
    starts = seeds.select("seed", F.col("node" if "node" in seeds.columns else "seed").alias("_from"))
    reached = starts.join(pairs, "_from").select("seed", "node").distinct()
    first = reached.withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("_k") <= limit)
    state = first.groupBy("seed").agg(F.array_sort(F.collect_list("node")).alias("front"))
    state = state.withColumn("found", F.transform("front", lambda n: F.struct(F.lit(1).alias("distance"), n.alias("node"))))
    # nodes that a walk can pass: only they are expanded after the first hop
    passed = stage(lists.join(pairs.select(F.col("node").alias("_from")).distinct(), "_from", "left_semi"), "passed") if hops > 1 else None
    few = passed.collect() if hops > 1 and (passed.agg(F.sum(F.size("_next") + 1)).first()[0] or 0) <= NAMES else None
    for d in range(2, hops + 1):
        if few is not None:
            kind = dict(state.dtypes)
            known = state.select("seed", "front", "found", F.transform("found", lambda x: x["node"]).alias("known"))
            state = known.mapInArrow(_grown(few, limit), f"seed {kind['seed']}, front array<string>, found {kind['found']}")
            state = state.select("seed", "front", F.concat("found", F.transform("front", lambda n: F.struct(F.lit(d).alias("distance"), n.alias("node")))).alias("found"))
            continue
        live = state.where(F.size("found") < limit).select("seed", F.explode("front").alias("_from"))
        reach = live.join(lists, "_from").groupBy("seed").agg(F.flatten(F.collect_list("_next")).alias("reach"))
        fresh = F.array_except("reach", F.transform("found", lambda x: x["node"]))
        front = F.coalesce(F.slice(F.array_sort(fresh), F.lit(1), F.lit(limit) - F.size("found")), F.array().cast("array<string>"))
        state = state.join(reach, "seed", "left").select("seed", front.alias("front"), "found")
        state = state.select("seed", "front", F.concat("found", F.transform("front", lambda n: F.struct(F.lit(d).alias("distance"), n.alias("node")))).alias("found"))
    if skip_seed:
        state = state.withColumn("found", F.slice(F.filter("found", lambda x: x["node"] != F.col("seed")), 1, most))
    return state.select("seed", F.posexplode("found").alias("rn", "x")).select("seed", "x.node", "x.distance", (F.col("rn") + 1).cast("long").alias("rn"))


def callers(seeds: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """The nearest nodes that reach a seed within three steps."""
    return nearest_walk(seeds, edges, 3, limit, reverse=True, types=fixed.CALLER_TYPES)


def dependencies(seeds: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """The nearest nodes that a seed reaches within two steps."""
    return nearest_walk(seeds, edges, 2, limit, types=fixed.DEPENDENCY_TYPES)


def nearest(found: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` nearest nodes of each seed of a whole walk, by distance, then name."""
    w = Window.partitionBy("seed").orderBy("distance", "node")
    return found.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= limit)


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 3, limit: int = 15) -> DataFrame:
    """Names around each seed, the seed itself included at distance 0."""
    reached = nearest_walk(seeds, edges, hops, limit, types=fixed.EXPAND_TYPES, skip_seed=True).select("seed", "node", "distance")
    return reached.union(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): edges at either end, over the largest degree."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    d = ends.groupBy("node").agg(F.count("*").alias("degree"))
    top = d.agg(F.max("degree").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("node", "degree", F.round(F.col("degree") / F.col("top"), 6).alias("centrality"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 200) -> tuple[DataFrame, int]:
    """(node, rank), the ranks summing to 1, and the rounds that were needed.

    Power iteration until the ranks change by less than ``tolerance`` in all. Edges that repeat count as often; what nodes without
    outgoing edges hold goes to all nodes alike. Such nodes only receive, and what they hold is what the others lack: the rounds move the
    ranks of nodes with outgoing edges along the edges between these, and all edges are read again once, for the last round. How far that
    round moves all ranks is bounded by how far the givers moved before it, so a round more than needed may be made, none less. Each round is
    staged, so plans don't grow.
    """
    some = edges.select("src", "dst").where("src is not null and dst is not null")
    out = stage(some.groupBy("src").agg(F.count("*").alias("total")), "out")
    ends = some.groupBy("dst").agg(F.count("*").alias("_n"))
    nodes = stage(ends.select(F.col("dst").alias("node")).join(out.select(F.col("src").alias("node")), "node", "full").select("node"), "nodes")
    n, givers = nodes.count(), out.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank")), 0
    # edges between givers
    core = some.join(out.select(F.col("src").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("n"))
    shares = stage(core.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")).repartition("src"), "shares")
    ranks, done, base = out.select(F.col("src").alias("node"), F.lit(1.0 / n).alias("rank")), 0, (1 - damping + damping * (n - givers) / n) / n
    while True:
        given = shares.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("given"))
        rank = F.lit(base) + damping * F.coalesce("given", F.lit(0.0))
        both = stage(ranks.join(given, "node", "left").select("node", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved")), "ranks")
        moved, total = both.agg(F.coalesce(F.sum("moved"), F.lit(0.0)), F.coalesce(F.sum("rank"), F.lit(0.0))).first()
        before, base = base, (1 - damping + damping * max(0.0, 1 - total)) / n
        ranks, done = both.drop("moved"), done + 1
        if damping * moved + n * abs(base - before) < tolerance or done + 1 >= rounds:
            break
    given = some.join(ranks.select(F.col("node").alias("src"), "rank").join(out, "src").select("src", (F.col("rank") / F.col("total")).alias("part")), "src")
    given = given.groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("given"))
    return nodes.join(given, "node", "left").select("node", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank")), done + 1


def communities(edges: DataFrame, limit: int = 10) -> DataFrame:
    """Nodes with more than one different neighbour by a call or dependency in either direction, the largest neighbourhoods first."""
    some = edges.where(F.col("rel").isin(fixed.COMMUNITY_TYPES))
    both = some.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(some.select(F.col("dst"), F.col("src"))).where("node <> other").distinct()
    return both.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "node").limit(limit)


def entities(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """seed (the file), node, label, kind: the nodes of each file, and the module that has its name.

    ``nodes``: name, label, file_path, kind; ``files``: path.
    """
    by_path = nodes.join(files, F.col("file_path") == F.col("path"))
    by_name = nodes.where((F.col("label") == "Module") & (F.col("file_path").isNull() | (F.col("file_path") != F.col("name")))).join(files, F.col("name") == F.col("path"))
    return by_path.unionByName(by_name).select(F.col("path").alias("seed"), F.col("name").alias("node"), "label", "kind")


def change_report(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """seed (file), n_entities, n_callers, n_dependencies, score, risk and the files of the callers, for changed files.

    Callers and dependencies are those of all entities of a file together, as many as the traces show.
    """
    of = entities(nodes, files)
    seeds = of.select("seed", "node").distinct()
    up, down = callers(seeds, edges), dependencies(seeds, edges)
    n = lambda df, name: df.groupBy("seed").agg(F.count("*").alias(name))
    where = nodes.where("file_path is not null").select(F.col("name").alias("node"), "file_path").distinct()
    hit = up.join(where, "node").groupBy("seed").agg(F.array_join(F.array_sort(F.collect_set("file_path")), "|").alias("affected"))
    out = files.select(F.col("path").alias("seed")).distinct().join(n(of, "n_entities"), "seed", "left").join(n(up, "n_callers"), "seed", "left").join(n(down, "n_dependencies"), "seed", "left")
    out = out.join(impact(up, down), "seed", "left").join(hit, "seed", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("seed", zero("n_entities"), zero("n_callers"), zero("n_dependencies"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("risk", F.lit("low")).alias("risk"), F.coalesce("affected", F.lit("")).alias("affected"))


def impact(callers: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Score of each seed: sum of 1 / distance over callers plus 0.2 / distance over dependencies; 2 places; risk text."""
    part = lambda df, w: df.select("seed", (F.lit(w) / F.col("distance")).alias("x"))
    s = part(callers, 1.0).union(part(dependencies, 0.2)).groupBy("seed").agg(F.round(F.sum("x"), 2).alias("score"))
    return s.withColumn("risk", ladder([(F.col("score") > 10, "high"), (F.col("score") > 3, "medium")], "low"))


def review(score: Column) -> tuple[Column, Column]:
    """Reviewer risk and whether a person has to approve."""
    r = F.round(score / 10, 4)
    return r, r > 0.7


def edge_weights(edges: DataFrame, limit: int = 20) -> DataFrame:
    return edges.groupBy("src", "rel", "dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "rel", "dst").limit(limit)


def relations(chunks: DataFrame) -> DataFrame:
    """Up to twelve kinds of edges (src_label, src, rel, dst_label, dst) of code chunks; each distinct edge once."""
    label = F.initcap("chunk_type")

    def edge(df: DataFrame, sl: Column, s: Column, rel: str, dl: str | Column, d: Column) -> DataFrame:
        return df.select(sl.alias("src_label"), s.alias("src"), F.lit(rel).alias("rel"), (F.lit(dl) if isinstance(dl, str) else dl).alias("dst_label"), d.alias("dst"))

    def each(column: str, rel: str, dst_label: str) -> DataFrame:
        return edge(chunks.withColumn("x", F.explode(column)), label, F.col("name"), rel, dst_label, F.col("x"))

    low = F.lower(F.coalesce("name", F.lit("")))
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    entity = chunks.where("is_entity")
    parts = [
        edge(chunks, F.lit("Module"), F.col("file_path"), "CONTAINS", label, F.col("name")),
        edge(chunks.where("parent_class is not null and parent_class <> ''"), F.lit("Class"), F.col("parent_class"), "OWNS", "Function", F.col("name")),
        edge(chunks.withColumn("x", F.explode("imports")), F.lit("Module"), F.col("file_path"), "DEPENDS_ON", "Import", F.col("x")),
        each("calls", "CALLS", "Function"),
        each("bases", "IMPLEMENTS", "Class"),
        each("config_keys", "USES_CONFIG", "Config"),
        each("endpoints", "EXPOSES_ENDPOINT", "Endpoint"),
        edge(chunks.where("is_dto"), label, F.col("name"), "OWNS", "DTO", F.col("name")),
        edge(chunks.where("is_migration"), label, F.col("name"), "OWNS", "Migration", F.coalesce(F.col("name"), F.element_at(F.split("file_path", "/"), -1))),
        edge(chunks.where("is_ui_component"), label, F.col("name"), "OWNS", "UIComponent", F.col("name")),
        edge(chunks.where("is_business_rule"), label, F.col("name"), "RELATES_TO_RULE", "BusinessRule", F.col("name")),
        edge(entity, label, F.col("name"), "OWNS", "Entity", F.col("name")),
        edge(entity.where(some(fixed.WRITE_WORDS)), label, F.col("name"), "MUTATES_ENTITY", "Entity", F.col("name")),
        edge(entity.where(~some(fixed.WRITE_WORDS) & some(fixed.READ_WORDS)), label, F.col("name"), "READS_ENTITY", "Entity", F.col("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by key (src, rel, dst), known labels only; a new edge's properties override an old one's."""
    good = new.where(F.col("rel").isin(fixed.EDGE_TYPES))
    both = old.withColumn("_v", F.lit(0)).unionByName(good.withColumn("_v", F.lit(1)))
    return both.groupBy("src", "rel", "dst").agg(F.max_by("props", "_v").alias("props"))


def check_labels(edges: DataFrame) -> DataFrame:
    """Edges with ``ok``: whether their labels and type are in the ontology. ``strict_labels`` raises instead."""
    return edges.withColumn("ok", F.col("rel").isin(fixed.EDGE_TYPES) & F.col("src_label").isin(fixed.NODE_LABELS) & F.col("dst_label").isin(fixed.NODE_LABELS))


def strict_labels(edges: DataFrame) -> DataFrame:
    """The same edges; the query fails at the first that the ontology doesn't know."""
    good = check_labels(edges)
    return good.withColumn("rel", F.when(F.col("ok"), F.col("rel")).otherwise(F.raise_error(F.concat(F.lit("not in the ontology: "), F.col("rel"))))).drop("ok")


def summary(kind: Column, name: Column, detail: Column) -> Column:
    """One line on a node; missing parts are skipped."""
    return F.concat_ws(" | ", kind, name, detail)
