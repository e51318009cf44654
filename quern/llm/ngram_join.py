"""N-gram Jaccard self-join by MinHash bands with exact verification.

Texts are sets of runs of five words. The number of bands is chosen so that a pair at the threshold shares a band with the
target recall; rows a band set how rarely unlike texts meet. Equal texts are one node (64-bit content hash, so two different
texts among n share one with a chance of n^2 / 2^65). Nodes that share band keys form candidate components, whose pairs of
comparable size are all verified on the full n-gram sets, block by block; classes are the components of the verified links.

Defined results: null counts as empty; a text without words has no n-grams, no links and a class of its own, even among
copies; a text of one to four words has one n-gram, all of it; texts are read whole; rows with the same id are separate
rows, each in the class of its text, and a class is named by its least id; a null id counts as the largest, and a class of
null ids alone has a null name; an empty table gives an empty result; further columns are kept by ``deduplicate`` and ignored
by ``join``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel as K
from quern.llm.components import components
from quern.llm.similar import Sets, band_edges, bucket_count, classes, packed_stars, verified
from quern.llm.tables import parquet, small_batches, small_side, spread_join, stage

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.995, 5


def ngram_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The different n-gram hashes of each text."""
    w = K.words(*K.utf8(texts))
    g, at = K.grams(w.hash, w.at, n)
    return [np.unique(g[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def candidate_bands(rows: DataFrame, buckets: int, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, band_rows: int = ROWS) -> DataFrame:
    """``packed_stars`` rows from (node, text)."""
    bands = K.choose_bands(threshold, recall, band_rows)

    def keyed(batches):
        for b in batches:
            node = b.column(0).to_numpy()
            w = K.words(*K.utf8(b.column(1)))
            g, at = K.grams(w.hash, w.at, n)
            full = np.flatnonzero(np.diff(at) > 0)
            if len(full):
                keys = K.band_keys(K.minhash(g, at, bands * band_rows)[full], bands, band_rows)
                yield keys.ravel().view(np.int64), np.repeat(node[full], bands)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(lambda it: packed_stars(keyed(it), buckets), "bucket int, edges boolean, a binary, b binary")


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, text, node of every row; node is null for a text without words."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return base.withColumn("node", node_of(F.col("text")))


def node_of(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))


def linked(base: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and of every text with words node, rep (least id), n (rows), links (rows of similar
    texts) and comp (its class)."""
    spark = base.sparkSession
    small_batches(spark)
    some = base.where("node is not null")
    spots = stage(base.select("doc_id", "node"), "spots")
    nodes = stage(spots.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    buckets = bucket_count(spark, nodes.count() * K.choose_bands(threshold, recall, ROWS))
    comps = components(band_edges(candidate_bands(some.select("node", "text"), buckets, threshold=threshold, recall=recall), buckets))
    chosen = stage(comps.join(nodes, "node"), "chosen")
    side = small_side(chosen.select(F.col("node").alias("_node"), "comp", F.col("n").alias("weight"), "rep"))
    members = some.join(side, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("comp", "node", "weight", "text").dropDuplicates(["node"])
    found = stage(verified(members, Sets(ngram_sets), threshold), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return spots, stage(nodes.join(links, "node", "left").join(classes(found), "node", "left").select("node", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("comp")), "labelled")


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least id of the class) and n_links (other rows at or over the threshold) for every row."""
    spots, labelled = linked(_rows(docs, id_col, text), threshold, recall)
    # only texts with company differ from the default, so the table to join is short
    some = labelled.where("n > 1 or links > 0")
    named = some.groupBy("comp").agg(F.min("rep").alias("class_id"))
    per_node = stage(some.join(named, "comp").select("node", "class_id", (F.col("n") - 1 + F.col("links")).alias("n_links")), "classes")
    full = spread_join(spots.where("node is not null"), per_node, "node", "left", frequent=labelled)
    alone = spots.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns: the one with the least id (then the least text hash; any of wholly equal ones).

    Rows are told apart by id and text, not by id alone: a text that nobody shares stays, whatever its id, and of rows that
    are equal in both one stays. Texts without words stay.
    """
    spots, labelled = linked(_rows(docs, id_col, text), threshold)
    # texts with company: copies or links
    some = stage(labelled.where("n > 1 or links > 0").select("node", "comp"), "company")
    pairs = stage(spread_join(spots.where("node is not null"), some, "node", frequent=labelled).groupBy("comp", "doc_id", "node").agg(F.count("*").alias("n")), "pairs")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "node")
    first = stage(pairs.groupBy("comp").agg(F.min(order).alias("first")), "firsts")
    told = stage(spread_join(pairs, first, "comp").select("doc_id", "node", "n", (order == F.col("first")).alias("stays")), "told")
    key, uid = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, node_of(F.col(text)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(uid)) & (F.col(key) == F.col(f"{key}_node"))
    side = lambda t: small_side(t.select(F.col("doc_id").alias(uid), F.col("node").alias(f"{key}_node")))
    gone, repeated = told.where("not stays"), told.where("stays and n > 1")
    left = keyed.join(side(gone), same, "left_anti")
    if repeated.isEmpty():
        return left.drop(key)
    # equal rows under one id: as many as the id repeats, so they alone are gathered
    twice = left.join(side(repeated), same, "left_semi")
    once = left.join(side(repeated), same, "left_anti")
    return once.unionByName(twice.dropDuplicates([id_col, key])).drop(key)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(parquet(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.c + y.c - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT doc_id, (SELECT min(low) FROM r WHERE node = doc_id) AS class_id, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links FROM documents
"""
