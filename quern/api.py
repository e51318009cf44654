"""The engine's facade: each method builds one lazy plan over the tables it was given.

``embed`` and ``score`` are hooks: embed(texts: pandas.Series) -> arrays of floats, score(query, text, name) -> a column in
[0, 1]. The defaults need no model: hashed term vectors, and the local rerank score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions.text import lookup, word_tokens
from quern.operators import chunking, dml, graph, memory, ranking, retrieval
from quern.session import plain_unions, stage
from quern.trace import Trace


def hashed_embedding(texts: pd.Series, size: int = 64) -> pd.Series:
    """Unit vectors of signed hashed terms; texts of under 10 characters become zero vectors."""
    import re
    import zlib

    out = []
    for t in texts:
        v = np.zeros(size)
        if t is not None and len(t) >= 10:
            for w in re.findall(r"[a-z0-9_]+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h & 0x80000000 else -1.0
            n = np.linalg.norm(v)
            v = v / n if n else v
        out.append(v.tolist())
    return pd.Series(out)


def embed_column(text: Column, embed: Callable[[pd.Series], pd.Series] = hashed_embedding) -> Column:
    return F.pandas_udf(embed, "array<double>")(text)


class Engine:
    """chunks (id, source, text, kind, collection, updated_days), vectors (id, vec), edges (src, rel, dst) by chunk name.

    With ``stored`` the postings of all chunks are written once, and every search reads those of its terms only. With a ``trace`` each
    step of the read path is run and recorded as it comes; without, all is one lazy plan.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame | None = None, edges: DataFrame | None = None, memories: DataFrame | None = None, score: Callable[[Column, Column, Column], Column] = ranking.rerank_score, stored: bool = False, trace: Trace | None = None):
        plain_unions(spark)
        self.spark, self.chunks, self.edges, self.memories, self.score = spark, chunks, edges, memories, score
        self.vectors = vectors if vectors is not None else chunks.select("id", embed_column(F.col("text")).alias("vec"))
        self.stored, self._index, self.trace = stored, None, trace

    @property
    def corpus(self) -> DataFrame | retrieval.Index:
        """What sparse search reads: the chunks, or their stored postings."""
        texts = self.chunks.select("id", "text")
        if not self.stored:
            return texts
        if self._index is None:
            self._index = retrieval.Index(texts)
        return self._index

    def _step(self, name: str, df: DataFrame) -> DataFrame:
        return df if self.trace is None else self.trace.step(name, df)

    def _queries(self, queries: DataFrame) -> DataFrame:
        return queries if "vec" in queries.columns else queries.withColumn("vec", embed_column(F.col("text")))

    def search_code(self, queries: DataFrame, keep: DataFrame | None = None, fetch: int = 30, k: int = 10) -> DataFrame:
        """The whole read path for (query_id, text[, vec]): classify, hybrid search, augmentation by the graph, rerank, greedy
        dedup, centrality and recency, final score, packing to the type's budget; one row a kept chunk with the gate's verdict."""
        q = self._step("classify", self._queries(queries).withColumn("query_type", retrieval.classify(F.col("text"))))
        hits = self._step("retrieve", retrieval.hybrid(q, self.vectors, self.corpus, keep, k=fetch))
        if self.edges is not None:
            hits = self._step("augment", self.augment(q, hits, fetch))
        full = hits.drop("rn").join(self.chunks, "id").join(q.select("query_id", F.col("text").alias("query_text"), "query_type"), "query_id")
        full = full.withColumn("rerank_score", self.score(F.col("query_text"), F.col("text"), F.col("source")))
        w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "id")
        ranked = self._step("rerank", full.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= F.lit(24)))
        kept = ranking.greedy_dedup(ranked.select(F.col("query_id").cast("string").alias("query_id"), "rn", "id", "text")).select(F.col("query_id").cast("long").alias("query_id"), "id")
        ranked = self._step("dedup", ranked.join(kept, ["query_id", "id"], "left_semi")).withColumn("score", ranking.min_max("score", "query_id"))
        if self.edges is not None:
            central = graph.degree(self.edges).select(F.col("node").alias("source"), "centrality")
            ranked = ranked.join(central, "source", "left")
        else:
            ranked = ranked.withColumn("centrality", F.lit(0.0))
        recency = 1 / (1 + 0.1 * F.col("updated_days"))
        ranked = ranked.withColumn("final_score", ranking.final_score(F.col("score"), F.col("kind"), F.col("rerank_score"), F.col("centrality"), recency))
        ranked = self._step("score", ranked)
        gate = ranking.answerability(ranked.drop("score").withColumnRenamed("final_score", "score").withColumn("kind", F.col("query_type")), "kind").select("query_id", "verdict")
        budget = lookup(F.col("query_type"), {t: n * fixed.CHARS_PER_TOKEN for t, n in fixed.TOKEN_BUDGET.items()})
        usable = ranking.fall_back(ranked, ~F.col("kind").isin("file", "module") | F.col("query_type").isin(fixed.WHOLE_FILE_TYPES))
        packed = self._step("pack", ranking.pack(usable.drop("rn"), budget, score="final_score", max_items=min(k, 8)))
        text, ratio = ranking.compress(F.col("text"))
        return packed.join(gate, "query_id").select("query_id", "query_type", "verdict", "rn", "id", "source", "final_score", "rerank_score", F.round("centrality", 6).alias("centrality"), ratio.alias("ratio"), text.alias("text"))

    def augment(self, queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
        """Hits joined with those of a search among chunks whose source is near a top-5 hit's in the graph; the best score of each
        id. Where ``queries`` have a type, only queries about relations or summaries are augmented."""
        # read three times: as many rows as queries times k
        hits = stage(hits, "hits") if self.trace is None else hits
        some = queries.where(F.col("query_type").isin(fixed.GRAPH_FIRST_TYPES)) if "query_type" in queries.columns else queries
        top = hits.where("rn <= 5").join(some.select("query_id"), "query_id", "left_semi").join(self.chunks.select("id", "source"), "id").select(F.col("source").alias("seed"), "query_id").distinct()
        near = graph.expand(top.select("seed").distinct(), self.edges).join(top, "seed").select("query_id", F.col("node").alias("source")).distinct()
        limited = near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("source"))).where("_r <= 20").drop("_r")
        named = self.chunks.select("id", "text", F.col("source").alias("name"))
        more = retrieval.hybrid_within(some, self.vectors, named, limited.withColumnRenamed("source", "name"), k)
        return retrieval.best_of(hits.select("query_id", "id", "score").union(more.select("query_id", "id", "score")), k)

    def explain(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """query_id, rn, id, source, text, n_words: the context of an explanation. Hybrid search for 2k of 3k candidates, reranked
        to k, near copies out, compressed; neither the graph nor a budget takes part."""
        q = self._queries(queries)
        hits = retrieval.hybrid(q, self.vectors, self.corpus, k=2 * k, prefetch=3 * k).drop("rn")
        full = hits.join(self.chunks.select("id", "source", "text"), "id").join(q.select("query_id", F.col("text").alias("query_text")), "query_id")
        best = ranking.rerank(full, k, "source")
        kept = ranking.greedy_dedup(best.select(F.col("query_id").cast("string").alias("query_id"), "rn", "id", "text")).select(F.col("query_id").cast("long").alias("query_id"), "id")
        text, _ = ranking.compress(F.col("text"))
        return best.join(kept, ["query_id", "id"], "left_semi").select("query_id", "rn", "id", "source", text.alias("text"), word_tokens(F.col("text")).alias("n_words"))

    def architecture(self, queries: DataFrame, k: int = 6) -> DataFrame:
        keep = self.chunks.where(F.col("kind") == "summary").select("id")
        return retrieval.hybrid(self._queries(queries), self.vectors, self.corpus, keep, k=k)

    def agent_docs(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """Redacted document chunks packed to 4000 tokens."""
        hits = retrieval.hybrid(self._queries(queries), self.vectors, self.corpus, self.chunks.where(F.col("kind") == "doc").select("id"), k=k).drop("rn").join(self.chunks.select("id", "text"), "id")
        text, risk = chunking.redact(F.col("text"))
        return ranking.pack(hits.withColumn("risk", risk).where("risk <= 0.8").withColumn("text", text), F.lit(16000)).select("query_id", "rn", "id", "text", "risk")

    def grep(self, needle: str, **options) -> DataFrame:
        return retrieval.grep(self.chunks, needle, path="source", **options)

    def change_impact(self, names: DataFrame) -> DataFrame:
        """Score and risk of changed names (seed)."""
        return graph.impact(graph.callers(names, self.edges), graph.dependencies(names, self.edges))

    def security_scan(self) -> DataFrame:
        return chunking.scan(self.chunks, "id", "text")

    def clone_detection(self, threshold: float = 0.95) -> DataFrame:
        return dml.clones(self.vectors, threshold)

    def recall(self, as_of: Column, layers: list[str] | None = None) -> DataFrame:
        return memory.recall(self.memories, as_of, layers)

    def run_eval(self, cases: DataFrame) -> DataFrame:
        """Mean hit@1, hit@3, hit@5 and MRR of cases (query_id, text, expected)."""
        hits = retrieval.hybrid(self._queries(cases), self.vectors, self.corpus, k=5).join(self.chunks.select("id", F.col("source").alias("path")), "id")
        e = ranking.evaluate(cases.select("query_id", "expected"), hits)
        return e.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("hit1", "hit3", "hit5", "mrr")], F.count("*").alias("cases"))
