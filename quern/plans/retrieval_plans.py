"""Retrieval queries on the driver's tables: documents are chunks, embeddings their vectors, benchmark items the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.text import lookup
from quern.operators import retrieval as R
from quern.operators.segments import Segments
from quern.plans import stored
from quern.plans.registry import query

TOK = "regexp_extract_all(lower({}), '[a-z0-9_]+')"


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def vector_queries(t):
    """Every vector whose number is divisible by 50 is a query."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def item_queries(t):
    """Every benchmark item is a query."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text", "lang", "source")


def mixed_queries(t):
    """Every benchmark item with the vector of its number: one text and one vector for each query."""
    return item_queries(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), "query_id")


#: The vectors of ``mixed_queries``.
MIXED = "q.vec_id IN (SELECT item_id FROM benchmark)"


def dense_sql(k=20, where="true", who="q.vec_id % 50 = 0"):
    return f"""dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) + 0.0 AS score
  FROM embeddings q, embeddings e WHERE {who} AND {where})) WHERE rn <= {k})"""


def sparse_sql(k=20, where="true", idf=False):
    weight = " * ln(1 + (nd - df + 0.5) / (df + 0.5))" if idf else ""
    extra = ", (SELECT term AS t2, count(*) AS df FROM post GROUP BY term) f, (SELECT count(*) AS nd FROM documents) n" if idf else ""
    cond = " AND t2 = p.term" if idf else ""
    return f"""tok AS (SELECT doc_id AS id, lang, source, {TOK.format('text')} AS t FROM documents),
post AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok WHERE {where}) GROUP BY ALL),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
  SELECT query_id, id, round(sum(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / 256)){weight}), 6) AS score FROM post p, qt{extra} WHERE p.term = qt.term{cond} GROUP BY query_id, id)) WHERE rn <= {k})"""


def fuse_sql(k=20):
    return f"""fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (1 + rn)), 6) AS score FROM (SELECT query_id, id, rn FROM dense UNION ALL SELECT query_id, id, rn FROM sparse) GROUP BY query_id, id)) WHERE rn <= {k})"""


@query("r1_dense_topk", f"WITH {dense_sql()} SELECT query_id, id, score, rn FROM dense")
def r1(t):
    return R.dense(vector_queries(t), vectors(t))


@query("r1_indexed", f"WITH {dense_sql()} SELECT query_id, id, score, rn FROM dense")
def r1_indexed(t):
    """From the stored lists, in exact mode."""
    return stored.vectors(t).search(vector_queries(t), exact=True)


@query("r1_probed")
def r1_probed(t):
    """From as many lists as reach the recall on the sample; a test holds the recall against a scan."""
    return stored.vectors(t).search(vector_queries(t))


@query("r2_bm25_topk", f"WITH {sparse_sql()} SELECT query_id, id, score, rn FROM sparse")
def r2(t):
    return R.bm25(item_queries(t), docs(t))


@query("r2_bm25_idf", f"WITH {sparse_sql(idf=True)} SELECT query_id, id, score, rn FROM sparse")
def r2_idf(t):
    return R.bm25(item_queries(t), docs(t), n_docs=t.documents.count())


@query("r2_indexed", f"WITH {sparse_sql(idf=True)} SELECT query_id, id, score, rn FROM sparse")
def r2_indexed(t):
    """From the stored index, of which only the queries' terms are read."""
    return stored.documents(t).search(item_queries(t), idf=True)


@query("r2_segments", f"WITH {sparse_sql(where='id % 7 <> 0')} SELECT query_id, id, score, rn FROM sparse")
def r2_segments(t):
    """The index after an upsert, one that replaces a third of it by the true texts and adds the rest, and a delete."""

    def build(folder):
        index = Segments(t.spark, folder)
        index.upsert(t.documents.where("doc_id % 3 = 0").select("doc_id", F.reverse("text").alias("text")), "doc_id", new=True)
        index.upsert(t.documents, "doc_id")
        index.delete(t.documents.where("doc_id % 7 = 0"), "doc_id")

    return Segments(t.spark, stored.once(t, "changed-segments", "documents", build)).search(item_queries(t))


@query("r3_rrf", f"WITH {dense_sql(who=MIXED)}, {sparse_sql()}, {fuse_sql()} SELECT query_id, id, score, rn FROM fused")
def r3(t):
    return R.hybrid(mixed_queries(t), vectors(t), docs(t))


@query("r4_local", f"WITH {dense_sql(20, 'e.vec_id IN (SELECT doc_id FROM documents WHERE lang = chr(101) || chr(110))', MIXED)}, {sparse_sql(20, 'lang = chr(101) || chr(110)')}, {fuse_sql(15)} SELECT query_id, id, score, rn FROM fused")
def r4(t):
    return R.hybrid(mixed_queries(t), vectors(t), docs(t), docs(t).where("lang = 'en'").select("id"), k=15)


@query("r5_global", f"WITH {dense_sql(20, 'e.vec_id IN (SELECT doc_id FROM documents WHERE source IN (chr(115)||chr(114)||chr(99)||chr(49), chr(115)||chr(114)||chr(99)||chr(50)))', MIXED)}, {sparse_sql(20, 'source IN (chr(115)||chr(114)||chr(99)||chr(49), chr(115)||chr(114)||chr(99)||chr(50))')}, {fuse_sql(12)} SELECT query_id, id, score, rn FROM fused")
def r5(t):
    return R.hybrid(mixed_queries(t), vectors(t), docs(t), docs(t).where("source in ('src1', 'src2')").select("id"), k=12)


def _any(terms, col="low"):
    return "(" + " OR ".join(f"contains({col}, '{x}')" for x in terms) + ")"


_CLASS = f"CASE WHEN {_any(fixed.BROAD_SUMMARY)} THEN 'broad_summary' WHEN {_any(fixed.CONFIG_LOOKUP)} THEN 'config_lookup' WHEN {_any(fixed.CODE_RELATION)} THEN 'code_relation' ELSE 'factual_doc' END"


@query("r6_classify", f"WITH d AS (SELECT doc_id, trim(lower(text)) AS low FROM documents), c AS (SELECT doc_id, {_CLASS} AS query_type FROM d) SELECT doc_id, query_type, CASE query_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TOP_K.items()) + " END::INT AS top_k FROM c")
def r6(t):
    kind = R.classify(F.col("text"))
    return t.documents.select("doc_id", kind.alias("query_type"), lookup(kind, fixed.TOP_K).alias("top_k"))


def _re_any(patterns):
    return "(" + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in patterns) + ")"


@query("r7_rewrite", f"""WITH q AS (SELECT doc_id, regexp_replace(text, '\\n', ' ', 'g') AS text, 0.3 + 0.01 * (doc_id % 40) AS top1 FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '\\S+')) < 4 OR top1 < 0.40 OR (NOT {_re_any(fixed.TECHNICAL)} AND {_re_any(fixed.AMBIGUOUS)}) AS rewrite FROM q""")
def r7(t):
    q = t.documents.select("doc_id", F.regexp_replace("text", "\n", " ").alias("text"), (0.3 + 0.01 * (F.col("doc_id") % 40)).alias("top1"))
    return q.select("doc_id", R.needs_rewrite(F.col("text"), F.col("top1")).alias("rewrite"))


#: Three neighbouring items are the sub-queries of one query.
_SUB = sparse_sql() + ", hits AS (SELECT query_id // 3 AS q, query_id % 3 AS sub, id, score FROM sparse)"


@query("r8_multiquery", f"""WITH {_SUB}, f AS (SELECT q AS query_id, id, list_reduce(list_prepend(NULL::DOUBLE, list(CASE WHEN sub = 0 THEN score ELSE score END ORDER BY sub)), lambda a, x: CASE WHEN a IS NULL THEN x ELSE a END) AS first_score, list({{'sub': sub, 'score': score}} ORDER BY sub) AS h FROM hits GROUP BY q, id),
s1 AS (SELECT query_id, id, h, h[1].score AS s FROM f), s2 AS (SELECT query_id, id, h, CASE WHEN len(h) > 1 AND h[2].score * 0.7::DOUBLE > s THEN h[2].score ELSE s END AS s FROM s1),
s3 AS (SELECT query_id, id, CASE WHEN len(h) > 2 AND h[3].score * 0.7::DOUBLE > s THEN h[3].score ELSE s END AS s FROM s2)
SELECT query_id::BIGINT AS query_id, id, round(s, 6) AS score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rn FROM s3) WHERE rn <= 20""")
def r8(t):
    hits = R.bm25(item_queries(t), docs(t))
    return R.multi_query(hits.select(F.floor(F.col("query_id") / 3).alias("query_id"), (F.col("query_id") % 3).alias("sub"), "id", "score"))


@query("r9_union", f"WITH {_SUB} SELECT query_id::BIGINT AS query_id, id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (SELECT q AS query_id, id, max(score) AS score FROM hits GROUP BY q, id)) WHERE rn <= 20")
def r9(t):
    hits = R.bm25(item_queries(t), docs(t))
    return R.best_of(hits.select(F.floor(F.col("query_id") / 3).alias("query_id"), "id", "score"))


@query("r10_semantic_cache", f"WITH {dense_sql(1, 'e.vec_id % 50 <> 0')} SELECT query_id, id, score, rn FROM dense WHERE score >= 0.3")
def r10(t):
    cached = vectors(t).where("id % 50 <> 0")
    return R.dense(vector_queries(t), cached, k=1, threshold=0.3)


@query("r11_exact_cache", """WITH c AS (SELECT sha256(text) AS key, item_id AS value, item_id * 100 AS expires_at FROM benchmark WHERE item_id % 2 = 0)
SELECT q.item_id AS query_id, c.key, c.value FROM benchmark q JOIN c ON sha256(q.text) = c.key WHERE c.expires_at > 1000""")
def r11(t):
    cache = t.benchmark.where("item_id % 2 = 0").select(F.sha2("text", 256).alias("key"), F.col("item_id").alias("value"), (F.col("item_id") * 100).alias("expires_at"))
    return R.exact_cache(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), cache, F.lit(1000)).select("query_id", "key", "value")


@query("r13_filtered", f"WITH {dense_sql(20, 'e.vec_id IN (SELECT doc_id FROM documents WHERE lang <> chr(101) || chr(110) OR lang IS NULL)', MIXED)}, {sparse_sql(20, '(lang <> chr(101) || chr(110) OR lang IS NULL)')}, {fuse_sql(8)} SELECT query_id, id, score, rn FROM fused")
def r13(t):
    keep = docs(t).where(F.coalesce(~F.col("lang").isin("en"), F.lit(True))).select("id")
    return R.hybrid(mixed_queries(t), vectors(t), docs(t), keep, k=8)


@query("r18_fanin", f"WITH {sparse_sql(5)}, s AS (SELECT s.*, lang FROM sparse s JOIN documents ON doc_id = id) SELECT CASE WHEN lang = 'en' THEN 'main' ELSE 'other' END AS block, query_id, id, score, rn FROM s UNION ALL SELECT 'architecture', query_id, id, score, rn FROM s WHERE rn <= 2")
def r18(t):
    hits = R.bm25(item_queries(t), docs(t), k=5).join(docs(t).select("id", "lang"), "id")
    main = hits.select(F.when(F.col("lang") == "en", "main").otherwise("other").alias("block"), "query_id", "id", "score", "rn")
    return main.unionByName(hits.where("rn <= 2").select(F.lit("architecture").alias("block"), "query_id", "id", "score", "rn"))


@query("r19_module_overlap", f"""WITH q AS (SELECT doc_id AS query_id, list_distinct({TOK.format("replace(p_name, '_', ' ')")}) AS qt FROM (SELECT p_partkey AS doc_id, p_name FROM part WHERE p_partkey % 50 = 0)),
m AS (SELECT DISTINCT p_name AS name, list_distinct({TOK.format('p_name')}) AS mt FROM part),
s AS (SELECT query_id, name, round(len(list_intersect(qt, mt)) / greatest(len(qt), 1), 6) AS score FROM q, m WHERE len(list_intersect(qt, mt)) > 0)
SELECT query_id, name, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name DESC) AS rn FROM s) WHERE rn <= 5""")
def r19(t):
    q = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.translate("p_name", "_", " ").alias("text"))
    return R.module_overlap(q, t.part.select(F.col("p_name").alias("name")).distinct())


def grep_sql(needle):
    return f"""WITH l AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
h AS (SELECT * FROM l WHERE contains(lower(line), '{needle}')), f AS (SELECT DISTINCT path FROM h ORDER BY path LIMIT 30)
SELECT path, line_no, line FROM h WHERE path IN (SELECT path FROM f) ORDER BY path, line_no LIMIT 100"""


@query("r20_grep", grep_sql("license"))
def r20(t):
    return R.grep(stored.document_files(t), "License")


@query("r20_indexed", grep_sql("apache"))
def r20_indexed(t):
    """From the trigram index: only files that hold the needle's rarest trigrams are tested."""
    return stored.lines(t).grep("Apache")
