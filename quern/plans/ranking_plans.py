"""Ranking, gate, packing and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions.text import lookup
from quern.operators import ranking as N
from quern.operators import retrieval as R
from quern.plans.registry import query
from quern.plans.retrieval_plans import TOK, docs, item_queries, sparse_sql


def candidates(t, k=30):
    hits = R.bm25(item_queries(t), docs(t), k)
    return hits.join(docs(t), "id").join(item_queries(t).withColumnRenamed("text", "query_text"), "query_id")


_BG = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_RERANK = f"""cand AS (SELECT s.query_id, s.id, s.score, d.source, d.text, {TOK.format('b.text')} AS q, {TOK.format('d.text')} AS c, {TOK.format('d.source')} AS nm FROM sparse s JOIN documents d ON d.doc_id = s.id JOIN benchmark b ON b.item_id = s.query_id),
rr AS (SELECT query_id, id, score, source, text, round(len(list_intersect(list_distinct(q), c)) / len(list_distinct(q)) * 0.5::DOUBLE + CASE WHEN len(q) > 1 THEN len(list_intersect({_BG.format('q')}, {_BG.format('c')})) / len({_BG.format('q')}) ELSE 0 END * 0.3::DOUBLE
  + least(1, len(list_intersect(list_distinct(nm), list_distinct(q))) / len(list_distinct(q))) * 0.2::DOUBLE, 4) AS rerank_score FROM cand),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, id) AS rn FROM rr)"""


@query("n1_rerank", f"WITH {sparse_sql(30)}, {_RERANK}, cut AS (SELECT * FROM rk WHERE rn <= 10) SELECT query_id, id, rerank_score, rn, CASE WHEN max(score) OVER w = min(score) OVER w THEN CASE WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END::DOUBLE AS score FROM cut WINDOW w AS (PARTITION BY query_id)")
def n1(t):
    return N.rerank(candidates(t), 10, "source").select("query_id", "id", "rerank_score", "rn", "score")


_MM = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN CASE WHEN max({0}) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE round(({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w), 6) END::DOUBLE"


@query("n3_minmax", f"SELECT doc_id, {_MM.format('n_chars')} AS score FROM documents WINDOW w AS (PARTITION BY lang)")
def n3(t):
    return N.scaled(t.documents.select("doc_id", "lang", F.col("n_chars").alias("score")), "lang").select("doc_id", "score")


@query("n4_blend", f"""WITH a AS (SELECT lang AS query_id, source AS key, sum(n_chars)::DOUBLE AS s FROM documents GROUP BY ALL), b AS (SELECT lang AS query_id, source AS key, count(*)::DOUBLE AS s FROM documents GROUP BY ALL),
u AS (SELECT query_id, key, {_MM.format('s')} * 0.7::DOUBLE AS s FROM a WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, key, {_MM.format('s')} * 0.3::DOUBLE FROM b WINDOW w AS (PARTITION BY query_id))
SELECT query_id, key, round(sum(s), 4) AS score FROM u GROUP BY ALL""")
def n4(t):
    g = t.documents.groupBy(F.col("lang").alias("query_id"), F.col("source").alias("key"))
    a, b = g.agg(F.sum("n_chars").cast("double").alias("score"), F.lit("").alias("text")), g.agg(F.count("*").cast("double").alias("score"), F.lit("").alias("text"))
    return N.blend(a, b, 0.7).select("query_id", "key", F.round("score", 4).alias("score"))


@query("n5_dedup", f"""WITH RECURSIVE r AS (SELECT * FROM (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn, {TOK.format('text')} AS t FROM documents) WHERE rn <= 24),
tf AS (SELECT query_id, rn, term, count(*) AS c FROM (SELECT query_id, rn, unnest(t) AS term FROM r) GROUP BY ALL), nm AS (SELECT query_id, rn, sqrt(sum(c * c)) AS nrm FROM tf GROUP BY ALL),
sim AS (SELECT a.query_id, a.rn AS lo, b.rn AS hi, round(sum(a.c * b.c) / any_value(x.nrm * y.nrm), 6) AS s FROM tf a JOIN tf b ON a.query_id = b.query_id AND a.term = b.term AND a.rn < b.rn JOIN nm x ON x.query_id = a.query_id AND x.rn = a.rn JOIN nm y ON y.query_id = b.query_id AND y.rn = b.rn GROUP BY 1, 2, 3 HAVING s > 0.92),
g AS (SELECT DISTINCT query_id, 0::BIGINT AS step, []::BIGINT[] AS kept FROM r UNION ALL SELECT g.query_id, step + 1, CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = g.query_id AND r.rn = step + 1) OR EXISTS (SELECT 1 FROM sim s WHERE s.query_id = g.query_id AND s.hi = step + 1 AND list_contains(kept, s.lo)) THEN kept ELSE list_append(kept, step + 1) END FROM g WHERE step < 24)
SELECT r.query_id, r.rn, r.id FROM g JOIN r ON r.query_id = g.query_id AND list_contains(kept, r.rn) WHERE step = 24""")
def n5(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    lists = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "text", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 24")
    return N.greedy_dedup(lists)


_PART = "WITH p AS (SELECT p_partkey, p_size / 50 AS score, p_retailprice / 2500 AS rer, p_size % 7 / 7 AS cen, p_partkey % 30 AS days, ['Function','method','class','module','other'][p_partkey % 5 + 1] AS kind FROM part)"


def scored_parts(t):
    kinds = F.array(*[F.lit(x) for x in ("Function", "method", "class", "module", "other")])
    return t.part.select("p_partkey", (F.col("p_size") / 50).alias("score"), (F.col("p_retailprice") / 2500).alias("rer"), (F.col("p_size") % 7 / 7).alias("cen"), (F.col("p_partkey") % 30).alias("days"), F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("kind"))


@query("n7_handler", _PART + " SELECT p_partkey, round(score * 0.51::DOUBLE + rer * 0.3::DOUBLE + cen * 0.15::DOUBLE + 0.04::DOUBLE / (1 + 0.1::DOUBLE * days), 6) AS final_score FROM p")
def n7(t):
    p = scored_parts(t)
    return p.select("p_partkey", N.handler_score(F.col("score"), F.col("rer"), F.col("cen"), F.col("days")).alias("final_score"))


@query("n8_final", _PART + " SELECT p_partkey, round(least(score * 0.51::DOUBLE + CASE WHEN p_partkey % 3 = 0 THEN score * 0.6::DOUBLE ELSE rer END * 0.3::DOUBLE + cen * 0.15::DOUBLE + 0.5::DOUBLE * 0.04::DOUBLE + CASE lower(kind) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TYPE_POINTS.items()) + " ELSE 0 END / 100.0::DOUBLE, 1), 4) AS final_score FROM p")
def n8(t):
    p = scored_parts(t)
    return p.select("p_partkey", N.final_score(F.col("score"), F.col("kind"), F.when(F.col("p_partkey") % 3 != 0, F.col("rer")), F.col("cen")).alias("final_score"))


@query("n9_merge", "SELECT query_id, name, id, score FROM (SELECT p_brand AS query_id, p_type AS name, p_partkey AS id, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def n9(t):
    return N.merge_best(t.part.select(F.col("p_brand").alias("query_id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), ["query_id", "name"])


@query("n10_impact", """WITH i AS (SELECT l_orderkey, l_linenumber, round(least(greatest(0.4::DOUBLE * l_quantity / 50 + 0.3::DOUBLE * l_discount * 10 + 0.2::DOUBLE * l_tax * 10 + 0.1::DOUBLE * (l_partkey % 10) / 10, 0), 1), 4) AS impact FROM lineitem)
SELECT *, CASE WHEN impact >= 0.7 THEN 'high' WHEN impact >= 0.4 THEN 'medium' ELSE 'low' END AS risk FROM i""")
def n10(t):
    li = t.lineitem
    score = N.hybrid_impact(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_partkey") % 10 / 10)
    return li.select("l_orderkey", "l_linenumber", score.alias("impact"), N.risk(score).alias("risk"))


@query("n11_missing", "WITH f AS (SELECT doc_id AS id, round(least(0.4::DOUBLE * (n_chars % 100) / 100, 1), 4) AS impact FROM documents WHERE doc_id % 3 = 0) SELECT id, impact FROM f UNION ALL SELECT doc_id, 0.09 FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT id FROM f)")
def n11(t):
    zero = F.lit(0.0)
    found = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), N.hybrid_impact(F.col("n_chars") % 100 / 100, zero, zero, zero).alias("impact"))
    changed = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return found.unionByName(changed.join(found, "id", "left_anti").withColumn("impact", N.hybrid_impact(zero, F.lit(0.3), zero, zero)))


@query("n12_context_impact", "WITH f AS (SELECT source, doc_id AS id, round(0.4::DOUBLE * (n_chars % 100) / 100, 4) AS impact FROM documents) SELECT source, id, impact, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY impact DESC, id) AS rn FROM f) WHERE rn <= 10")
def n12(t):
    zero = F.lit(0.0)
    f = t.documents.select("source", F.col("doc_id").alias("id"), N.hybrid_impact(F.col("n_chars") % 100 / 100, zero, zero, zero).alias("impact"))
    return R.top_k(f, 10, by="source", score="impact")


_HITS = f"WITH {sparse_sql(10)}, {_RERANK}, h AS (SELECT query_id, rn, id, score / 40 AS score, rerank_score, source, text FROM rk)"


@query("c1_gate", _HITS + """, m AS (SELECT query_id, min_by(score, rn) AS top1, round(avg(score), 6) AS avg_score, count(DISTINCT source) AS sources, sum(length(text))::BIGINT AS chars, count(*) AS n, min_by(rerank_score, rn) AS rer FROM h GROUP BY query_id)
SELECT query_id, top1, avg_score, CASE WHEN avg_score > 0 THEN round(top1 / avg_score, 6) ELSE 0 END AS precision, sources, chars, round(sources / greatest(n, 1), 6) AS diversity,
CASE WHEN top1 < 0.3 OR chars < 200 THEN 'insufficient' WHEN rer < 0.15 OR (query_id % 2 = 0 AND sources / n < 0.4) OR (sources < 2 AND top1 < 0.55) OR (avg_score < 0.2 AND sources >= 2) THEN 'weak' ELSE 'answerable' END AS verdict FROM m""")
def c1(t):
    hits = R.bm25(item_queries(t), docs(t), 10).join(docs(t), "id").join(item_queries(t).withColumnRenamed("text", "query_text"), "query_id")
    hits = hits.drop("rn").withColumn("rerank_score", N.rerank_score(F.col("query_text"), F.col("text"), F.col("source")))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "id")
    hits = hits.withColumn("rn", F.row_number().over(w)).withColumn("score", F.col("score") / 40).withColumn("kind", F.when(F.col("query_id") % 2 == 0, "broad_summary").otherwise("factual_doc"))
    return N.answerability(hits, "kind")


_ORDER = "(doc_id * 7919) % 1000"
_PREFIX = "SELECT * FROM (SELECT {by} AS query_id, doc_id AS id, row_number() OVER w AS rn, sum(length(text)) OVER w AS used FROM documents WINDOW w AS (PARTITION BY {by} ORDER BY (doc_id * 7919) % 1000 DESC, doc_id)) WHERE rn <= 8 AND (rn = 1 OR used <= {budget})"


@query("b1_pack", "SELECT query_id, id, rn, used::BIGINT AS used FROM (" + _PREFIX.format(by="lang", budget="16000") + ")")
def b1(t):
    hits = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.expr(_ORDER).alias("score"), "text")
    return N.pack(hits, F.lit(16000)).select("query_id", "id", "rn", "used")


_KINDS = "['config_lookup','factual_doc','code_relation','broad_summary'][doc_id % 4 + 1]"
_BUDGET = "CASE query_id " + " ".join(f"WHEN '{k}' THEN {v * fixed.CHARS_PER_TOKEN}" for k, v in fixed.TOKEN_BUDGET.items()) + " END"


@query("b2_budget", "SELECT query_id, id, rn, used::BIGINT AS used FROM (" + _PREFIX.format(by=_KINDS, budget=_BUDGET) + ")")
def b2(t):
    kinds = F.array(*[F.lit(x) for x in ("config_lookup", "factual_doc", "code_relation", "broad_summary")])
    hits = t.documents.select(F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("query_id"), F.col("doc_id").alias("id"), F.expr(_ORDER).alias("score"), "text")
    budget = lookup(F.col("query_id"), {k: v * fixed.CHARS_PER_TOKEN for k, v in fixed.TOKEN_BUDGET.items()})
    return N.pack(hits, budget).select("query_id", "id", "rn", "used")


@query("p9_type_filter", "SELECT l_orderkey AS query_id, l_linenumber AS id FROM (SELECT *, max((l_returnflag <> 'N')::INT) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) WHERE l_returnflag <> 'N' OR s = 0")
def p9(t):
    return N.fall_back(t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), "l_returnflag"), F.col("l_returnflag") != "N").select("query_id", "id")


@query("p10_min_score", "SELECT l_orderkey AS query_id, l_linenumber AS id FROM (SELECT *, max((l_quantity >= 45)::INT) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) WHERE l_quantity >= 45 OR s = 0")
def p10(t):
    return N.fall_back(t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), "l_quantity"), F.col("l_quantity") >= 45).select("query_id", "id")


Q2, Q1 = '"' * 3, "'" * 3
#: Beginnings by number: licence heads in four forms, one that comes too late, doc strings of both quotes, long and short.
HEADS = [
    "# Copyright holder\n# line\n", "/* copyright\n * more */\n", "x = 1\ny = 2\n# license later\n", "ab\n# License\n", "<!-- copyright\n of all --> \n",
    f"def f():\n    {Q2}one\ntwo\nthree\nfour\nfive{Q2}\n{Q1}a\nb{Q1}\n", f"def g():\n{Q1}one\ntwo\n{Q2}\nfour\nfive\nsix{Q1}\n{Q2}short{Q2}\n",
]


def _lit(x):
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_STRINGS = "'" + N._BLOCK.replace("'", "''") + "'"
_CUT = f"CASE WHEN len(string_split(x, chr(10))) <= 4 THEN x ELSE array_to_string(string_split(x, chr(10))[1:4], chr(10)) || chr(10) || '    ' || CASE WHEN contains(x, {_lit(Q2)}) THEN {_lit(Q2)} ELSE {_lit(Q1)} END || {_lit(fixed.DOC_STRING_CUT)} END"
#: From d (doc_id, t) to r (doc_id, t, c, keep): the text, the compressed text, and whether the text stays as it is.
COMPRESS = (
    r"h AS (SELECT *, regexp_extract(regexp_extract(t, '\A(?:[^\n]*(?:\n|\z)){0,20}'), '(?im)\A[\s\S]{0,4}?^" + fixed.LICENSE_HEAD + "') AS head FROM d), b AS (SELECT *, substr(t, length(head) + 1) AS body FROM h),"
    f" s AS (SELECT doc_id, t, array_to_string(list_transform(list_zip(string_split_regex(body, {_STRINGS}), list_transform(regexp_extract_all(body, {_STRINGS}), lambda x: {_CUT})), lambda z: z[1] || coalesce(z[2], '')), '') AS x FROM b),"
    r" c AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t\r\f\v]+$', '', 'g'), '\A\s+|\s+\z', '', 'g') AS c FROM s),"
    " r AS (SELECT *, length(t) < 200 OR length(c) / greatest(length(t), 1) < 0.6 AS keep FROM c)"
)
_B3 = (
    "WITH d AS (SELECT doc_id, [" + ", ".join(map(_lit, HEADS)) + "][doc_id % 7 + 1] || replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM documents), "
    + COMPRESS
    + " SELECT doc_id, length(t)::INT AS original_chars, length(CASE WHEN keep THEN t ELSE c END)::INT AS compressed_chars, CASE WHEN keep THEN 1.0 ELSE round(length(c) / length(t), 3) END::DOUBLE AS ratio, sha256(CASE WHEN keep THEN t ELSE c END) AS digest FROM r"
)


@query("b3_compress", _B3)
def b3(t):
    head = F.element_at(F.array(*[F.lit(x) for x in HEADS]), (F.col("doc_id") % 7 + 1).cast("int"))
    d = t.documents.select("doc_id", F.concat(head, F.replace("text", F.lit(". "), F.lit(".  \n\n\n\n"))).alias("t"))
    out, ratio = N.compress(F.col("t"))
    return d.select("doc_id", F.length("t").alias("original_chars"), F.length(out).alias("compressed_chars"), ratio.alias("ratio"), F.sha2(out, 256).alias("digest"))


def _any_sql(terms, col="low"):
    return " + ".join(f"contains({col}, '{x}')::INT" for x in terms)


def _re(patterns):
    esc = lambda p: p.replace("'", "''")
    return "(" + " OR ".join(f"regexp_matches(q, '{esc(p)}')" for p in patterns) + ")"


@query("f_complexity", f"""WITH d AS (SELECT doc_id, text AS q, lower(text) AS low FROM documents),
s AS (SELECT doc_id, CASE WHEN {_re(fixed.MULTI_FILE)} THEN 1.0 WHEN len(list_distinct(regexp_extract_all(q, '\\b\\w+\\.\\w{{2,5}}\\b'))) >= 3 THEN 1.0 WHEN len(list_distinct(regexp_extract_all(q, '\\b\\w+\\.\\w{{2,5}}\\b'))) = 2 THEN 0.6 ELSE 0.0 END::DOUBLE AS s_file, CASE WHEN {_re(fixed.STACK_TRACE)} THEN 1.0 ELSE 0.0 END::DOUBLE AS s_trace,
CASE {_any_sql(fixed.ARCHITECTURE)} WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS s_arch, floor(len(regexp_extract_all(q, '\\S+')) / 0.75) AS w FROM d),
u AS (SELECT *, CASE WHEN w >= 300 THEN 1.0 WHEN w >= 150 THEN 0.5 WHEN w >= 80 THEN 0.2 ELSE 0.0 END::DOUBLE AS s_tokens FROM s), v AS (SELECT *, round(least(greatest(0.4::DOUBLE * s_file + 0.3::DOUBLE * s_trace + 0.2::DOUBLE * s_arch + 0.1::DOUBLE * s_tokens, 0), 1), 6) AS score FROM u)
SELECT doc_id, s_file, s_trace, s_arch, s_tokens, score, CASE WHEN score < 0.3 THEN 'local' WHEN score < 0.7 THEN 'cheap' ELSE 'reason' END AS tier FROM v""")
def f_complexity(t):
    d = t.documents.select("doc_id", F.col("text").alias("q"))
    return d.select("doc_id", *[c.alias(k) for k, c in N.complexity(F.col("q")).items()])


_COUNTS = ", ".join(f"{_any_sql(v)} AS {k}" for k, v in fixed.TASK_TYPES.items())


@query("f_tasktype", f"WITH d AS (SELECT doc_id, lower(text) AS low FROM documents), c AS (SELECT doc_id, {_COUNTS} FROM d), g AS (SELECT *, greatest({', '.join(fixed.TASK_TYPES)}) AS best FROM c) SELECT doc_id, CASE WHEN best = 0 THEN 'feature' " + " ".join(f"WHEN {k} = best THEN '{k}'" for k in fixed.TASK_TYPES) + " END AS task_type FROM g")
def f_tasktype(t):
    return t.documents.select("doc_id", N.task_type(F.col("text")).alias("task_type"))


@query("f_spec", r"""WITH d AS (SELECT doc_id, 'see src/' || source || '.py and ' || text AS g FROM documents), f AS (SELECT doc_id, list_distinct(regexp_extract_all(g, '\b[\w/.-]+\.(?:py|ts|tsx|js|go|java|rb|rs|cs|cpp|h)\b')) AS files FROM d)
SELECT doc_id, len(files)::INT AS n_files, array_to_string(list_sort(files), '|') AS files, 'python' AS language FROM f""")
def f_spec(t):
    d = t.documents.select("doc_id", F.concat(F.lit("see src/"), "source", F.lit(".py and "), "text").alias("g"))
    s = N.spec(F.col("g"))
    return d.select("doc_id", F.size(s["files"]).alias("n_files"), F.array_join(F.array_sort(s["files"]), "|").alias("files"), s["language"].alias("language"))


@query("f_route", "SELECT event_id, CASE event_type WHEN 'view' THEN 'local' WHEN 'click' THEN 'budget' WHEN 'error' THEN 'reasoning' ELSE 'analysis' END AS model_class FROM events")
def f_route(t):
    task = F.when(F.col("event_type") == "view", "rerank").when(F.col("event_type") == "click", "hyde").when(F.col("event_type") == "error", "architecture").otherwise("anything")
    return t.events.select("event_id", N.route(task).alias("model_class"))


@query("x11_eval", f"""WITH {sparse_sql(5)}, e AS (SELECT b.item_id AS query_id, list(d.doc_id::VARCHAR ORDER BY d.doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
f AS (SELECT e.query_id, min(CASE WHEN list_contains(expected, s.id::VARCHAR) THEN rn END) AS first FROM e LEFT JOIN sparse s USING (query_id) GROUP BY 1)
SELECT query_id, coalesce((first <= 1)::INT, 0) AS hit1, coalesce((first <= 3)::INT, 0) AS hit3, coalesce((first <= 5)::INT, 0) AS hit5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM f""")
def x11(t):
    """Expected documents are those that hold the passage."""
    items = item_queries(t)
    found = N.holders(items.select(F.col("query_id").alias("passage_id"), "text"), docs(t))
    hits = R.bm25(items, docs(t), 5)
    return N.evaluate_ids(found.select(F.col("passage_id").alias("query_id"), "id"), hits)


@query("x11_faithfulness", """WITH a AS (SELECT conv_id AS query_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
i AS (SELECT conv_id AS query_id, unnest(string_split(text, ' ')) AS item FROM conversations WHERE role <> 'assistant')
SELECT a.query_id, count(item) AS n_items, round(coalesce(avg((contains(lower(answer), lower(item)) AND answer <> '')::INT), 0), 6) AS faithfulness FROM a LEFT JOIN (SELECT * FROM i WHERE item <> '') i USING (query_id) GROUP BY a.query_id""")
def x11_faithful(t):
    """The last answer of each conversation against the words that it was asked with."""
    c = t.conversations.withColumnRenamed("conv_id", "query_id")
    answers = c.where("role = 'assistant'").groupBy("query_id").agg(F.max_by("text", "turn").alias("answer"))
    return N.faithfulness(answers, c.where("role <> 'assistant'").select("query_id", F.explode(F.split("text", " ")).alias("item")))


@query("n6_cosine", f"""WITH tf AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM tf GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), d AS (SELECT p.a, p.b, sum(x.c * y.c) AS dot FROM p JOIN tf x ON x.doc_id = p.a JOIN tf y ON y.doc_id = p.b AND y.term = x.term GROUP BY 1, 2)
SELECT p.a, p.b, coalesce(round(dot / (x.n * y.n), 6), 0.0::DOUBLE) AS cosine FROM p LEFT JOIN d USING (a, b) LEFT JOIN n x ON x.doc_id = p.a LEFT JOIN n y ON y.doc_id = p.b""")
def n6(t):
    """Each document and the next."""
    pairs = t.documents.select(F.col("doc_id").alias("a")).join(t.documents.select(F.col("doc_id").alias("b")), F.col("b") == F.col("a") + 1)
    return N.cosine_pairs(pairs, docs(t))


@query("j10_overlap_pairs", f"""WITH {sparse_sql(24)}, r AS (SELECT s.query_id, s.rn, s.id, unnest(list_distinct({TOK.format('d.text')})) AS term FROM sparse s JOIN documents d ON d.doc_id = s.id)
SELECT a.query_id, a.id AS a, b.id AS b, count(*) AS shared FROM r a JOIN r b ON a.query_id = b.query_id AND a.term = b.term AND a.rn < b.rn GROUP BY ALL""")
def j10(t):
    hits = R.bm25(item_queries(t), docs(t), 24)
    return N.overlap_pairs(hits.join(docs(t).select("id", "text"), "id"))
