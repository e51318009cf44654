"""Chunking, extraction and scan queries on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import chunking as C
from quern.plans.registry import query


def _q(p):
    return p.replace("'", "''")


def markdown(t):
    """Each conversation as a markdown document: a title, a header for each turn, then a fence, a table or nothing but text."""
    fence = F.concat(F.lit("```\n# no header\n"), "text", F.lit("\n```"))
    table = F.concat(F.lit("### note\n"), "text", F.lit("\n| a | b |\n| - | - |\n| x | y |\nafter\n\n"), "text")
    part = F.concat(F.lit("## "), "role", F.lit("\n"), F.when(F.col("turn") % 3 == 0, fence).when(F.col("turn") % 3 == 1, table).otherwise(F.concat(F.lit("### note\n"), "text")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("p")))), lambda x: x["p"])
    return t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("# conv "), F.first("conv_id").cast("string"), F.lit("\n"), F.array_join(rows, "\n")).alias("text"))


_TABLE = "'### note' || chr(10) || text || chr(10) || '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| x | y |' || chr(10) || 'after' || chr(10) || chr(10) || text"
_MARK = f"""md AS (SELECT conv_id AS id, '# conv ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || CASE WHEN turn % 3 = 0 THEN '```' || chr(10) || '# no header' || chr(10) || text || chr(10) || '```' WHEN turn % 3 = 1 THEN {_TABLE} ELSE '### note' || chr(10) || text END, chr(10) ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id)"""


def lines_sql(name, table):
    """``name``: (id, line, pos, fence, closed) of the lines of ``table`` (id, text)."""
    return f"""{name}l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {table}),
{name} AS (SELECT *, regexp_matches(line, '^\\s*```')::INT AS fence, sum(regexp_matches(line, '^\\s*```')::INT) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS closed FROM {name}l)"""


def blocks_sql(name, lines):
    """``name``: (id, block, kind, body)."""
    return f"""{name}k AS (SELECT *, CASE WHEN (closed - fence) % 2 = 1 OR fence = 1 THEN 'fence' WHEN starts_with(line, '|') THEN 'table' ELSE 'paragraph' END AS kind FROM {lines}),
{name}s AS (SELECT *, CASE WHEN kind = 'fence' THEN fence = 1 AND closed % 2 = 1 ELSE lag(kind) OVER (PARTITION BY id ORDER BY pos) IS DISTINCT FROM kind OR (kind = 'paragraph' AND trim(line) = '') END AS start FROM {name}k),
{name}n AS (SELECT *, sum(start::INT) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM {name}s),
{name} AS (SELECT id, block::BIGINT AS block, kind, string_agg(line, chr(10) ORDER BY pos) AS body FROM {name}n GROUP BY ALL HAVING trim(replace(string_agg(line, chr(10) ORDER BY pos), chr(10), ' ')) <> '')"""


def pack_sql(name, lists, limit):
    """``name``: (id, i, out): the chunk of the i-th of ``ls``, by a walk through the lists."""
    n, fits = "length(ls[i + 1])", f"(length(ls[i + 1]) <= {limit} AND used + length(ls[i + 1]) + 2 <= {limit})"
    return f"""{name} AS (SELECT id, ls, 0 AS i, 0 AS cur, 0 AS open, 0 AS used, NULL::INT AS out FROM {lists} UNION ALL
SELECT id, ls, i + 1, CASE WHEN {n} > {limit} THEN cur + open + 1 WHEN {fits} THEN cur ELSE cur + open END, CASE WHEN {n} > {limit} THEN 0 ELSE 1 END, CASE WHEN {n} > {limit} THEN 0 WHEN {fits} THEN used + {n} + 2 ELSE {n} END, CASE WHEN {fits} THEN cur ELSE cur + open END FROM {name} WHERE i < len(ls))"""


_SECTIONS = f"""{_MARK}, {lines_sql('f', 'md')}, v AS (SELECT *, CASE WHEN (closed - fence) % 2 = 1 OR fence = 1 THEN 0 ELSE length(regexp_extract(line, '^(#{{1,3}})\\s+\\S', 1)) END AS level FROM f),
s AS (SELECT *, sum((level > 0)::INT) OVER w AS section, CASE WHEN level > 0 THEN trim(regexp_extract(line, '^#{{1,3}}\\s+(.*)$', 1)) END AS title FROM v WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, coalesce(last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w, '') AS h1, coalesce(last_value(CASE WHEN level = 2 THEN title WHEN level = 1 THEN '' END IGNORE NULLS) OVER w, '') AS h2, coalesce(last_value(CASE WHEN level = 3 THEN title WHEN level IN (1, 2) THEN '' END IGNORE NULLS) OVER w, '') AS h3 FROM s WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT id, section::BIGINT AS section, max(h1) AS h1, max(h2) AS h2, max(h3) AS h3, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), '') AS body FROM h GROUP BY id, section)"""


@query("t8_sections", f"WITH {_SECTIONS} SELECT * FROM sec")
def t8(t):
    return C.sections(markdown(t))


@query("t9_split", f"""WITH RECURSIVE {_SECTIONS}, x AS (SELECT id, section, regexp_replace(body, '\\A\\s+|\\s+\\z', '', 'g') AS body FROM sec), y AS (SELECT * FROM x WHERE body <> ''),
long AS (SELECT {{'i': id, 's': section}} AS id, body AS text FROM y WHERE length(body) > 300), {lines_sql('g', 'long')}, {blocks_sql('b', 'g')}, ls AS (SELECT id, list(body ORDER BY block) AS ls FROM b GROUP BY id), {pack_sql('r', 'ls', 300)},
z AS (SELECT id, out, regexp_replace(string_agg(ls[i], chr(10) || chr(10) ORDER BY i), '\\A\\s+|\\s+\\z', '', 'g') AS text FROM r WHERE i > 0 GROUP BY id, out)
SELECT id, section, 0 AS part, body AS text FROM y WHERE length(body) <= 300 UNION ALL SELECT id.i, id.s, out, text FROM z WHERE text <> ''""")
def t9(t):
    return C.split_sections(C.sections(markdown(t)), 300)


@query("t10_blocks", f"WITH {_MARK}, {lines_sql('f', 'md')}, {blocks_sql('b', 'f')} SELECT * FROM b")
def t10(t):
    return C.blocks(markdown(t))


@query("t12_pack", f"WITH RECURSIVE l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE n_chars > 0), {pack_sql('r', 'l', 3200)} SELECT id AS doc_id, out AS chunk, count(*) AS n_blocks FROM r WHERE i > 0 GROUP BY ALL")
def t12(t):
    rows = t.documents.where("n_chars > 0").select("doc_id", F.explode(C.pack_lengths(F.transform(F.split("text", "\n", -1), lambda x: F.length(x)))).alias("chunk"))
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("n_blocks"))


@query("t11_tables")
def t11(t):
    body = F.concat(F.lit("| a | b |\n|---|---|\n"), F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("| "), w, F.lit(" | x |"))), "\n"))
    return t.documents.select("doc_id", F.posexplode(C.split_table(body)).alias("part", "text")).select("doc_id", "part", F.length("text").alias("n"))


@query("t13_lookup", "SELECT doc_id, ['security.md','tasks.md','notes.md','backend.md'][doc_id % 4 + 1] AS path, ['security','state','general','backend'][doc_id % 4 + 1] AS layer, ['critical','normal','normal','high'][doc_id % 4 + 1] AS doc_priority, doc_id % 4 < 2 AS required_on_session_start FROM documents")
def t13(t):
    names = F.array(*[F.lit(x) for x in ("security.md", "tasks.md", "notes.md", "backend.md")])
    return C.doc_metadata(t.documents.select("doc_id", F.get(names, (F.col("doc_id") % 4).cast("int")).alias("path")))


@query("t14_ids", "SELECT doc_id, substr(sha256(source || '|' || doc_id || '|' || lang), 1, 16) AS chunk_id, sha256(text) AS checksum FROM documents")
def t14(t):
    return t.documents.select("doc_id", C.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("chunk_id"), F.sha2("text", 256).alias("checksum"))


def _redact_sql():
    out, risk = "text", []
    for name, p, weight in C.REDACTIONS:
        out = f"regexp_replace({out}, '{_q(p)}', '[{name}]', 'g')"
        risk.append(f"CASE WHEN regexp_matches(text, '{_q(p)}') THEN {weight} ELSE 0 END")
    return out, "greatest(" + ", ".join(risk) + ")::DOUBLE"


@query("t15_redact", "SELECT doc_id, sha256({}) AS digest, {} AS risk, {} > 0.8 AS should_skip FROM documents".format(_redact_sql()[0], _redact_sql()[1], _redact_sql()[1]))
def t15(t):
    out, risk = C.redact(F.col("text"))
    return t.documents.select("doc_id", F.sha2(out, 256).alias("digest"), risk.alias("risk"), (risk > 0.8).alias("should_skip"))


@query("t5_config_keys", r"""WITH c AS (SELECT page_id, 'x = os.getenv("K' || page_id % 5 || '") + os.environ[''E' || page_id % 3 || ''']; process.env.P' || page_id % 4 || ' ' || html AS code, ['python','typescript'][page_id % 2 + 1] AS language FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(CASE language WHEN 'python' THEN list_concat(regexp_extract_all(code, 'os\.getenv\(["''](.*?)["'']\)', 1), regexp_extract_all(code, 'os\.environ\[["''](.*?)["'']\]', 1)) ELSE list_concat(regexp_extract_all(code, 'process\.env\.([a-zA-Z0-9_]+)', 1), regexp_extract_all(code, 'process\.env\[["''](.*?)["'']\]', 1)) END)), '|') AS keys FROM c""")
def t5(t):
    n = lambda k: (F.col("page_id") % k).cast("string")
    code = F.concat(F.lit('x = os.getenv("K'), n(5), F.lit("\") + os.environ['E"), n(3), F.lit("']; process.env.P"), n(4), F.lit(" "), F.col("html"))
    language = F.when(F.col("page_id") % 2 == 0, "python").otherwise("typescript")
    return t.pages.select("page_id", F.array_join(C.config_keys(code, language), "|").alias("keys"))


@query("t6_endpoints", r"""WITH c AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '@app.route("/p' || page_id % 7 || '") @app.tag("zz") @api_view(["GET"])' ELSE '[HttpGet("q' || page_id % 7 || '")] @Post()' END AS code FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/p' || page_id % 7 || '|[GET] f' ELSE CASE WHEN true THEN '[f]|q' || page_id % 7 END END AS endpoints FROM c""")
def t6(t):
    n = (F.col("page_id") % 7).cast("string")
    code = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('@app.route("/p'), n, F.lit('") @app.tag("zz") @api_view(["GET"])'))).otherwise(F.concat(F.lit('[HttpGet("q'), n, F.lit('")] @Post()')))
    language = F.when(F.col("page_id") % 2 == 0, "python").otherwise("csharp")
    return t.pages.select("page_id", F.array_join(C.endpoints(code, language, F.lit("f")), "|").alias("endpoints"))


@query("t7_roles", """WITH p AS (SELECT page_id, ['UserDto','AddMigration','Card','PriceRule','OrderEntity','plain'][page_id % 6 + 1] AS name, ['src/models/a.py','db/migrations/b.py','ui/Card.tsx','x/policies/c.cs','y/domain/d.cs','z/e.py'][page_id % 5 + 1] AS path FROM pages)
SELECT page_id, name = 'UserDto' OR path = 'src/models/a.py' AS is_dto, path = 'db/migrations/b.py' OR name = 'AddMigration' AS is_migration, path = 'ui/Card.tsx' AND name <> 'plain' AS is_ui_component, name = 'PriceRule' OR path = 'x/policies/c.cs' AS is_business_rule, name = 'OrderEntity' OR path = 'y/domain/d.cs' AS is_entity FROM p""")
def t7(t):
    names = F.array(*[F.lit(x) for x in ("UserDto", "AddMigration", "Card", "PriceRule", "OrderEntity", "plain")])
    paths = F.array(*[F.lit(x) for x in ("src/models/a.py", "db/migrations/b.py", "ui/Card.tsx", "x/policies/c.cs", "y/domain/d.cs", "z/e.py")])
    name, path = F.get(names, (F.col("page_id") % 6).cast("int")), F.get(paths, (F.col("page_id") % 5).cast("int"))
    return t.pages.select("page_id", *[c.alias(k) for k, c in C.roles(name, F.lit("return x"), path).items()])


#: Rules for markup beside the code rules.
HTML_RULES = [("SCRIPT_TAG", "MEDIUM", r"(?i)<script"), ("REF_PARAMETER", "LOW", r"[?&]ref=[a-z]"), ("INLINE_STYLE", "LOW", r"(?i)<style")]


def _scan_sql(table, id_col, col, rules):
    return f"WITH l AS (SELECT {id_col} AS id, unnest(string_split({col}, chr(10))) AS line, generate_subscripts(string_split({col}, chr(10)), 1) AS line_no FROM {table}) " + " UNION ALL ".join(f"SELECT id, line_no, substr(line, 1, 120) AS snippet, '{n}' AS rule, '{s}' AS severity FROM l WHERE regexp_matches(line, '{_q(p)}')" for n, s, p in rules)


@query("x1_scan", _scan_sql("pages", "page_id", "html", fixed.SECURITY_RULES + HTML_RULES))
def x1(t):
    return C.scan(t.pages, "page_id", "html", fixed.SECURITY_RULES + HTML_RULES)


@query("x1_scan_documents", _scan_sql("documents", "doc_id", "text", fixed.SECURITY_RULES))
def x1_docs(t):
    return C.scan(t.documents, "doc_id", "text")


@query("a11_severity", "SELECT severity, count(*) AS n FROM (" + _scan_sql("pages", "page_id", "html", fixed.SECURITY_RULES + HTML_RULES) + ") GROUP BY severity")
def a11(t):
    return C.scan(t.pages, "page_id", "html", fixed.SECURITY_RULES + HTML_RULES).groupBy("severity").agg(F.count("*").alias("n"))


@query("o2_findings", "SELECT * FROM (SELECT id, line_no, rule, severity, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, id, line_no, rule) AS rn FROM (" + _scan_sql("pages", "page_id", "html", fixed.SECURITY_RULES + HTML_RULES) + ")) WHERE rn <= 50")
def o2(t):
    return C.ranked_findings(C.scan(t.pages, "page_id", "html", fixed.SECURITY_RULES + HTML_RULES)).select("id", "line_no", "rule", "severity", "rn")


@query("x3_smells", """WITH d AS (SELECT doc_id AS id, string_split(replace(text, '. ', '.' || chr(10) || repeat(' ', (doc_id % 25)::INT)), chr(10)) AS ls FROM documents),
l AS (SELECT id, unnest(ls) AS x, generate_subscripts(ls, 1) AS line_no FROM d), p AS (SELECT id, line_no, floor((length(x) - length(ltrim(x))) / 4)::BIGINT AS level FROM l WHERE trim(x) <> '')
SELECT id, 'LARGE_FILE' AS smell, 1::BIGINT AS line_no, len(ls)::BIGINT AS value FROM d WHERE len(ls) > 100 UNION ALL SELECT id, 'DEEP_NESTING', min(line_no), min_by(level, line_no) FROM p WHERE level >= 5 GROUP BY id""")
def x3(t):
    text = F.replace("text", F.lit(". "), F.concat(F.lit(".\n"), F.repeat(F.lit(" "), (F.col("doc_id") % 25).cast("int"))))
    return C.smells(t.documents.select("doc_id", text.alias("text")), "doc_id", "text", max_lines=100)
