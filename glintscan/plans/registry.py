"""Registered queries over the driver's tables, and the SQL that gives the same rows in another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.config import ScanConfig, shared_folder
from glintscan.functions.catalog import EFFECTIVE, ENTROPY_NAME, ENTROPY_ORD, RULES, TYPES
from glintscan.functions.text import entropy_tokens, shannon_entropy
from glintscan.operators import blobs as B
from glintscan.operators import detect, report, tech
from glintscan.plans import planted
from glintscan.plans.scan import findings, scan_pages, scan_texts, scanned
from glintscan.streaming.scan import findings_stream, page_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ENTROPY = ScanConfig(include_entropy=True, min_entropy=3.5)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Shared SQL text over the pages table, without a view that would outlive the query."""
    text = text.replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    return spark.sql(text, pages=table(spark, sf_dir, "pages"))


def planted_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_sql(spark, sf_dir, planted.corpus("(SELECT explode(sequence(1, 45)) AS k)"))
    return made.select("page_id", F.col("k").alias("blob_ord"), "path", "body")


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, planted.pages_with_scripts())


def planted_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, planted.resources())


# ---- the same relations in SQL ----


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


S_PLANTED = f"SELECT page_id, k AS blob_ord, path, body FROM ({planted.corpus('(SELECT unnest(range(1, 46)) AS k)')})"
S_DOCUMENTS = "SELECT doc_id AS page_id, 0 AS blob_ord, 'doc:' || doc_id AS path, text AS body FROM documents"
S_SCRIPT = rf"(?i)\A<script[{B.BLANK}/>]"


def s_tags(pages: str) -> str:
    found = f"list_filter(regexp_extract_all(html, {lit(B.markup_pattern(False))}, 0), lambda m: regexp_matches(m, {lit(S_SCRIPT)}))"
    attributes = f"regexp_extract(tag, {lit(B.script_pattern('attributes', False))}, 1)"
    text = f"replace(replace(regexp_extract(tag, {lit(B.script_pattern('text', False))}, 1), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    src = f"regexp_extract({attributes}, '(?i)(?:^|[ \\t\\n])src=\"([^\"]*)\"', 1)"
    return f"SELECT page_id, url, tag_ord, {src} AS src, {text} AS body FROM (SELECT page_id, url, unnest(found) AS tag, generate_subscripts(found, 1) - 1 AS tag_ord FROM (SELECT page_id, url, {found} AS found FROM ({pages})))"


def s_blobs(pages: str, resources: str | None = None) -> str:
    out = f"""SELECT page_id, tag_ord AS blob_ord, 'inline' AS source, url || '#inline-' || row_number() OVER (PARTITION BY page_id ORDER BY tag_ord) AS path, body
      FROM ({s_tags(pages)}) WHERE src = '' AND regexp_matches(body, '\\S')"""
    if resources:
        out += f""" UNION ALL SELECT page_id, tag_ord, 'external', r.url, r.body FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || src AS script FROM ({s_tags(pages)}) WHERE src <> '') t JOIN ({resources}) r ON r.url = t.script AND r.status = 200"""
    return f"SELECT page_id, blob_ord, source, path, body FROM ({out} UNION ALL SELECT page_id, 2147483647, 'html', url, html FROM ({pages}) WHERE html <> '')"


def s_lines(blobs: str) -> str:
    return f"SELECT page_id, blob_ord, path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT page_id, blob_ord, path, string_split(body, chr(10)) AS l FROM ({blobs}))"


S_ENTROPY = "list_sum(list_transform(list_sort(list_distinct(string_split(token, ''))), lambda c: -(len(list_filter(string_split(token, ''), lambda x: x = c)) / strlen(token)::DOUBLE) * log2(len(list_filter(string_split(token, ''), lambda x: x = c)) / strlen(token)::DOUBLE)))"


def s_tokens(lines: str) -> str:
    """Entropy tokens with their place among the line's candidates of enough bytes."""
    split = """list_filter(string_split_regex(text, '[ \\t"'',;]+'), lambda t: strlen(t) >= 20)"""
    return f"SELECT page_id, blob_ord, path, line, text, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS match_ord FROM (SELECT *, {split} AS t FROM ({lines}))"


def s_raw(blobs: str, rules=EFFECTIVE, entropy: bool = False) -> str:
    parts = [f"SELECT page_id, blob_ord, path, line, text, {r.ord} AS det_ord, {lit(r.name)} AS detector, {lit(r.type)} AS type, unnest(m) AS token, generate_subscripts(m, 1) - 1 AS match_ord FROM (SELECT *, regexp_extract_all(text, {lit(r.pattern)}, 1) AS m FROM src_lines)" for r in rules]
    if entropy:
        parts.append(f"SELECT page_id, blob_ord, path, line, text, {ENTROPY_ORD} AS det_ord, {lit(ENTROPY_NAME)} AS detector, 'generic' AS type, token, match_ord FROM ({s_tokens('SELECT * FROM src_lines')}) WHERE {S_ENTROPY} >= 3.5")
    return f"WITH src_lines AS MATERIALIZED ({s_lines(blobs)}) " + " UNION ALL ".join(parts)


S_START = "greatest(strlen(substr(text, 1, strpos(text, token) - 1)) - 20, 0)"
S_END = "least(strlen(substr(text, 1, strpos(text, token) - 1)) + strlen(token) + 20, strlen(text))"
S_SNIPPET = f"(CASE WHEN {S_START} > 0 THEN '2E2E2E' ELSE '' END) || substr(hex(encode(text)), 2 * {S_START} + 1, 2 * ({S_END} - {S_START})) || (CASE WHEN {S_END} < strlen(text) THEN '2E2E2E' ELSE '' END)"


def s_first(raw: str) -> str:
    return f"SELECT * FROM (SELECT *, {S_SNIPPET} AS snippet_hex, row_number() OVER (PARTITION BY page_id, detector, type, path, token ORDER BY blob_ord, line, det_ord, match_ord) AS nth FROM ({raw})) WHERE nth = 1"


OUT = ["page_id", "detector", "type", "path", "line", "token", "snippet_hex"]
S_OUT = "page_id, detector, type, path, line::INT AS line, token, snippet_hex"
S_PAGES = "SELECT page_id, url, html FROM pages"
S_SCRIPTED, S_RESOURCES = planted.pages_with_scripts(), planted.resources()
S_SCAN = s_first(s_raw(s_blobs(S_SCRIPTED, S_RESOURCES)))
S_TECH = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN regexp_matches(html, {lit(p)}) THEN [{', '.join(lit(x) for x in (n, *tech.IMPLIED.get(n, ())))}] ELSE [] END" for n, h, p in tech.MARKERS if not h) + "])))"


# ---- HTML and blobs ----


#: Scripts whose addresses are written with character references, and resolved in several ways.
S_REFERENCED = "SELECT page_id, 'https://h.example/a/b.html?q=1' AS url, '<script src=' || chr(34) || (CASE page_id % 8 WHEN 0 THEN '&#x2F;js&#47;n&#46;js?a&amp;b' WHEN 1 THEN '..&sol;x&period;js' WHEN 2 THEN '//o.example/&eacute;.js' WHEN 3 THEN '?x=1&ampy=2' WHEN 4 THEN '#&#128;' WHEN 5 THEN './y/../z.js&copy' WHEN 6 THEN 'https://o.example/&#x1F600;' ELSE '&notin;&nosuch;&#0;' END) || chr(34) || '></script>' AS html FROM pages"


@query("""SELECT page_id, 0 AS tag_ord, CASE page_id % 8 WHEN 0 THEN 'https://h.example/js/n.js?a&b' WHEN 1 THEN 'https://h.example/x.js' WHEN 2 THEN 'https://o.example/é.js' WHEN 3 THEN 'https://h.example/a/b.html?x=1&ampy=2' WHEN 4 THEN 'https://h.example/a/b.html?q=1#€' WHEN 5 THEN 'https://h.example/a/z.js©' WHEN 6 THEN 'https://o.example/😀' ELSE 'https://h.example/a/∉&nosuch;�' END AS script_url FROM pages""")
def h_character_references(spark, sf_dir):
    return B.external_scripts(run_sql(spark, sf_dir, S_REFERENCED))


@query(f"SELECT page_id, blob_ord::INT AS blob_ord, source, path, body FROM ({s_blobs(S_PAGES)})")
def h_blobs(spark, sf_dir):
    return B.blobs(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, blob_ord::INT AS blob_ord, path, body FROM ({s_blobs(S_SCRIPTED)}) WHERE source = 'inline'")
def h_inline_numbering(spark, sf_dir):
    return B.blobs(planted_pages(spark, sf_dir)).filter("source = 'inline'").drop("source")


@query(f"SELECT page_id, tag_ord::INT AS tag_ord, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || src AS script_url FROM ({s_tags(S_SCRIPTED)}) WHERE src <> ''")
def h_external_resolved(spark, sf_dir):
    return B.external_scripts(planted_pages(spark, sf_dir))


@query(f"SELECT p.page_id, count(b.source) AS js_blobs FROM pages p LEFT JOIN (SELECT * FROM ({s_blobs(S_SCRIPTED, S_RESOURCES)}) WHERE source <> 'html') b ON b.page_id = p.page_id GROUP BY p.page_id")
def h_blob_count(spark, sf_dir):
    pages = planted_pages(spark, sf_dir)
    return B.blob_counts(pages, B.blobs(pages, planted_resources(spark, sf_dir)))


@query(f"SELECT page_id, blob_ord::INT AS blob_ord, path, body FROM ({s_blobs(S_SCRIPTED, S_RESOURCES)}) WHERE source = 'external'")
def s_external_join(spark, sf_dir):
    return B.blobs(planted_pages(spark, sf_dir), planted_resources(spark, sf_dir)).filter("source = 'external'").drop("source")


# ---- lines and rules ----


@query(f"SELECT page_id, path, line::INT AS line, text FROM ({s_lines(S_DOCUMENTS)})")
def l_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("blob_ord"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body"))
    return detect.lines(found).drop("blob_ord")


def _rules_query(name: str, rules) -> None:
    def run(spark, sf_dir):
        return detect.raw_findings(detect.lines(planted_blobs(spark, sf_dir)), ScanConfig(), rules).select(*OUT)

    run.__name__ = name
    query(f"SELECT {S_OUT} FROM (SELECT *, {S_SNIPPET} AS snippet_hex FROM ({s_raw(S_PLANTED, rules)}))")(run)


for _type in TYPES[:3]:
    _rules_query(f"d_{_type}", tuple(r for r in EFFECTIVE if r.type == _type))
for _rule in EFFECTIVE:
    _rules_query(f"d_{_rule.ord:02d}_" + "_".join(_rule.name.lower().split()), (_rule,))


@query(f"SELECT {S_OUT} FROM ({s_first(s_raw(S_PLANTED))})")
def d_all(spark, sf_dir):
    return detect.scan_blobs(planted_blobs(spark, sf_dir)).select(*OUT)


@query("SELECT * FROM (VALUES " + ", ".join(f"({r.ord}, {lit(r.name)}, {lit(r.type)}, {str(r.effective).lower()})" for r in RULES) + ") AS t(det_ord, name, type, effective)")
def d_registry(spark, sf_dir):
    return spark.createDataFrame([(r.ord, r.name, r.type, r.effective) for r in RULES], "det_ord int, name string, type string, effective boolean")


@query(f"SELECT k AS rule, count(d.detector) AS own_findings FROM (SELECT unnest([9, 15, 17]) AS k) LEFT JOIN ({s_raw(S_PLANTED)}) d ON d.det_ord = k GROUP BY k")
def d_noneffective(spark, sf_dir):
    found = detect.matches(detect.lines(planted_blobs(spark, sf_dir)), RULES).groupBy("det_ord").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(r.ord,) for r in RULES if not r.effective], "rule int")
    return rules.join(found, F.col("rule") == F.col("det_ord"), "left").select("rule", F.coalesce("n", F.lit(0).cast("long")).alias("own_findings"))


# ---- entropy and snippets ----


@query(f"SELECT page_id, line::INT AS line, match_ord::INT AS match_ord, token FROM ({s_tokens(s_lines(S_DOCUMENTS))})")
def e_tokens(spark, sf_dir):
    found = l_lines(spark, sf_dir)
    return found.select("page_id", "line", F.posexplode(F.filter(entropy_tokens(F.col("text")), lambda t: F.octet_length(t) >= 20)).alias("match_ord", "token"))


@query(f"SELECT page_id, line::INT AS line, token, round({S_ENTROPY}, 9) AS bits FROM ({s_tokens(s_lines(S_DOCUMENTS))})")
def e_entropy(spark, sf_dir):
    return e_tokens(spark, sf_dir).select("page_id", "line", "token", F.round(shannon_entropy(F.col("token")), 9).alias("bits"))


@query(f"SELECT {S_OUT} FROM (SELECT *, {S_SNIPPET} AS snippet_hex FROM ({s_raw(S_DOCUMENTS, (), True).replace('MATERIALIZED', '')}))")
def e_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(0).alias("blob_ord"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body"))
    return detect.raw_findings(detect.lines(docs), ENTROPY, ()).select(*OUT)


#: Documents with a line of 20 to 27 different characters more: those of at least 23 have over 4.5 bits a byte.
S_DEFAULT = "SELECT doc_id AS page_id, 0 AS blob_ord, 'doc:' || doc_id AS path, text || chr(10) || 'x, ' || substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(1 + doc_id % 9 AS INT), CAST(20 + doc_id % 8 AS INT)) AS body FROM documents"


@query(f"SELECT {S_OUT} FROM (SELECT *, {S_SNIPPET} AS snippet_hex FROM ({s_raw(S_DEFAULT, (), True).replace('MATERIALIZED', '').replace('>= 3.5', '>= 4.5')}))")
def e_default_threshold(spark, sf_dir):
    docs = spark.sql(S_DEFAULT.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return detect.raw_findings(detect.lines(docs), ScanConfig(include_entropy=True), ()).select(*OUT)


@query(f"SELECT {S_OUT} FROM (SELECT *, {S_SNIPPET} AS snippet_hex FROM ({s_raw(s_blobs(S_SCRIPTED))}))")
def n_snippet(spark, sf_dir):
    return detect.raw_findings(detect.lines(B.blobs(planted_pages(spark, sf_dir)))).select(*OUT)


# ---- deduplication, whole scans, reports ----


@query(f"SELECT {S_OUT} FROM ({s_first(s_raw(s_blobs(S_SCRIPTED)))})")
def a_dedup(spark, sf_dir):
    return scan_pages(planted_pages(spark, sf_dir)).select(*OUT)


@query(f"SELECT {S_OUT} FROM ({S_SCAN})")
def scan_pages_full(spark, sf_dir):
    return scan_pages(planted_pages(spark, sf_dir), planted_resources(spark, sf_dir)).select(*OUT)


@query(f"SELECT {S_OUT} FROM ({s_first(s_raw(S_DOCUMENTS, EFFECTIVE, True))})")
def scan_documents(spark, sf_dir):
    return scan_texts(table(spark, sf_dir, "documents"), ENTROPY).select(*OUT)


def _scan(spark, sf_dir):
    pages = planted_pages(spark, sf_dir)
    scan = scanned(pages, planted_resources(spark, sf_dir))
    return pages, scan, findings(scan)


@query(f"SELECT p.page_id, t.type, count(f.token) AS n FROM pages p CROSS JOIN (SELECT unnest(['secret', 'config', 'endpoint', 'generic']) AS type) t LEFT JOIN ({S_SCAN}) f ON f.page_id = p.page_id AND f.type = t.type GROUP BY ALL")
def a_counts_by_type(spark, sf_dir):
    pages, _, found = _scan(spark, sf_dir)
    return report.counts_by_type(pages, found)


@query(f"SELECT page_id, type, array_position(['secret', 'config', 'endpoint', 'generic'], type)::INT AS type_ord, count(*) AS n, string_agg(detector || '@' || line || '=' || token, ' ' ORDER BY blob_ord, line, det_ord, match_ord) AS items FROM ({S_SCAN}) GROUP BY page_id, type")
def a_grouped_report(spark, sf_dir):
    _, _, found = _scan(spark, sf_dir)
    item = F.transform("items", lambda x: F.concat(x["detector"], F.lit("@"), x["line"].cast("string"), F.lit("="), x["token"]))
    return report.grouped(found).select("page_id", "type", "type_ord", "n", F.array_join(item, " ").alias("items"))


@query(f"SELECT page_id, '[' || detector || '] ' || path || ':' || line || ' ' || (CASE WHEN type = 'endpoint' THEN 'URL' ELSE 'Secret' END) || ': ' || token AS text FROM ({S_SCAN})")
def k_plain_lines(spark, sf_dir):
    return report.plain_lines(_scan(spark, sf_dir)[2]).select("page_id", "text")


S_BLOCK = "chr(10) || '▸ ' || detector || chr(10) || '  Location: ' || path || ':' || line || chr(10) || '  ' || (CASE WHEN type = 'endpoint' THEN 'URL' ELSE 'Secret' END) || ': ' || token || chr(10) || '  Context: ' || decode(unhex(snippet_hex)) || chr(10)"


@query(f"SELECT page_id, {S_BLOCK} AS text FROM ({s_first(s_raw(S_PLANTED))})")
def k_blocks(spark, sf_dir):
    return report.blocks(detect.scan_blobs(planted_blobs(spark, sf_dir))).select("page_id", "text")


S_SUMMARY = f"""SELECT p.page_id, p.url, array_to_string({S_TECH}, ', ') AS technologies, coalesce(b.n, 0) AS js_blobs, coalesce(f.total, 0) AS total,
  coalesce(f.secret, 0) AS secret, coalesce(f.config, 0) AS config, coalesce(f.endpoint, 0) AS endpoint, coalesce(f.generic, 0) AS generic
FROM ({S_SCRIPTED}) p
LEFT JOIN (SELECT page_id, count(*) AS n FROM ({s_blobs(S_SCRIPTED, S_RESOURCES)}) WHERE source <> 'html' GROUP BY page_id) b ON b.page_id = p.page_id
LEFT JOIN (SELECT page_id, count(*) AS total, count(*) FILTER (type = 'secret') AS secret, count(*) FILTER (type = 'config') AS config, count(*) FILTER (type = 'endpoint') AS endpoint, count(*) FILTER (type = 'generic') AS generic FROM ({S_SCAN}) GROUP BY page_id) f ON f.page_id = p.page_id"""


def _summary(spark, sf_dir):
    pages, scan, found = _scan(spark, sf_dir)
    return report.summary(pages, scan), found


@query(S_SUMMARY)
def k_summary(spark, sf_dir):
    return _summary(spark, sf_dir)[0].withColumn("technologies", F.coalesce(F.array_join("technologies", ", "), F.lit("")))


S_SUMMARY_TEXT = "'URL: ' || url || chr(10) || (CASE WHEN technologies <> '' THEN 'Tech: ' || technologies || chr(10) ELSE '' END) || 'JS Blobs: ' || js_blobs || chr(10) || 'Total Findings: ' || total || chr(10) || chr(10) || 'By Type:' || chr(10) || '  Secrets:       ' || secret || chr(10) || '  Configuration: ' || config || chr(10) || '  Endpoints:     ' || endpoint || chr(10) || '  Generic:       ' || generic || chr(10)"


@query(f"SELECT page_id, {S_SUMMARY_TEXT} AS text FROM ({S_SUMMARY})")
def k_summary_text(spark, sf_dir):
    return report.summary_text(_summary(spark, sf_dir)[0])


S_TEXT = "decode(unhex(snippet_hex))"  # the planted text is cut at whole characters
S_LABEL = "(CASE WHEN type = 'endpoint' THEN 'URL' ELSE 'Secret' END)"


def s_report(entry: str, section: str, head: str, nothing: str) -> str:
    """A report of each page: `head`, then the sections of its types, each made of its entries."""
    entries = f"SELECT page_id, type, count(*) AS n, string_agg({entry}, '' ORDER BY blob_ord, line, det_ord, match_ord) AS items FROM ({S_SCAN}) GROUP BY page_id, type"
    sections = f"SELECT page_id, string_agg({section}, '' ORDER BY array_position(['secret', 'config', 'endpoint', 'generic'], type)) AS sections FROM ({entries}) GROUP BY page_id"
    return f"SELECT s.page_id, {head} || coalesce(x.sections, {nothing}) AS text FROM ({S_SUMMARY}) s LEFT JOIN ({sections}) x ON x.page_id = s.page_id"


S_PLAIN = f"chr(10) || '[' || detector || '] ' || path || ':' || line || chr(10) || {S_LABEL} || ': ' || token || chr(10) || 'Context: ' || {S_TEXT} || chr(10)"
S_PLAIN_SECTION = "chr(10) || upper(type) || ' (' || n || ')' || chr(10) || repeat('-', 40) || chr(10) || items"
S_PLAIN_HEAD = "'Scanned: ' || url || chr(10) || 'Technologies: ' || technologies || chr(10) || 'JS Blobs: ' || js_blobs || chr(10) || 'Findings: ' || total || chr(10) || chr(10)"
S_NOTHING = f"{lit(report.NOTHING)} || chr(10)"


@query(s_report(S_PLAIN, S_PLAIN_SECTION, S_PLAIN_HEAD, S_NOTHING))
def k_plain_report(spark, sf_dir):
    summary, found = _summary(spark, sf_dir)
    return report.plain_report(summary, report.grouped(found))


@query(s_report(S_PLAIN, S_PLAIN_SECTION, "''", "''"))
def k_quiet_report(spark, sf_dir):
    summary, found = _summary(spark, sf_dir)
    return report.plain_report(summary, report.grouped(found), ScanConfig(quiet=True))


S_TITLES = "CASE type WHEN 'secret' THEN 'SECRETS' WHEN 'config' THEN 'CONFIGURATION' WHEN 'endpoint' THEN 'ENDPOINTS' ELSE 'GENERIC' END"
S_BLOCK_HEAD = f"'Scan Results' || chr(10) || ({S_SUMMARY_TEXT}) || chr(10)"


@query(s_report(S_BLOCK, f"chr(10) || {S_TITLES} || chr(10) || repeat('─', 60) || chr(10) || items || chr(10)", S_BLOCK_HEAD, S_NOTHING))
def k_block_report(spark, sf_dir):
    summary, found = _summary(spark, sf_dir)
    return report.block_report(summary, report.grouped(found))


def s_json(text: str) -> str:
    out = f"CAST(to_json({text}) AS VARCHAR)"
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = f"replace({out}, '{char}', '{code}')"
    return out


S_FIELDS = " || ',' || chr(10) || ".join(f"""'      "{c}": ' || {'line' if c == 'line' else s_json(S_TEXT if c == 'snippet' else c)}""" for c in ("detector", "type", "path", "line", "snippet", "token"))
S_ITEMS = f"SELECT page_id, string_agg('    {{' || chr(10) || {S_FIELDS} || chr(10) || '    }}', ',' || chr(10) ORDER BY blob_ord, line, det_ord, match_ord) AS items FROM ({S_SCAN}) GROUP BY page_id"
S_TECH_LINES = f"CASE WHEN technologies = '' THEN 'null' ELSE '[' || chr(10) || array_to_string(list_transform(string_split(technologies, ', '), lambda t: '    ' || {s_json('t')}), ',' || chr(10)) || chr(10) || '  ]' END"


@query(f"""SELECT s.page_id, '{{' || chr(10) || '  "findings": ' || coalesce('[' || chr(10) || items || chr(10) || '  ]', 'null') || ',' || chr(10) || '  "js_blobs": ' || js_blobs || ',' || chr(10) || '  "technologies": ' || {S_TECH_LINES} || ',' || chr(10) || '  "url": ' || {s_json('url')} || chr(10) || '}}' AS json FROM ({S_SUMMARY}) s LEFT JOIN ({S_ITEMS}) i ON i.page_id = s.page_id""")
def k_json(spark, sf_dir):
    return report.json_report(*_summary(spark, sf_dir))


@query(f"SELECT page_id, detector, type, path, token FROM ({s_first(s_raw(s_blobs(S_SCRIPTED)))})")
def a_stream(spark, sf_dir):
    """The findings of a stream of pages, micro-batch by micro-batch, with state for those seen within the delay.

    Which line of equal findings stays depends on arrival (see `findings_stream`), so the key alone is given."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    pages = planted_pages(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    pages.write.parquet(f"{folder}/pages")
    found = findings_stream(page_stream(spark, f"{folder}/pages", pages.schema), "ts")
    found.writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/found").select("page_id", "detector", "type", "path", "token")


S_SERVER = "CASE page_id % 4 WHEN 0 THEN 'nginx/1.18' WHEN 1 THEN 'cloudflare' WHEN 2 THEN 'Apache/2.4' ELSE 'other' END"
S_POWERED = "CASE page_id % 3 WHEN 0 THEN 'PHP/8.1' ELSE 'Express' END"
S_HEADERS = {"server": S_SERVER, "x-powered-by": S_POWERED}
S_TECH_ALL = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN regexp_matches({S_HEADERS.get(h, 'html')}, {lit(p)}) THEN [{', '.join(lit(x) for x in (n, *tech.IMPLIED.get(n, ())))}] ELSE [] END" for n, h, p in tech.MARKERS) + "])))"


@query(f"SELECT page_id, array_to_string({S_TECH_ALL}, ', ') AS technologies FROM pages")
def t_headers(spark, sf_dir):
    headers = F.create_map(F.lit("Server"), F.array(F.expr(S_SERVER)), F.lit("X-Powered-By"), F.array(F.expr(S_POWERED)))
    pages = table(spark, sf_dir, "pages").withColumn("headers", headers)
    return tech.fingerprint(pages).select("page_id", F.coalesce(F.array_join("technologies", ", "), F.lit("")).alias("technologies"))


@query(f"SELECT page_id, array_to_string({S_TECH}, ', ') AS technologies FROM pages")
def t_technologies(spark, sf_dir):
    return tech.fingerprint(table(spark, sf_dir, "pages")).select("page_id", F.coalesce(F.array_join("technologies", ", "), F.lit("")).alias("technologies"))


@query(f"SELECT type, detector, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM ({S_SCAN}) GROUP BY ROLLUP (type, detector)")
def a_rollup(spark, sf_dir):
    return _scan(spark, sf_dir)[2].rollup("type", "detector").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))
