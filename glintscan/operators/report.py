"""Reports of a scan: counts, summaries, text and JSON for each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.config import ScanConfig
from glintscan.functions.catalog import ENDPOINT, TYPES
from glintscan.operators.detect import ORDER
from glintscan.operators.tech import technologies

NOTHING = "No secrets or interesting endpoints found."
TITLE = "Scan Results\n============\n\n"


def type_ord(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), kind).cast("int")


def label(kind: Column) -> Column:
    return F.when(kind == ENDPOINT, "URL").otherwise("Secret")


def shown(token: Column, cfg: ScanConfig) -> Column:
    return F.concat(F.substring(token, 1, 4), F.lit("****")) if cfg.mask_tokens else token


def plain_lines(found: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """One line of text for each finding; none if quiet."""
    text = F.concat(F.lit("["), "detector", F.lit("] "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), label(F.col("type")), F.lit(": "), shown(F.col("token"), cfg))
    out = found.select("page_id", *ORDER, text.alias("text"))
    return out.limit(0) if cfg.quiet else out


def _block(x: dict | Column, kind: Column) -> Column:
    """Location, token and context of a finding, as indented lines under its rule's name."""
    return F.concat(F.lit("\n▸ "), x["detector"], F.lit("\n  Location: "), x["path"], F.lit(":"), x["line"].cast("string"), F.lit("\n  "), label(kind), F.lit(": "), x["token"], F.lit("\n"), F.when(x["snippet"] != "", F.concat(F.lit("  Context: "), x["snippet"], F.lit("\n"))).otherwise(""))


def blocks(found: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """A block of lines for each finding; none if quiet."""
    fields = {c: F.col(c) for c in ("detector", "path", "line", "snippet")} | {"token": shown(F.col("token"), cfg)}
    out = found.select("page_id", *ORDER, _block(fields, F.col("type")).alias("text"))
    return out.limit(0) if cfg.quiet else out


SECTIONS = {"secret": "SECRETS", "config": "CONFIGURATION", "endpoint": "ENDPOINTS", "generic": "GENERIC"}


def block_report(summaries: DataFrame, groups: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """The report in blocks: title, summary (unless quiet), and a ruled section for each type that has findings."""
    titles = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    section = F.concat(F.lit("\n"), titles[F.col("type")], F.lit("\n" + "─" * 60 + "\n"), F.array_join(F.transform("items", lambda x: _block(x, F.col("type"))), ""), F.lit("\n"))
    sections = _sections(groups, section)
    head = summary_text(summaries).withColumnRenamed("text", "head")
    nothing = "" if cfg.quiet else NOTHING + "\n"
    body = F.concat(F.lit("Scan Results\n"), F.lit("") if cfg.quiet else F.concat("head", F.lit("\n")), F.coalesce("sections", F.lit(nothing)))
    return head.join(sections, "page_id", "left").select("page_id", body.alias("text"))


def counts_by_type(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, type, n for each of the four types, zeros kept."""
    have = found.groupBy("page_id", "type").agg(F.count("*").alias("n"))
    every = pages.select("page_id", F.explode(F.array(*[F.lit(t) for t in TYPES])).alias("type"))
    return every.join(have, ["page_id", "type"], "left").select("page_id", "type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def grouped(found: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """page_id, type, type_ord, n and the findings of the type in order. Types without findings have no row."""
    item = F.struct(*ORDER, "detector", "path", shown(F.col("token"), cfg).alias("token"), "snippet")
    return found.groupBy("page_id", "type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("items")).withColumn("type_ord", type_ord(F.col("type")))


def summary(pages: DataFrame, scan: DataFrame) -> DataFrame:
    """A row for every row of pages: page_id, url, technologies and counts. Rows of one page_id are taken for the same page."""
    counts = [F.count_if(F.col("det_ord") > 0).alias("total"), *[F.count_if(F.col("type") == t).alias(t) for t in TYPES]]
    n = scan.groupBy("page_id").agg((F.sum("js") / F.greatest(F.sum("pages"), F.lit(1))).cast("long").alias("js_blobs"), *counts)
    out = pages.select("page_id", "url", technologies(pages).alias("technologies")).join(n, "page_id", "left")
    return out.select("page_id", "url", "technologies", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("js_blobs", "total", *TYPES)])


def summary_text(summaries: DataFrame) -> DataFrame:
    """The summary as lines of text; technologies only if there are any."""
    tech = F.when(F.col("technologies").isNotNull(), F.concat(F.lit("Tech: "), F.array_join("technologies", ", "), F.lit("\n"))).otherwise("")
    line = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"), F.lit("\n"))
    text = F.concat(F.lit("URL: "), "url", F.lit("\n"), tech, line("JS Blobs: ", "js_blobs"), line("Total Findings: ", "total"), F.lit("\nBy Type:\n"), line("  Secrets:       ", "secret"), line("  Configuration: ", "config"), line("  Endpoints:     ", "endpoint"), line("  Generic:       ", "generic"))
    return summaries.select("page_id", text.alias("text"))


def _sections(groups: DataFrame, section: Column) -> DataFrame:
    """page_id and its sections' texts in the types' order. A page has few types, and a page's findings are one row's."""
    listed = groups.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("type_ord", section.alias("s")))).alias("s"))
    return listed.select("page_id", F.array_join(F.transform("s", lambda x: x["s"]), "").alias("sections"))


def plain_report(summaries: DataFrame, groups: DataFrame, cfg: ScanConfig = ScanConfig(), title: bool = False) -> DataFrame:
    """The whole report of each page as text: totals, then a section for each type that has findings. Quiet leaves out the
    totals and, of a page without findings, everything."""
    entry = lambda x, kind: F.concat(F.lit("\n["), x["detector"], F.lit("] "), x["path"], F.lit(":"), x["line"].cast("string"), F.lit("\n"), label(kind), F.lit(": "), x["token"], F.lit("\n"), F.when(x["snippet"] != "", F.concat(F.lit("Context: "), x["snippet"], F.lit("\n"))).otherwise(""))
    section = F.concat(F.lit("\n"), F.upper("type"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.lit("-" * 40 + "\n"), F.array_join(F.transform("items", lambda x: entry(x, F.col("type"))), ""))
    head = F.concat(F.lit("Scanned: "), "url", F.lit("\nTechnologies: "), F.coalesce(F.array_join("technologies", ", "), F.lit("")), F.lit("\nJS Blobs: "), F.col("js_blobs").cast("string"), F.lit("\nFindings: "), F.col("total").cast("string"), F.lit("\n\n"))
    nothing = "" if cfg.quiet else NOTHING + "\n"
    text = F.concat(F.lit(TITLE if title else ""), F.lit("") if cfg.quiet else head, F.coalesce("sections", F.lit(nothing)))
    return summaries.join(_sections(groups, section), "page_id", "left").select("page_id", text.alias("text"))


def _json(text: Column) -> Column:
    """A JSON string; angle brackets, ampersands and line separators as escapes."""
    quoted = F.to_json(F.array(text))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        quoted = F.replace(quoted, F.lit(char), F.lit(code))
    return quoted


def json_report(summaries: DataFrame, found: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """One JSON object for each page, indented by two spaces, keys in alphabetical order; findings and technologies are null if
    there are none."""
    item = F.struct(*ORDER, "detector", "type", "path", "snippet", shown(F.col("token"), cfg).alias("token"))
    items = found.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    field = lambda x, c: F.concat(F.lit(f'      "{c}": '), x[c].cast("string") if c == "line" else _json(x[c]))
    one = lambda x: F.concat(F.lit("    {\n"), F.concat_ws(",\n", *[field(x, c) for c in ("detector", "type", "path", "line", "snippet", "token")]), F.lit("\n    }"))
    listed = lambda values: F.coalesce(F.concat(F.lit("[\n"), F.array_join(values, ",\n"), F.lit("\n  ]")), F.lit("null"))
    techs = F.transform("technologies", lambda t: F.concat(F.lit("    "), _json(t)))
    text = F.concat(F.lit('{\n  "findings": '), listed(F.transform("all", one)), F.lit(',\n  "js_blobs": '), F.col("js_blobs").cast("string"), F.lit(',\n  "technologies": '), listed(techs), F.lit(',\n  "url": '), _json(F.col("url")), F.lit("\n}"))
    return summaries.join(items, "page_id", "left").select("page_id", text.alias("json"))
