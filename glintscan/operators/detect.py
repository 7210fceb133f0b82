"""From blobs to findings: lines, the rules, the entropy detector, snippets, and keep-first deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.config import ScanConfig
from glintscan.functions.catalog import EFFECTIVE, ENTROPY_NAME, ENTROPY_ORD, GENERIC, RULES, Rule
from glintscan.functions.text import entropy_tokens, shannon_entropy, snippet, snippet_bytes

ORDER = ("blob_ord", "line", "det_ord", "match_ord")
KEY = ("page_id", "detector", "type", "path", "token")


def lines(found: DataFrame) -> DataFrame:
    """One row for each line of each blob, numbered from 1. Only LF ends a line; what follows the last one is a line too."""
    return found.select("page_id", "blob_ord", "path", F.posexplode(F.split("body", "\n", -1)).alias("at", "text")).select("page_id", "blob_ord", "path", (F.col("at") + 1).alias("line"), "text")


def guard(rule: Rule) -> Column:
    """Whether the line has a literal that the rule needs; `low` is the line in lower case.

    Rules that ignore case also take U+017F for an s, which lower() keeps: such a line passes every guard of theirs.
    """
    found = [F.contains(F.col("low" if rule.folded else "text"), F.lit(g)) for g in rule.guards]
    return reduce(lambda a, b: a | b, found + [F.contains("text", F.lit("\u017f"))] * rule.folded)


def marked_lines(found: DataFrame) -> DataFrame:
    """As `lines`, with a line 0 without a text before those of each blob, which stands for the blob itself."""
    keys = [c for c in found.columns if c != "body"]
    all_lines = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.split("body", "\n", -1), F.array().cast("array<string>")))
    return found.select(*keys, F.posexplode(all_lines).alias("line", "text"))


def matches(found_lines: DataFrame, rules: tuple[Rule, ...] = EFFECTIVE, cfg: ScanConfig = ScanConfig(), marks: bool = False) -> DataFrame:
    """Every non-overlapping match of every rule on every line: det_ord, match_ord and the token (its first group).

    With cfg.include_entropy also the line's tokens of at least min_length bytes and min_entropy bits a byte; with `marks` an empty
    match of rule 0 for every line 0. A line is read once for all of them.
    """
    rules = tuple(r for r in rules if r.effective)
    keys = [c for c in found_lines.columns if c != "low"]
    wanted = [(r.ord, guard(r), F.regexp_extract_all("text", F.lit(r.java), F.lit(1))) for r in rules]
    if cfg.include_entropy:
        long = F.filter(entropy_tokens(F.col("text")), lambda t: F.octet_length(t) >= cfg.min_length)
        high = F.filter(long, lambda t: shannon_entropy(t) >= F.lit(float(cfg.min_entropy)))
        wanted.append((ENTROPY_ORD, F.octet_length("text") >= cfg.min_length, high))
    if marks:
        wanted.append((0, F.col("line") == 0, F.array(F.lit(""))))
    wide = found_lines.withColumn("low", F.lower("text"))
    wide = wide.filter(reduce(lambda a, b: a | b, [test for _, test, _ in wanted], F.lit(False)))
    hits = F.array(*[F.struct(F.lit(n).alias("det_ord"), F.when(test, tokens).alias("tokens")) for n, test, tokens in wanted])
    some = wide.select(*keys, F.explode(F.filter(hits, lambda h: F.size(h["tokens"]) > 0)).alias("h"))
    return some.select(*keys, F.col("h.det_ord").alias("det_ord"), F.posexplode("h.tokens").alias("match_ord", "token"))


def named(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(r.name) for r in RULES], F.lit(ENTROPY_NAME))
    types = F.array(*[F.lit(r.type) for r in RULES], F.lit(GENERIC))
    at = F.col("det_ord") - 1
    return found.withColumn("detector", F.get(names, at)).withColumn("type", F.get(types, at))


def raw_findings(found_lines: DataFrame, cfg: ScanConfig = ScanConfig(), rules: tuple[Rule, ...] = EFFECTIVE, marks: bool = False) -> DataFrame:
    """All matches with detector, type, snippet (text) and snippet_hex (its bytes before broken characters are mended)."""
    found = named(matches(found_lines, rules, cfg, marks))
    return found.withColumn("snippet", snippet(F.col("text"), F.col("token"))).withColumn("snippet_hex", F.hex(snippet_bytes(F.col("text"), F.col("token")))).drop("text")


#: Counts that come along with the marks of blobs: scripts and pages.
MARKS = ("js", "pages")


def keep_first(found: DataFrame) -> DataFrame:
    """Of equal findings of a page (detector, type, path, token) the first in order of blob, line, rule and match. MARKS are summed."""
    first = F.min_by(F.struct("line", "snippet", "snippet_hex", *[c for c in ORDER if c != "line"]), F.struct(*ORDER)).alias("f")
    marks = [c for c in MARKS if c in found.columns]
    out = found.groupBy(*KEY).agg(first, *[F.sum(c).alias(c) for c in marks])
    return out.select(*KEY, "f.line", "f.snippet", "f.snippet_hex", "f.blob_ord", "f.det_ord", "f.match_ord", *marks)


def scan_blobs(found: DataFrame, cfg: ScanConfig = ScanConfig(), rules: tuple[Rule, ...] = EFFECTIVE) -> DataFrame:
    return keep_first(raw_findings(lines(found), cfg, rules))


FINDING = ("detector", "type", "line", "token", "snippet", "snippet_hex", "det_ord", "match_ord")


def scripts_scanned(resources: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """script_url, scripts (rows with status 200) and items (their findings, the first of equal ones): every body is scanned once."""
    good = resources.filter(F.col("status") == 200).select(F.lit(0).alias("page_id"), F.lit(0).alias("blob_ord"), F.col("url").alias("path"), "body")
    found = keep_first(raw_findings(marked_lines(good), cfg, marks=True).withColumn("js", (F.col("det_ord") == 0).cast("int")))
    items = F.collect_list(F.when(F.col("det_ord") > 0, F.struct(*FINDING)))
    return found.groupBy(F.col("path").alias("script_url")).agg(F.sum("js").alias("scripts"), items.alias("items"))


def with_scripts(found: DataFrame, scripts: DataFrame) -> DataFrame:
    """Puts the findings of fetched scripts in place of their pages' references (`source` external), which stay as marks.

    Rows that are no reference have a key that no script has, and never the same one.
    """
    key = F.when(F.col("source") == "external", F.col("path")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "blob_ord", "line").cast("string")))
    met = found.withColumn("script_key", key).join(scripts, F.col("script_key") == F.col("script_url"), "left")
    own = F.struct(*[F.col(c) for c in FINDING], F.coalesce(F.when(F.col("source") == "external", F.col("scripts")), F.col("js").cast("long")).alias("js"))
    theirs = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in FINDING], F.lit(0).cast("long").alias("js")))
    every = F.when(F.col("items").isNull(), F.array(own)).otherwise(F.concat(F.array(own), theirs))
    return met.select("page_id", "blob_ord", "path", "pages", F.inline(every))
