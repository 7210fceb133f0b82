"""From pages to blobs: script extraction, external scripts, numbering, and the page itself as the last blob.

Scripts are found by one pass of a native pattern that also consumes comments, raw-text elements and ordinary tags, so
that script tags inside those are not taken for elements. Not covered: the double-escaped script state, foreign content and
stray quotes in unquoted attribute values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.config import ScanConfig
from glintscan.functions.text import let, resolve_url, unescape_attribute

RAW_ELEMENTS = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
BLANK = r"\t\n\f\r "


def markup_pattern(possessive: bool) -> str:
    """Comment | raw-text element with its text | any other tag. Possessive loops for Java, plain ones for RE2."""
    p = "+" if possessive else ""
    attributes = rf"""[^"'>]*{p}(?:(?:"[^"]*{p}"|'[^']*{p}')[^"'>]*{p})*{p}"""
    raw = "|".join(rf"<{e}(?:[{BLANK}/]{attributes})?>.*?(?:</{e}(?:[{BLANK}/][^>]*)?>|\z)" for e in RAW_ELEMENTS)
    return rf"(?is)<!--(?:>|->|.*?(?:--!?>|\z))|{raw}|</?[a-z]{attributes}>"


def script_pattern(group: str, possessive: bool) -> str:
    """Of one script element: its attributes or its text."""
    p = "+" if possessive else ""
    attributes = rf"""[^"'>]*{p}(?:(?:"[^"]*{p}"|'[^']*{p}')[^"'>]*{p})*{p}"""
    a, b = (f"({attributes})", "(?:.*?)") if group == "attributes" else (f"(?:{attributes})", "(.*?)")
    return rf"(?is)\A<script(?:[{BLANK}/]{a})?>{b}(?:</script(?:[{BLANK}/][^>]*)?>)?\z"


ATTRIBUTE = rf"""(?s)([^{BLANK}"'>/=]+)(?:[{BLANK}]*=[{BLANK}]*("[^"]*"|'[^']*'|[^{BLANK}"'>]+))?"""


def attribute(attributes: Column, name: str) -> Column:
    """Value of the first attribute of that name, quotes and character references undone; empty if there is none."""
    found = F.arrays_zip(F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), F.lit(1)).alias("n"), F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), F.lit(2)).alias("v"))
    value = F.coalesce(F.get(F.transform(F.filter(found, lambda a: F.lower(a["n"]) == name), lambda a: a["v"]), F.lit(0)), F.lit(""))
    value = F.when(value.rlike("^[\"']"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
    return unescape_attribute(value)


TAGS = "array<struct<tag_ord:int,src:string,body:string>>"


def tags_of(html: Column) -> Column:
    """Every script element in document order as (tag_ord, src, body). CR and CRLF in the text become LF."""
    matches = F.regexp_extract_all(html, F.lit(markup_pattern(True)), F.lit(0))
    scripts = F.filter(matches, lambda m: m.rlike(rf"(?i)\A<script[{BLANK}/>]"))
    text = lambda t: F.replace(F.replace(F.regexp_extract(t, script_pattern("text", True), 1), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    src = lambda t: attribute(F.regexp_extract(t, script_pattern("attributes", True), 1), "src")
    tags = F.transform(scripts, lambda t, i: F.struct(i.alias("tag_ord"), src(t).alias("src"), text(t).alias("body")))
    # most pages without a script are told by a search, not by the pattern
    return F.when(F.contains(F.lower(html), F.lit("<script")), tags.cast(TAGS)).otherwise(F.array().cast(TAGS))


def script_tags(pages: DataFrame) -> DataFrame:
    """One row for each script element: page_id, url, tag_ord, src, body."""
    # outer: an inner generator would have the page parsed a second time, as a filter on the number of tags
    return pages.select("page_id", "url", F.inline_outer(tags_of(F.col("html")))).filter(F.col("tag_ord").isNotNull())


def entries(pages: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """page_id, blob_ord, source, path, body from one parse of each page: its inline scripts, its external scripts
    (path is their address, body is null) and, last and always, the page itself.

    Inline scripts of white space only are dropped before the rest are numbered, inside the page's row.
    """

    def listed(tags):
        row = lambda source, k, order, src, body: F.struct(F.lit(source).alias("source"), k.cast("int").alias("k"), order.cast("int").alias("blob_ord"), src.alias("src"), body.alias("body"))
        inline = F.filter(tags, lambda t: (t["src"] == "") & t["body"].rlike(r"(?U)\S"))
        none = F.lit(None).cast("string")
        inline = F.transform(inline, lambda t, i: row("inline", i + 1, t["tag_ord"], none, t["body"]))
        external = F.transform(F.filter(tags, lambda t: t["src"] != ""), lambda t: row("external", F.lit(0), t["tag_ord"], t["src"], none))
        return F.concat(inline, external, F.array(row("html", F.lit(0), F.lit(2**31 - 1), none, F.col("html"))))

    out = pages.select("page_id", "url", F.inline_outer(let(tags_of(F.col("html")), listed)))
    path = F.when(F.col("source") == "inline", F.concat("url", F.lit("#inline-"), F.col("k").cast("string"))).when(F.col("source") == "html", F.col("url")).otherwise(script_address(cfg))
    return out.select("page_id", "blob_ord", "source", path.alias("path"), "body").filter((F.col("source") != "external") | F.col("path").isNotNull())


def script_address(cfg: ScanConfig) -> Column:
    """The address of an external script. A browser session leaves any src that starts with http as it is."""
    whole = resolve_url(F.col("url"), F.col("src"))
    return F.when(F.col("src").startswith("http"), F.col("src")).otherwise(whole) if cfg.headless else whole


def external_scripts(pages: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """page_id, tag_ord, script_url of scripts with a src that can be resolved."""
    return script_tags(pages).filter(F.col("src") != "").select("page_id", "tag_ord", script_address(cfg).alias("script_url")).filter(F.col("script_url").isNotNull())


def blobs(pages: DataFrame, resources: DataFrame | None = None, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """page_id, blob_ord, source, path, body: scripts in document order, then the page's HTML if it isn't empty.

    An external script is there if `resources` (url, status, body) has its address with status 200, once for each such row;
    otherwise it vanishes. The only shuffle is the join with resources.
    """
    found = entries(pages, cfg)
    out = found.filter((F.col("source") == "inline") | ((F.col("source") == "html") & (F.col("body") != "")))
    if resources is not None:
        good = resources.filter(F.col("status") == 200).select(F.col("url").alias("script_url"), F.col("body").alias("script_body"))
        fetched = found.filter(F.col("source") == "external").join(good, F.col("path") == F.col("script_url"))
        out = out.unionByName(fetched.select("page_id", "blob_ord", "source", "path", F.col("script_body").alias("body")))
    return out


def blob_counts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, js_blobs: blobs but the HTML; 0 for pages without one."""
    n = found.filter(F.col("source") != "html").groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("long")).alias("js_blobs"))
