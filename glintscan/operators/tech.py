"""Technology fingerprints from headers and HTML: a small rule table of well-known public markers, closed over what they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, header or "" for the body, pattern). Patterns are valid in Java and RE2.
MARKERS = (
    ("Angular", "", r"(?i)\sng-version="),
    ("Bootstrap", "", r"(?i)bootstrap(\.min)?\.(css|js)"),
    ("Cloudflare", "server", r"(?i)^cloudflare"),
    ("Drupal", "", r"(?i)<meta[^>]+name=.generator.[^>]+content=.Drupal"),
    ("Font Awesome", "", r"(?i)font-?awesome"),
    ("Google Analytics", "", r"(?i)(google-analytics\.com/|googletagmanager\.com/gtag)"),
    ("HTML5", "", r"(?i)\A\s*<!doctype html>"),
    ("Joomla", "", r"(?i)<meta[^>]+name=.generator.[^>]+content=.Joomla"),
    ("Next.js", "", r"(__NEXT_DATA__|/_next/static/)"),
    ("Nginx", "server", r"(?i)^nginx"),
    ("Apache HTTP Server", "server", r"(?i)^apache"),
    ("Nuxt.js", "", r"(__NUXT__|/_nuxt/)"),
    ("PHP", "x-powered-by", r"(?i)^php"),
    ("React", "", r"(?i)(data-reactroot|react(-dom)?(\.production)?(\.min)?\.js)"),
    ("Shopify", "", r"(?i)cdn\.shopify\.com"),
    ("Svelte", "", r"(?i)class=.[^>]*svelte-[a-z0-9]{5,}"),
    ("Vue.js", "", r"(?i)(\sdata-v-[0-9a-f]{8}|vue(\.min)?\.js)"),
    ("WordPress", "", r"(?i)(wp-content/|wp-includes/|<meta[^>]+name=.generator.[^>]+content=.WordPress)"),
    ("jQuery", "", r"(?i)jquery[-.0-9]*(\.min)?\.js"),
)
IMPLIED = {"WordPress": ("MySQL", "PHP"), "Drupal": ("PHP",), "Joomla": ("PHP",), "Next.js": ("Node.js", "React"), "Nuxt.js": ("Node.js", "Vue.js")}


def _header(name: str, pattern: str):
    return lambda entry: (F.lower(entry["key"]) == name) & F.exists(entry["value"], lambda v: v.rlike(pattern))


def technologies(pages: DataFrame) -> Column:
    """Sorted names; null if there are none. Without a headers column (map of arrays) only the body is looked at."""
    names = []
    for name, header, pattern in MARKERS:
        if not header:
            hit = F.col("html").rlike(pattern)
        elif "headers" in pages.columns:
            hit = F.exists(F.map_entries("headers"), _header(header, pattern))
        else:
            continue
        names.append(F.when(hit, F.array(*[F.lit(n) for n in (name, *IMPLIED.get(name, ()))])).otherwise(F.array().cast("array<string>")))
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*names))))
    return F.when(F.size(found) > 0, found)


def fingerprint(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", technologies(pages).alias("technologies"))
