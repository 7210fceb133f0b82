"""Sources and sinks: page tables, live fetching, and the files that reports go to."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.config import ScanConfig, shared_folder
from glintscan.operators.blobs import external_scripts

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
RESOURCE = T.StructType([T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType())])


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of pages: page_id, url, html and, where there is one, headers. Rendered pages have the same shape without headers."""
    reader = spark.read if form in ("parquet", "orc") else spark.read.schema(PAGE)
    return reader.format(form).load(path)


def read_resources(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of fetched scripts: url, status, body."""
    reader = spark.read if form in ("parquet", "orc") else spark.read.schema(RESOURCE)
    return reader.format(form).load(path)


def _get(url: str, cfg: ScanConfig, seconds: float) -> tuple[int, str, str | None, dict[str, list[str]]]:
    """Status, address after redirects, body and headers of one GET; status 0 if it failed or took longer."""
    import urllib.error
    import urllib.request

    until = time.time() + seconds
    if seconds <= 0:
        return 0, url, None, {}
    try:
        request = urllib.request.Request(url, headers={"User-Agent": cfg.user_agent})
        with urllib.request.urlopen(request, timeout=seconds) as r:
            headers: dict[str, list[str]] = {}
            for k, v in r.headers.items():
                headers.setdefault(k, []).append(v)
            body = bytearray()
            while part := r.read1(1 << 16):  # the time-out of a read starts anew with each
                body += part
                if time.time() > until:
                    return 0, url, None, {}
            return r.status, r.url, bytes(body).decode("utf-8", "replace"), headers
    except urllib.error.HTTPError as e:
        return e.code, url, None, {}
    except (OSError, ValueError):
        return 0, url, None, {}


def fetch_pages(urls: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Pages (page_id, url, html, headers, seconds_left) of addresses (page_id, url); only status 200 gives a row.

    seconds_left is what the page left of timeout_s for its scripts.
    """

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for page_id, url in zip(batch["page_id"].tolist(), batch["url"].tolist(), strict=True):
                until = time.time() + cfg.timeout_s
                status, final, body, headers = _get(url, cfg, cfg.timeout_s)
                if status == 200:
                    rows.append((page_id, final + ("#" + url.partition("#")[2] if "#" in url and "#" not in final else ""), body, headers, until - time.time()))
            yield pd.DataFrame(rows, columns=["page_id", "url", "html", "headers", "seconds_left"])

    return urls.select("page_id", "url").mapInPandas(run, T.StructType([*PAGE.fields, T.StructField("seconds_left", T.DoubleType())]))


def fetch_resources(scripts: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Resources (url, status, body) of the distinct script_url of external scripts.

    A script has the time that its pages left (the most of a `seconds_left` column; else timeout_s), in a browser session
    script_timeout_s of its own.
    """

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            got = []
            for url, left in zip(batch["script_url"].tolist(), batch["seconds_left"].tolist(), strict=True):
                left = cfg.script_timeout_s if cfg.headless else cfg.timeout_s if left is None or left != left else left
                got.append((url, *_get(url, cfg, left)))
            yield pd.DataFrame([(u, s, b) for u, s, _, b, _ in got], columns=["url", "status", "body"])

    left = F.max("seconds_left") if "seconds_left" in scripts.columns else F.lit(None).cast("double")
    return scripts.groupBy("script_url").agg(left.alias("seconds_left")).mapInPandas(run, RESOURCE)


def load(spark: SparkSession, source: str | DataFrame, resources: str | None = None, cfg: ScanConfig = ScanConfig(), form: str = "parquet") -> tuple[DataFrame, DataFrame | None]:
    """Pages and resources from one of the sources: a path (a table of pages, rendered ones in a browser session) with
    another for fetched scripts, or addresses (page_id, url), which are fetched with the scripts they name.

    Fetched pages and scripts are written to the shared folder, so that nothing is fetched twice.
    """
    if isinstance(source, str):
        return read_pages(spark, source, form), read_resources(spark, resources, form) if resources else None
    if cfg.headless:
        raise ValueError("a browser session's pages come as a table of rendered pages")
    folder = f"{shared_folder(spark)}/fetched-{uuid.uuid4().hex}"
    fetch_pages(source, cfg).write.parquet(f"{folder}/pages")
    pages = spark.read.parquet(f"{folder}/pages")
    scripts = external_scripts(pages, cfg).join(pages.select("page_id", "seconds_left"), "page_id")
    fetch_resources(scripts, cfg).write.parquet(f"{folder}/resources")
    return pages.drop("seconds_left"), spark.read.parquet(f"{folder}/resources")


def write_report(reports: dict[str, DataFrame], path: str, form: str = "json") -> None:
    """Overwrites `path` with the JSON objects, the plain reports (each with its title) or the findings as a table."""
    if form == "json":
        reports["json"].select(F.col("json").alias("value")).write.mode("overwrite").text(path)
    elif form == "text":
        from glintscan.operators.report import TITLE

        reports["plain"].select(F.concat(F.lit(TITLE), "text").alias("value")).write.mode("overwrite").text(path)
    else:
        reports["findings"].write.mode("overwrite").format(form).save(path)
