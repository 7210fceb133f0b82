"""Whole scans: from pages (and resources) to findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.config import ScanConfig
from glintscan.operators import blobs as B
from glintscan.operators import detect, report


def scanned(pages: DataFrame, resources: DataFrame | None = None, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of every page and, with det_ord 0, marks that count its scripts (js) and its rows (pages).

    Each page is parsed once and each script's body scanned once, however many pages name it.
    """
    lines = detect.marked_lines(B.entries(pages, cfg))
    mark = lambda source: ((F.col("det_ord") == 0) & (F.col("source") == source)).cast("int")
    found = detect.raw_findings(lines, cfg, marks=True).withColumn("js", mark("inline")).withColumn("pages", mark("html"))
    if resources is None:
        found = found.filter(F.col("source") != "external").drop("source")
    else:
        found = detect.with_scripts(found, detect.scripts_scanned(resources, cfg))
    return detect.keep_first(found)


def findings(scan: DataFrame) -> DataFrame:
    """page_id, detector, type, path, line, snippet, token and the columns that order them."""
    return scan.filter(F.col("det_ord") > 0).drop(*detect.MARKS)


def scan_pages(pages: DataFrame, resources: DataFrame | None = None, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of every page."""
    return findings(scanned(pages, resources, cfg))


def scan_texts(texts: DataFrame, cfg: ScanConfig = ScanConfig(), id_col: str = "doc_id", text_col: str = "text", prefix: str = "doc:") -> DataFrame:
    """Findings of rows of text, each a blob of its own with a path made of its id."""
    found = texts.select(F.col(id_col).alias("page_id"), F.lit(0).alias("blob_ord"), F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("path"), F.col(text_col).alias("body"))
    return detect.scan_blobs(found, cfg)


def scan_report(pages: DataFrame, resources: DataFrame | None = None, cfg: ScanConfig = ScanConfig()) -> dict[str, DataFrame]:
    """findings, summary, summary_text, plain, blocks, json and lines of every page, from one scan that is kept meanwhile."""
    scan = scanned(pages, resources, cfg).persist()
    found, summaries = findings(scan), report.summary(pages, scan)
    groups = report.grouped(found, cfg)
    return {"findings": found, "summary": summaries, "summary_text": report.summary_text(summaries), "plain": report.plain_report(summaries, groups, cfg), "blocks": report.block_report(summaries, groups, cfg), "json": report.json_report(summaries, found, cfg), "lines": report.plain_lines(found, cfg)}
