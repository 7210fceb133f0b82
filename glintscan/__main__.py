"""python -m glintscan PAGES [--resources TABLE] [options]: scans a table of pages and prints or writes the reports.

The exit status is 0 after a scan, whatever it found, and 1 after an error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from glintscan.config import ScanConfig
from glintscan.plans.scan import scan_report
from glintscan.sources.pages import load, write_report


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="glintscan", description="Scans pages for exposed secrets and endpoints.")
    args.add_argument("pages", help="a table of pages: page_id, url, html and, where there is one, headers")
    args.add_argument("--resources", help="a table of fetched scripts: url, status, body")
    args.add_argument("--form", default="parquet", help="of both tables")
    args.add_argument("--output", help="a folder for the reports; printed if it isn't given")
    args.add_argument("--json", action="store_true")
    args.add_argument("--plain", action="store_true", help="reports without rules and indentation")
    args.add_argument("--quiet", action="store_true")
    args.add_argument("--headless", action="store_true", help="the pages were rendered by a browser")
    args.add_argument("--entropy", action="store_true")
    args.add_argument("--min-entropy", type=float, default=4.5)
    args.add_argument("--min-length", type=int, default=20)
    given = args.parse_args(argv)
    cfg = ScanConfig(include_entropy=given.entropy, min_entropy=given.min_entropy, min_length=given.min_length, headless=given.headless, quiet=given.quiet)
    spark = SparkSession.builder.appName("glintscan").getOrCreate()
    try:
        pages, resources = load(spark, given.pages, given.resources, cfg, given.form)
        if given.output:  # reports in files are never quiet
            write_report(scan_report(pages, resources, ScanConfig(**vars(cfg) | {"quiet": False})), given.output, "json" if given.json else "text")
        reports = scan_report(pages, resources, cfg)
        name, column = ("json", "json") if given.json else ("plain", "text") if given.plain else ("blocks", "text")
        for row in reports[name].orderBy("page_id").select(column).toLocalIterator():
            print(row[0])
    except (PySparkException, OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
