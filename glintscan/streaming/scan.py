"""Scanning a stream of pages with Structured Streaming.

A page arrives whole in one row, so within a micro-batch the batch scan is exact. State is only needed against the
same page arriving again: its findings' keys are kept until the watermark passes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glintscan.config import ScanConfig
from glintscan.operators import report
from glintscan.operators.blobs import blobs
from glintscan.operators.detect import KEY, lines, raw_findings
from glintscan.plans.scan import scan_pages


def page_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def findings_stream(pages: DataFrame, time_col: str, delay: str = "10 minutes", cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings as a stream with bounded state: of equal keys, the one that is seen first within the delay.

    If a page comes more than once within the delay, or has the same script text under one path twice, equal findings differ only
    in their line, blob and snippet, and which of them stays is decided by arrival; batches keep the least. The page's time
    travels inside its id, so that no join is needed to keep it.
    """
    timed = pages.withColumn("page_id", F.struct(F.col("page_id").alias("id"), F.col(time_col).alias("time")))
    found = raw_findings(lines(blobs(timed, None, cfg)), cfg).drop("source")
    flat = found.withColumn(time_col, F.col("page_id.time")).withColumn("page_id", F.col("page_id.id"))
    return flat.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(KEY))


def scan_stream(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint_dir: str, resources: DataFrame | None = None, cfg: ScanConfig = ScanConfig(), available_now: bool = True) -> StreamingQuery:
    """Runs the exact scan on every micro-batch and hands its findings to the sink."""

    def each(batch: DataFrame, number: int) -> None:
        sink(scan_pages(batch, resources, cfg), number)

    writer = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def print_sink(cfg: ScanConfig = ScanConfig()) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch's findings to the console as lines of text."""

    def write(found: DataFrame, number: int) -> None:
        report.plain_lines(found, cfg).select("text").write.format("console").option("truncate", "false").save()

    return write
