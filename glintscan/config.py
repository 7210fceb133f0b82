"""Settings of a scan."""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ScanConfig:
    """include_entropy adds the entropy detector; headless resolves script addresses as a browser session does;
    mask_tokens hides all but the first four characters of tokens in reports. A page and its scripts have timeout_s seconds in
    all; in a browser session each script has script_timeout_s of its own."""

    include_entropy: bool = False
    min_entropy: float = 4.5
    min_length: int = 20
    headless: bool = False
    quiet: bool = False
    mask_tokens: bool = False
    timeout_s: float = 30.0
    script_timeout_s: float = 10.0
    user_agent: str = "Mozilla/5.0 (compatible; glintscan/1.0)"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session in one process (as in tests) gets a folder of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", "glintscan")
