"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.config import shared_folder

#: Rows of one Arrow batch are handed to numpy in slices of about this many text bytes.
SLICE_BYTES = 1 << 20
#: Spark ends a batch for a worker at about this many bytes. Its own limits are 10,000 rows and 64 MB, which an executor holds several times
#: over outside its heap: vectors that double as they grow, and the stream to the worker.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A worker forgets its table of distinct words beyond this many, which bounds its memory.
TABLE_LIMIT = 250_000

_WORKER: dict = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context, so that they can import it. A session that sets no
    limit to the bytes of a batch gets BATCH_BYTES."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_glintscan_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{top.name}.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._glintscan_shipped = True


def worker_state(key, build: Callable):
    """One object per Python worker process, for tasks of the same kind in a reused worker to share; another kind drops it."""
    if key not in _WORKER:
        _WORKER.clear()
        release()
        _WORKER[key] = build()
    return _WORKER[key]


def release() -> None:
    """At the end of a task: drops the tables it has grown and gives freed memory back to the machine. A reused worker would
    otherwise hold on to its peak, also while it waits."""
    for key, held in list(_WORKER.items()):
        if hasattr(held, "reset"):
            held.reset()
        else:
            del _WORKER[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def releasing(run: Callable) -> Callable:
    """The worker function `run`, with a `release` once all that it held is gone: its own variables are still alive at its end."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


class Numbering(dict):
    """Numbers distinct strings from 0 in order of their first sight; `fresh` holds those not yet processed."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word):
        n = len(self)
        self[word] = n
        self.fresh.append(word)
        return n

    def take_fresh(self) -> list[str]:
        out, self.fresh = self.fresh, []
        return out


class Grown:
    """A numpy array that grows by amortised doubling along its first axis."""

    def __init__(self, dtype, width: int | None = None):
        self.n = 0
        self.data = np.zeros((1024,) if width is None else (1024, width), dtype)

    def extend(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.data):
            bigger = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            bigger[: self.n] = self.data[: self.n]
            self.data = bigger
        self.data[self.n : need] = rows
        self.n = need


def slices(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES of the given string or binary column (one row at least)."""
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, compute: Callable, fields: list[T.StructField], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends computed columns to every row, without a shuffle.

    `compute()` runs once per task and returns a function from a list of texts (None for null) to a list
    of Arrow arrays, one for each field. `keep` names the input columns to pass on (default: all). An input
    column whose name clashes with a computed one is replaced by it.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    hidden = text_col if text_col in keep else "text_in"  # a text that is passed on is sent once
    while hidden != text_col and hidden in {c.lower() for c in keep}:
        hidden += "_"
    src = df.select(*[F.col(f"`{c}`") for c in keep], *([] if hidden == text_col else [F.col(f"`{text_col}`").alias(hidden)]))
    schema = T.StructType([src.schema[c] for c in keep] + fields)
    names = keep + [f.name for f in fields]
    kept = len(keep)

    def run(batches):
        apply = compute()
        for batch in batches:
            for part in slices(batch, hidden):
                made = apply(part.column(hidden).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(kept)] + made, names=names)

    return src.mapInArrow(releasing(run), schema)


def sums_by_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, each from its own values alone; a run of length 0 sums to 0."""
    out = np.zeros((len(lengths), *values.shape[1:]))
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full], axis=0, dtype=np.float64)
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the session's shared folder.

    The folder is that of `shared_folder`.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


#: Bytes of all texts that a model is fitted on, which pass through the driver.
MOST_BYTES = 64 << 20


def fitting_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, group_col: str, extra: list[str]) -> list[tuple]:
    """(id, *extra, text) of the chosen ids, in order of group and draw.

    `chosen` holds the distinct rows (chosen_id, chosen_group, draw, *extra), of a number that its maker bounds. Repeated rows of an id
    and group give their least text. Of the texts, group by group, those are taken that come first and have
    MOST_BYTES / groups bytes together; none else reaches the driver.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("fit_id"), F.col(f"`{text_col}`").alias("fit_text"), (F.col(f"`{group_col}`") if group_col else F.lit(None)).alias("fit_group"))
    same = (F.col("fit_id") == F.col("chosen_id")) & ((F.col("fit_group") == F.col("chosen_group")) if group_col else F.lit(True))
    rows = rows.filter(F.col("fit_text").isNotNull()).join(F.broadcast(chosen), same)
    once = checkpoint(rows.groupBy("chosen_group", "draw", "chosen_id", *extra).agg(F.min("fit_text").alias("chosen_text")))
    sizes = once.select("chosen_group", "draw", "chosen_id", F.octet_length("chosen_text").alias("size"))
    groups = once.select("chosen_group").distinct().count()
    first = Window.partitionBy("chosen_group").orderBy("draw", "chosen_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the keys stay with the executors: rows made from the driver's would start further Python workers there, which then idle
    keys = sizes.withColumn("total", F.sum("size").over(first)).filter(F.col("total") <= MOST_BYTES // max(1, groups)).select("chosen_group", "chosen_id")
    found = once.join(F.broadcast(keys), ["chosen_group", "chosen_id"], "left_semi").orderBy("chosen_group", "draw", "chosen_id")
    return [(r["chosen_id"], *[r[c] for c in extra], r["chosen_text"]) for r in found.select("chosen_id", *extra, "chosen_text").toLocalIterator()]
