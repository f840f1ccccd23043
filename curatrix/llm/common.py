"""Helpers shared by the training-data operators: tables, shared scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []
_roots: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session without it gets an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="curatrix-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return f"file://{_local_dir[0]}"


class Scratch:
    """Tables written once to the shared folder, so that later jobs do not depend on lost executors.

    ``keep`` writes a DataFrame and gives it back as read from the table; ``drop`` removes tables that no later
    plan reads any more.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/curatrix/{label}-{uuid.uuid4().hex}"
        _roots.append(self.root)
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if path := getattr(f, "_scratch_path", None):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_mark() -> int:
    """How much scratch there is now, for `drop_scratch`."""
    return len(_roots)


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Removes the scratch tables that this driver has written since a mark; to be called when what reads them is stored."""
    n = len(_roots) - since
    while len(_roots) > since:
        _delete(spark, _roots.pop())
    return n


#: Rows of whole texts that go to a Python worker at once; Spark's own 10,000 can be hundreds of megabytes on both sides.
TEXT_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: A table of at most so many bytes may be one row group, which one task would read; it is dealt over all cores.
SPREAD_BYTES = 32 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """``df`` for work on its texts in Python, spread over the cores if it is small.

    From now on the session sends at most TEXT_ROWS rows in an Arrow batch (a smaller setting stays).
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= TEXT_ROWS:
        conf.set(BATCH_SETTING, str(TEXT_ROWS))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


_resident: dict = {}


def resident(key: object, make: Callable[[], Any]) -> Any:
    """A worker's state for later tasks, such as caches. A worker holds one at a time: what another operator left goes."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Gives back the memory that other operators' states hold in this worker."""
    if _resident:
        _resident.clear()
        trim()


def trim() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """``run`` for mapInArrow, which leaves no freed memory in its worker when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def row_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` (string or binary) has about ``max_bytes`` in each; a longer value stands alone."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(column)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        lo, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield b.slice(lo, i - lo)
                lo, total = i, 0
            total += int(n)
        yield b.slice(lo)


def utf8_bytes(col):
    """Column: length in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
