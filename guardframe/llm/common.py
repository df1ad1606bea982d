"""Helpers that the corpus operators share: table access, durable cuts, batching."""

from __future__ import annotations

import atexit
import ctypes
import functools
import itertools
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case and lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: str.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


#: Bytes of an Arrow batch that a Python worker is given, unless the session bounds it itself.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches more tightly than Spark does itself, as a task holds several at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":  # not set
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark touches the path, so any Hadoop store works."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a ``local`` master (tests, the benchmark) gets a temporary
    folder; a cluster is refused, as its executors share no folder that could be
    guessed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="guardframe-")
        atexit.register(shutil.rmtree, local, True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage in storage that survives any executor; the columnar
    copy also lets later readers prune columns, which an RDD checkpoint can't.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name``, a number of its own for each row, the same whenever it is read.

    Rows of a table as it was read from files are known by their places in these,
    and only a row per file is kept; anything else is written out.
    """
    spark = df.sparkSession
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            place = df.metadataColumn("_metadata")
            placed = df.select(*(F.col(f"`{c}`") for c in df.columns), place["file_path"].alias("__file"), place["row_index"].alias("__at"))
        except AnalysisException:  # not of files, or of a kind without places
            placed = None
        if placed is not None:
            files = sorted(placed.groupBy("__file").agg(F.count("*"), F.max("__at")).collect())
            if all(n == last + 1 for _, n, last in files):  # each file is read once
                starts = itertools.accumulate((n for _, n, _ in files), initial=0)
                first = spark.createDataFrame([(f, s) for (f, *_), s in zip(files, starts)], "__file string, __first long")
                return placed.join(F.broadcast(first), "__file").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__first") + F.col("__at")).alias(name))
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


Batches = Iterator[pa.RecordBatch]


_released_at = 0.0


def _release() -> None:
    """Gives free memory back to the system, once a second at most, as it takes some milliseconds."""
    global _released_at
    if time.monotonic() - _released_at > 1:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)
        _released_at = time.monotonic()


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, after which the worker gives its free memory back.

    Workers outlive their tasks; what each stage's allocators keep would add up
    over the stages of a long session.
    """

    @functools.wraps(run)
    def to_end(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _release()

    return to_end


def fold(key: str, folds: int) -> Column:
    """crc32 of an id's decimal text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each holds about ``most_bytes``.

    Long documents then never meet in one Python list; a single longer text
    still comes whole.
    """
    for batch in batches:
        at, col = 0, batch.column(column)
        while at < batch.num_rows:
            step = batch.num_rows - at
            while step > 1 and col.slice(at, step).nbytes > most_bytes:
                step = (step + 1) // 2
            yield batch.slice(at, step)
            at += step
