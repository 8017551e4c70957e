"""What the operators share: settled tables, shipped code, small joins, Arrow text."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of a word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table may be broadcast; beyond it the shuffled join is used.
BROADCAST_ROWS = 200_000
#: Rows of one Arrow batch: whole texts, so that a batch of long documents still fits.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make the package importable on every executor and bound the Arrow batches.

    The package goes out with ``addPyFile``, once for each application. A batch size that
    the caller has set stays.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for place, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where none is named, as in tests on one machine, a temporary folder; on a cluster that
    is an error, since executors don't see each other's disks.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/quillbase-{context.applicationId}"


_cleaned: set[str] = set()


def _remove_at_end(spark: SparkSession, place: str) -> None:
    """Let the JVM remove ``place`` when it exits, also after ``spark.stop()``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    place = shared_dir(spark)
    if place not in _cleaned:
        _cleaned.add(place)
        _remove_at_end(spark, place)
    path = f"{place}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for mapInArrow, that gives freed memory back when a task ends.

    Workers live on after a task, beside the next ones and the executor's heap.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a settled table for broadcast if its rows, counted here, are within ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal id, modulo ``folds`` (a null id counts as the empty string)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the n + 1 offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    n, i = len(ends) - 1, 0
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
