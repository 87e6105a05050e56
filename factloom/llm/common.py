"""Helpers shared by the corpus operators: tables, shared-folder persistence, flat byte batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; a longer document is handled alone.
CHUNK_BYTES = 1 << 21
#: Bytes of a batch on its way to a Python worker.
ARROW_BYTES = 8 << 20
#: Folders that the running operators have written, a list for each of them.
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes, for this session, unless they are smaller already: the JVM holds a batch
    while it grows, and so does the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().removesuffix("b")
    if not held.isdigit() or int(held) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is saved, and whose other saved tables are removed then."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        _open.append([])
        try:
            out = operator(*args, **options)
        finally:
            folders = _open.pop()
        out = saved(out, operator.__name__.replace("_", "-"))
        for folder in folders:
            remove(out.sparkSession, folder)
        return out

    return run


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether a saved table has at most ``limit`` bytes on disk by the optimizer's own count."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def whole_number(df: DataFrame, key: str) -> None:
    """Refuse a key that is no integer column."""
    if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer column, not {df.schema[key].dataType.simpleString()}")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` each, and ``rows`` rows at most; at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows, at + rows if rows else batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without searches for garbage cycles, which cost much beside a large cache; what goes here has no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def release() -> None:
    """Give memory that nothing uses back to the system: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: str = "text"):
    """A column's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(bytearray()))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
