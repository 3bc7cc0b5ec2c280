"""Shared helpers of the training-data operators: column picking, Arrow streaming, shared scratch tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch where the session leaves Spark's default of 10,000: rows are whole texts here, and the JVM holds a
#: batch outside of its heap, several times over while it grows.
BATCH_ROWS = 1_000
#: Rows that the Parquet reader decodes at once where the session leaves Spark's default of 4,096: it holds their texts in one
#: array, doubled while it grows, and a heap that has grown for such arrays does not soon shrink.
READER_ROWS = 1_024
#: Rows handed to Python code at once after slicing an Arrow batch; bounds the decoded strings alive at a time.
SLICE_ROWS = 256

_scratch: dict[str, str] = {}
_shipped: set[str] = set()
#: What this Python worker keeps between tasks: (key, state) by operator name.
_warm: dict[str, tuple[object, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; a temporary folder of our own
    only where that is unset (tests on one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.applicationId not in _scratch:
        _scratch[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return _scratch[spark.sparkContext.applicationId]


def cut(df: DataFrame, tag: str, gather: bool = False) -> DataFrame:
    """Cut the lineage of df through a table in the shared folder; survives the loss of any executor.

    gather: many tasks give few numbers each, which are shuffled into files of Spark's advisory size. On a local disk Hadoop
    starts three processes for a file (chmod), each of which has the JVM's memory as its own until it runs its program."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if gather else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_count(spark: SparkSession) -> int:
    """Partitions for a shuffle into Python tasks: the session's number, and no fewer than its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def drop(df: DataFrame) -> None:
    """Delete a table written by `cut` that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's context, once: they need not have it installed. Also bound the
    session's Arrow and reader batches, unless it has set them."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="brindle-code-")) / "brindle_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def warm(name: str, key: object, make: Callable[[], object]) -> object:
    """State that a Python worker keeps from task to task, one per operator name; another key replaces it."""
    if name not in _warm or _warm[name][0] != key:
        _warm[name] = key, make()
    return _warm[name][1]


def release(keep: str | None) -> None:
    """Drop what other operators keep in this worker: all operators of a session share its workers, and their states
    together need not fit."""
    others = [name for name in _warm if name != keep]
    for name in others:
        del _warm[name]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory freed goes back to the system, from Arrow's pool and where the C library can do that: an idle worker would hold it
    beside the one that works."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pick(df: DataFrame, *cols: tuple[str, str]) -> DataFrame:
    """Only the named columns, cast to the types the operator works on; extra columns cannot clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in cols])


def stream(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: T.StructType | str, keep: str | None = None) -> DataFrame:
    """Map slices of rows: fn gets one Python list per input column and yields output tuples.

    No shuffle, memory bounded by a slice (plus what fn keeps), and a lost task can be run again on its own."""

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for cols in slices:
            yield list(fn(*cols))

    return stream_task(df, task, schema, keep)


def stream_task(df: DataFrame, task: Callable[[Iterator[list[list]]], Iterator[list[tuple]]], schema: T.StructType | str, keep: str | None = None) -> DataFrame:
    """As stream, for functions that keep something through a task: task gets an iterator of slices and yields row lists.
    keep: name of the state (see `warm`) that tasks leave in their worker for later ones."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = _arrow_schema(out)
    ship(df.sparkSession)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield [c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        for rows in task(slices(batches)):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        rows = None
        give_back()

    return df.mapInArrow(run, out)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
