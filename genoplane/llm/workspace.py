"""Shared storage for intermediate tables, and the text-to-Python bridge."""

from __future__ import annotations

import gc
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the functions of this package with the task and need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Fixed pattern of the white space that separates words.
WHITE_SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes that one Arrow batch hands to Python at most.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20
#: Bytes of the Arrow batches that the JVM sends.
ARROW_BYTES = 12 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, as in tests, a temporary one in local mode, and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="genoplane-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


_open = threading.local()


def _tables() -> list[list[str]]:
    if not hasattr(_open, "tables"):
        _open.tables = []
    return _open.tables


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows and ARROW_BYTES at most, for the jobs inside; the session's own settings come back."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, limit in limits.items():
            spark.conf.set(name, limit)
        yield
    finally:
        for name, limit in before.items():
            spark.conf.set(name, limit)


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: it is computed once, and outlives executors.

    batch_rows bounds the Arrow batches on the way. Inside a ``tidy`` function the table is deleted at its end.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if tables := _tables():
        tables[-1].append(path)
    with arrow_batches(df.sparkSession, batch_rows):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def noted(paths: list[str]):
    """Adds the paths of the tables that are written inside, for whoever deletes them."""
    tables = _tables()
    tables.append(paths)
    try:
        yield
    finally:
        tables.pop()


def tidy(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Writes the function's result and deletes the tables that it wrote on the way.

    The result is one table, so neither settings nor intermediates matter to whoever reads it later.
    """

    @wraps(function)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        tables = _tables()
        tables.append([])
        try:
            result = function(docs, *args, **options)
            made, tables[-1] = tables[-1], []
            result = written(result, function.__name__)
            kept = tables[-1]
            tables[-1] = made
        except BaseException:
            for path in tables.pop():
                delete(docs.sparkSession, path)
            raise
        for path in tables.pop():
            delete(docs.sparkSession, path)
        if tables:
            tables[-1] += kept
        return result

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def per_worker(key: tuple, build: Callable[[], object]) -> object:
    """build()'s result, once in each Python worker process, which Spark reuses for its tasks.

    Functions of this package come to a worker by value with each task, so a module of theirs can't hold it.
    """
    held = sys.modules.setdefault("_genoplane_worker", ModuleType("_genoplane_worker")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows and bytes of text at most; a longer row is a part of its own."""
    lengths = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        start = int(ends[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, start + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def over_texts(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str,
    rows: int = BATCH_ROWS,
    size: int = BATCH_BYTES,
) -> DataFrame:
    """Runs make()'s function over Arrow batches of the columns, of so many rows and bytes at most; make runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects and no cycles: looking for these takes half the time
        try:
            work = make()
            for whole in batches:
                for batch in slices(whole, rows, size):
                    if (out := work(batch)) is not None:
                        yield out
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(run, schema)


def fold(column: str = "doc_id", modulus: int = 2) -> F.Column:
    """crc32 of the id as decimal text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
