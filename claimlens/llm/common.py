"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Input bytes that one vectorised step handles at once in a Python worker.
SLICE_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh one where it is unset and everything runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="claimlens-"))
        where = _fallback[0]
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/claimlens/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts the lineage.

    Lost executors then cost a re-read of files instead of recomputation, and
    several consumers do not run the plan above twice.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote for df; nothing that is still to run may read it."""
    _remove(df.sparkSession, df._written_to)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM is gone already
            return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives freed memory back: it waits beside the executor's heap for its next task."""

    @functools.wraps(run)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return go


def slices(batches: Iterator[pa.RecordBatch], text: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each piece holds about budget bytes (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]
