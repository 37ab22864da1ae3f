"""What several operators share: the shared folder, written intermediate tables, bounded broadcasts, workers' memory."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.pieces import dealt

#: Rows up to which a narrow (at most a few dozen bytes a row) side may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loam-")


#: Rows and bytes of an Arrow batch, whatever the texts' lengths, in executors and their workers.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> dict[str, str]:
    """Lowers the session's bounds of an Arrow batch; gives what they were, for restored()."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in bounds}
    for name, most in bounds.items():
        if not 0 < int(before[name].rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    return before


def restored(spark: SparkSession, before: dict[str, str]) -> None:
    for name, value in before.items():
        spark.conf.set(name, value)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving the memory that it freed back to the system at the task's end: workers are used again."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local
    master, which is one machine; an error on any other."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _own_folder()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex}"


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside, but for those to be kept, are deleted at its end."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors. Deleted at the end of the scope
    that is open, if one is; one to be kept lasts as long as the scope around that."""
    path = fresh_path(df.sparkSession, name)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast only if it is counted to have no more than `rows` rows; use on narrow written tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n
