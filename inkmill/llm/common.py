"""Shared pieces: written intermediate tables, hash folds, ASCII case folding."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only where that setting is absent, as in local tests, a folder of our own is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="inkmill-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back.

    Unlike Dataset.checkpoint the last stage runs once, and the files survive lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/inkmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._inkmill_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a table from materialize(), once nothing will read them again."""
    path = getattr(df, "_inkmill_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver next runs short.

    Python's references to the steps' plans are given up first; the JVM hears of that with a delay,
    and the plans go with its second collection.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what this process has freed to the system; Arrow's pool and the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that ends with give_back(), as workers outlive it: what one held at its peak would count
    with all later steps of the job, also those without Python."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """lean() for a function of one group."""

    def group(table: pa.Table) -> pa.Table:
        worker_held(None)
        try:
            return run(table)
        finally:
            give_back()

    return group


def lean_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """lean() for a function of the groups of two tables."""

    def groups(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_held(None)
        try:
            return run(left, right)
        finally:
            give_back()

    return groups


_held: dict[tuple, object] = {}


def worker_held(key: tuple | None, make: Callable[[], object] | None = None) -> object:
    """What a worker process keeps between tasks: one thing at a time, so that the memos of operators
    that follow each other don't add up. Without a key it lets go of everything."""
    if key not in _held:
        _held.clear()
        give_back()
        if key is not None:
            _held[key] = make()
    return _held.get(key)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has already ended
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def id_fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as remainder -1, in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
