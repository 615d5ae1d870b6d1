"""Tables that cut lineage: written once to the folder all executors share, then read again."""

from __future__ import annotations

import gc
import itertools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tables that cut() writes from one collection of the driver's garbage to the next.
TABLES = 8
_written = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, which only a session of one machine can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table as read from there.

    Unlike a local checkpoint the copy outlives every executor, and later steps plan from real sizes. After every TABLES
    tables the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for held in _open.__dict__.get("scopes", [])[-1:]:
        held[path] = spark
    df.write.parquet(path, compression=compression)
    if next(_written) % TABLES == 0:
        collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Collects what the driver no longer refers to: plans of queries that ended, and with them the shuffles and broadcasts that
    Spark's cleaner drops once their plan is gone. Else all that stays until the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


_open = threading.local()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that cut() wrote inside it, but for those handed to the function it yields.

    These must be all that a result made inside still reads. A scope within another hands its kept tables to that.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    held: dict[str, SparkSession] = {}
    kept: dict[str, SparkSession] = {}
    scopes.append(held)

    def keep(df: DataFrame) -> DataFrame:
        folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
        kept.update({path: spark for path, spark in held.items() if path.rsplit("/", 1)[-1] in folders})
        return df

    try:
        yield keep
    finally:
        scopes.pop()
        for path, spark in held.items():
            if path not in kept:
                _delete(spark, path)
        for outer in scopes[-1:]:
            outer.update(kept)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by cut()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def small_side(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
