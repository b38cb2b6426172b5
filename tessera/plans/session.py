"""What every plan asks of the session: shared scratch space, cut lineage, the package on the workers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application.

    The zip is served by the driver, so executors need no shared folder and no installed copy.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tessera_workers.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder of its own (tests); a cluster must name one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if given:
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(given)
        return given.rstrip("/")
    if context.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        folder = tempfile.mkdtemp(prefix="tessera-scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + folder)
    return context.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: partitions stay as they are, and a lost executor costs nothing that was done before."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again; returns the frame and its path."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of scratch space that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """A point in time for sweep()."""
    return len(_made)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete the tables made since mark(); whoever calls knows that nothing reads them any more."""
    while len(_made) > since:
        discard(spark, _made.pop())


def rest(spark: SparkSession) -> None:
    """Give back the heap that executors have grown and no longer need; nothing that is live is lost.

    A JVM keeps a grown heap until a full collection, and a long run of stages ends with all of it, beside its Python workers. One task for each core asks for that collection.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') as x").write.format("noop").mode("overwrite").save()


def release() -> None:
    """At the end of a Python task: give back what the worker's allocators keep, as the worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
