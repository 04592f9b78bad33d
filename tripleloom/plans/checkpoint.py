"""Cutting lineage in iterative plans so that rounds survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Written tables of each application: the path, and a weak reference to what plans that read it hold.
_TABLES: dict[str, list[tuple[str, object]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and all runs in one process
    (tests, single machine) is a temporary folder made.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tripleloom-"))
        at = context.getCheckpointDir()
    return at


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def root(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark).rstrip('/')}/tripleloom/{app}-{uuid.uuid4().hex[:8]}"
        system, path = _file_system(spark, _ROOTS[app])
        system.deleteOnExit(path)
    return _ROOTS[app]


def delete(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete the tables that no plan can read any more.

    Every DataFrame over a table, derived ones too, holds the table's list of
    files in its plan; once the JVM has collected that, nothing can read it.
    """
    app = spark.sparkContext.applicationId
    left = []
    for path, held in _TABLES.get(app, []):
        if held.get() is None:
            delete(spark, path)
        else:
            left.append((path, held))
    _TABLES[app] = left


def written(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """``df`` as a table that was written to the shared folder and is read from there.

    A written table is computed once, can be read by any executor, and has a
    known size, by which Spark picks the joins that follow. It stays as long as
    a DataFrame over it does, and goes with the next table after that.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{folder or root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append((path, spark._jvm.java.lang.ref.WeakReference(files)))
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    return written(df, "round")
