"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoint import delete, root, written

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than one row in this many; so fewer than this many keys are.
HOT = 1_000

_SCRATCH: list[str] = []


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage, survives lost executors and gives the optimizer true
    sizes. The table stays while a DataFrame reads it; with ``keep`` until the
    application ends. What is written inside a scratch goes when that ends.
    """
    spark = df.sparkSession
    if keep:
        path = f"{root(spark)}/kept/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return written(df, tag, f"{root(spark)}/{_SCRATCH[-1]}" if _SCRATCH else None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, unless kept."""
    _SCRATCH.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        delete(spark, f"{root(spark)}/{_SCRATCH.pop()}")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, tag: str) -> DataFrame:
    """Every row as (row_id, doc), written once: its number and all its columns as a struct.

    The caller's columns lie inside the struct, so none can clash with an
    operator's own, whatever their names and types; numbers differ even for
    rows that are equal in all columns.
    """
    row = F.struct(*[quoted(c) for c in docs.columns])
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), row.alias("doc")), tag)


def texts_of(rows: DataFrame, *names: str) -> DataFrame:
    """row_id and some columns of numbered rows; only these are read."""
    return rows.select("row_id", *[F.col("doc").getField(n).alias(n) for n in names])


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each ``key`` and says how many rows hold it.

    Keys that hold more than one row in ``HOT`` are fewer than HOT by
    arithmetic: these go to the rows as a broadcast, so no task gathers one.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) > total / HOT
    often = rows.join(F.broadcast(table.filter(hot)), key)
    rare = rows.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti").join(table.filter(~hot), key)
    return often.unionByName(rare)


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def running_sum(
    df: DataFrame, group: list[str], order: list[Column], buckets: list[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` that come before.

    Rows are ordered by ``buckets`` (whole numbers) and then ``order``. Buckets
    are summed first, so no task ever holds more than one bucket of a group,
    however hot the group is.
    """
    totals = df.groupBy(*group, *buckets).agg(F.sum(value).alias("_all"))
    ahead = Window.partitionBy(*group).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_all").over(ahead), F.lit(0))).drop("_all")
    inner = (
        Window.partitionBy(*group, *buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, [*group, *buckets])
        .withColumn(out, F.col("_in") + F.col("_ahead"))
        .drop("_in", "_ahead")
    )
