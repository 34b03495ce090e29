"""The shared folder of a session: cutting a plan's lineage, and folders for tables.

On a cluster spark.checkpoint.dir names it. Only where the master is local, as in
tests, a temporary folder stands in.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same, as a stored table: its size is known, so that a small one is joined by
    broadcast."""
    folder = new_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows up to which the first of a table are gathered in one task.
FIRST_ROWS = 100_000


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by an order that tells all rows apart. Up to FIRST_ROWS of them meet
    in one task; more are dealt by ranges of the order, of which only the one that the n
    end in is sorted."""
    if n <= FIRST_ROWS:
        return df.orderBy(*order).limit(n)
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # A row for each range.
    sizes = sorted(ranged.groupBy("_range").count().collect())
    before, last = 0, None
    for number, size in sizes:
        if before + size > n:
            last = number
            break
        before += size
    if last is None:
        return ranged.drop("_range")
    whole = ranged.where(F.col("_range") < last).drop("_range")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    part = ranged.where(F.col("_range") == last).withColumn("_place", place).where(F.col("_place") <= n - before)
    return whole.unionByName(part.drop("_range", "_place"))
