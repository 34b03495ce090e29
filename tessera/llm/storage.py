"""Shared storage: cutting lineage and keeping files that every executor reads.

All of it lies under the folder named by ``spark.checkpoint.dir``. Only where
that is unset and the master is local, as in tests, a temporary folder is used.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, shared_folder

__all__ = ["Arrays", "cut", "load_array", "new_folder", "numbered", "save_array", "write_table"]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as Parquet: columns that a reader doesn't ask for stay unread."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `n`, the number of each row from 0 by the order, nulls last. Rows are
    dealt by ranges of the order and numbered within each; only the ranges' sizes
    meet in one task."""
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = write_table(df.repartitionByRange(*by).withColumn("n_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("n_range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("n_range")) - F.col("size")
    starts = sizes.select("n_range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("n_range").orderBy(*by)) - 1
    return ranged.withColumn("n", place).join(F.broadcast(starts), "n_range").withColumn("n", F.col("before") + F.col("n")).drop("n_range", "before")


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def save_array(uri: str, array: np.ndarray) -> None:
    """Written whole under another name and then renamed: a retried or a doubled
    task leaves the same file."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            np.save(out, array)
        system.move(part, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


def load_array(uri: str) -> np.ndarray:
    """Memory-mapped from a mounted folder, else read through its file system."""
    path = _local(uri)
    if path is not None:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        return np.load(source)


class Arrays:
    """Arrays that a task has open. Mapped ones cost no memory of its own; of those
    that had to be read, the last used stay, up to `limit` bytes."""

    def __init__(self, limit: int = 256 << 20):
        self.limit, self.held, self.open = limit, 0, {}

    def load(self, uri: str) -> np.ndarray:
        array = self.open.pop(uri, None)
        if array is None:
            array = load_array(uri)
            self.held += self._cost(array)
        self.open[uri] = array  # the last used is the last in order
        while self.held > self.limit and len(self.open) > 1:
            self.held -= self._cost(self.open.pop(next(iter(self.open))))
        return array

    @staticmethod
    def _cost(array: np.ndarray) -> int:
        return 0 if isinstance(array, np.memmap) else array.nbytes
