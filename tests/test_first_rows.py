"""The first rows of a table, in one task and by ranges."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import lineage


@pytest.mark.parametrize("n", [0, 1, 499, 500, 777, 1000, 5000])
def test_by_ranges(spark, n, monkeypatch):
    monkeypatch.setattr(lineage, "FIRST_ROWS", -1)
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(5)
    got = sorted((r["g"], -r["k"]) for r in lineage.first_rows(df, n, F.col("g"), F.col("k").desc()).collect())
    assert got == sorted((i % 3, -(i * 37 % 1000)) for i in range(1000))[:n]
