"""A stored table of points is updated by buckets; other files stay as they are."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files


def stored_files(folder):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def held(spark, folder):
    return {r["chunk_id"]: r["text"] for r in files.read_points(spark, folder).collect()}


@pytest.fixture
def folder(spark, tmp_path):
    points = spark.range(200).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("old").alias("text"))
    files.write_points(points, f"{tmp_path}/points", 16)
    return f"{tmp_path}/points"


def test_upserts_touch_their_buckets_only(spark, folder):
    before = stored_files(folder)
    files.upsert_in_place(spark.createDataFrame([("c3", "new"), ("fresh", "new")], "chunk_id string, text string"), folder, 16)
    after = stored_files(folder)
    assert held(spark, folder) == {**{f"c{i}": "old" for i in range(200)}, "c3": "new", "fresh": "new"}
    same = {f for f in before if after.get(f) == before[f]}
    assert len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in same}) <= 2 and len(same) >= 14
    # Once more: nothing but those buckets, and the same rows.
    files.upsert_in_place(spark.createDataFrame([("c3", "new")], "chunk_id string, text string"), folder, 16)
    assert len(held(spark, folder)) == 201


def test_pruning_even_empties_buckets(spark, folder):
    before = stored_files(folder)
    files.prune_in_place(spark.createDataFrame([("c3",), ("nowhere",)], "chunk_id string"), folder, 16)
    after = stored_files(folder)
    assert len(held(spark, folder)) == 199 and sum(after.get(f) == t for f, t in before.items()) >= 15
    files.prune_in_place(files.read_points(spark, folder).select("chunk_id"), folder, 16)
    assert held(spark, folder) == {}
    files.upsert_in_place(spark.createDataFrame([("x", "y")], "chunk_id string, text string"), folder, 16)
    assert held(spark, folder) == {"x": "y"}


def _shuffled(spark, work):
    """Bytes that the stages of work() write to shuffles."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    work()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def test_an_update_sends_a_text_once(spark, tmp_path, monkeypatch):
    # Texts that don't shrink; no table is so small that it is joined by broadcast.
    text = F.concat(*(F.sha2(F.concat_ws(",", F.lit(str(i)), "id"), 256) for i in range(32)))
    points = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), text.alias("text"))
    files.write_points(points, f"{tmp_path}/points", 4)
    size = 2000 * 32 * 64
    ids = points.where("substring(chunk_id, -1, 1) = '3'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert _shuffled(spark, lambda: files.upsert_in_place(ids.withColumn("text", F.lit("new")), f"{tmp_path}/points", 4)) < 1.5 * size
        assert _shuffled(spark, lambda: files.prune_in_place(ids.select("chunk_id"), f"{tmp_path}/points", 4)) < 1.5 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert files.read_points(spark, f"{tmp_path}/points").join(points, ["chunk_id", "text"]).count() == 1800 == files.read_points(spark, f"{tmp_path}/points").count()
