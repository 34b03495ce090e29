"""The vector index against an exhaustive search."""

import numpy as np
import pytest

from tessera.operators import search, vectors
from tessera.operators.lineage import new_folder


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def built(spark):
    """Clouds of vectors, a vector that a third of the rows share, and unusable rows."""
    draw = np.random.default_rng(3)
    clouds = draw.normal(size=(20, 16))
    points = [(i, (clouds[i % 20] + 0.4 * draw.normal(size=16)).tolist()) for i in range(1500)]
    hot = draw.normal(size=16).tolist()
    points += [(2000 + i, hot) for i in range(750)] + [(3000, [0.0] * 16), (3001, None), (3002, []), (3003, [1.0, 2.0])]
    table = spark.createDataFrame(points, "chunk_id long, vector array<double>").repartition(5)
    asked = [(i, points[i * 37][1]) for i in range(30)] + [(100, hot), (101, [0.0] * 16), (102, [1.0]), (103, None)]
    queries = spark.createDataFrame(asked, "query_id int, vector array<double>")
    folder = new_folder(spark, "test-vectors")
    return table, queries, folder, vectors.build(table, folder, cells=20)


@pytest.mark.parametrize("piece", [vectors.PIECE, 100])
def test_exact_search(spark, built, piece, monkeypatch):
    table, queries, folder, model = built
    monkeypatch.setattr(vectors, "PIECE", piece)
    usable = queries.where("size(vector) = 16")
    got = rows(vectors.search(spark, folder, model, usable, 10, probes=2, exact=True))
    assert got == rows(search.dense_topk(table, usable, 10))


def test_recall_of_few_cells(spark, built):
    table, queries, folder, model = built
    usable = queries.where("size(vector) = 16 and query_id < 100")
    got = {(q, c) for q, c, _, _ in rows(vectors.search(spark, folder, model, usable, 10, probes=6))}
    wanted = {(q, c) for q, c, _, _ in rows(search.dense_topk(table, usable, 10))}
    assert len(got & wanted) >= 0.9 * len(wanted)


def test_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as chunk_id", "embedding as vector")
    asked = e.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    folder = new_folder(spark, "test-vectors")
    model = vectors.build(e, folder, cells=32)
    got = {(q, c) for q, c, _, _ in rows(vectors.search(spark, folder, model, asked, 10, probes=24))}
    wanted = {(q, c) for q, c, _, _ in rows(search.dense_topk(e, asked, 10))}
    assert len(got & wanted) >= 0.9 * len(wanted)


def test_every_usable_row_is_indexed(spark, built):
    table, _, folder, _ = built
    stored = spark.read.parquet(f"{folder}/rows")
    assert stored.count() == table.where("size(vector) = 16").count() == stored.select("chunk_id").distinct().count()
    assert spark.read.parquet(f"{folder}/cells").selectExpr("sum(n)").first()[0] == stored.count()


def test_the_fit_takes_a_sample(spark, built, monkeypatch):
    table, queries, _, _ = built
    monkeypatch.setattr(vectors, "SAMPLE", 200)
    folder = new_folder(spark, "test-vectors")
    model = vectors.build(table, folder, cells=20)
    usable = queries.where("size(vector) = 16")
    assert spark.read.parquet(f"{folder}/rows").count() == 2251 and len(model["centres"]) <= 20
    assert rows(vectors.search(spark, folder, model, usable, 5, probes=2, exact=True)) == rows(search.dense_topk(table, usable, 5))


def test_no_vectors(spark):
    assert vectors.build(spark.createDataFrame([(1, None)], "chunk_id long, vector array<double>"), new_folder(spark, "test-vectors")) is None


def test_ragged_vectors_in_the_whole_search(spark, built):
    table, queries, _, _ = built
    found = search.dense_topk(table, queries, 5)
    assert {r["query_id"] for r in found.collect()} == {*range(30), 100, 101}


def test_a_piece_sends_on_k_rows_a_query(spark, built, monkeypatch):
    """Whatever codes let through: a third of the rows are equally near to a query."""
    table, queries, folder, model = built
    sent, whole = [], vectors.ranked
    monkeypatch.setattr(vectors, "SCORES", 5_000)
    monkeypatch.setattr(vectors, "ranked", lambda hits, *rest: sent.append(hits.groupBy("query_id").count().agg({"count": "max"}).first()[0]) or whole(hits, *rest))
    hot = queries.where("query_id = 100")
    got = rows(vectors.search(spark, folder, model, hot, 3, probes=20, exact=True))
    assert got == rows(search.dense_topk(table, hot, 3)) and sent[-1] <= 3 * 20
