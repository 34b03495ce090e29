"""The segmented index against a search of the whole corpus."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, postings, search
from tessera.operators.lineage import new_folder


def corpus(seed, n, terms=400):
    """Texts of words with falling frequency: w0 is in most, the last in few."""
    draw = random.Random(seed)
    weights = [1 / (i + 1) for i in range(terms)]
    return [(i, " ".join(f"w{x}" for x in draw.choices(range(terms), weights, k=draw.randint(0, 60)))) for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def stored(spark):
    docs = spark.createDataFrame([*corpus(1, 3000), (3000, None), (3001, "")], "chunk_id long, text string").repartition(3)
    folder = new_folder(spark, "test-postings")
    for n in (0, 1):
        postings.add_segment(docs.where(F.col("chunk_id") % 2 == n), folder, buckets=4, chunk_tokens=20_000)
    return docs, folder


QUESTIONS = [(1, "w0 w399"), (2, "w0 w1 w2"), (3, "w350 w350 w20"), (4, "nowhere"), (5, ""), (6, None), (7, " ".join(f"w{i}" for i in range(40))), (8, "w399 w398 w0 w1 w2 w3")]


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_equals_a_whole_search(spark, stored, k):
    docs, folder = stored
    questions = spark.createDataFrame(QUESTIONS, "query_id int, text string")
    assert rows(postings.search(spark, folder, questions, k)) == rows(search.bm25_topk(docs, questions, k))


def test_more_terms_than_a_filter_takes(spark, stored, monkeypatch):
    docs, folder = stored
    questions = spark.createDataFrame(QUESTIONS, "query_id int, text string")
    monkeypatch.setattr(postings, "FILTER_TERMS", 3)
    assert rows(postings.search(spark, folder, questions, 5)) == rows(search.bm25_topk(docs, questions, 5))


def _bytes_read(df):
    """Sizes of the files that the plan's scans open, after pruning."""
    df.collect()
    found, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif "QueryStage" in name:
            stack.append(node.plan())
        elif name.startswith("Scan parquet"):
            found += node.metrics().apply("filesSize").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def test_blocks_are_skipped_and_rare_terms_read_less(spark, stored):
    _, folder = stored
    questions = spark.createDataFrame([(1, "w399 w0 w1"), (2, "w0 w1 w2")], "query_id int, text string")
    seen = {r["query_id"]: r for r in postings.pruning(spark, folder, questions, 3).collect()}
    assert seen[1]["decoded"] < seen[1]["blocks"] / 2
    one = spark.createDataFrame([("w399",)], "term string")
    every = spark.createDataFrame([(f"w{i}",) for i in range(400)], "term string")
    rare, whole = postings.read_blocks(spark, folder, one), postings.read_blocks(spark, folder, every)
    assert _bytes_read(rare) < _bytes_read(whole)
    assert rare.agg(F.sum("n")).first()[0] < whole.agg(F.sum("n")).first()[0] / 50


def test_updates(spark):
    old = spark.createDataFrame([(str(i), t) for i, t in corpus(2, 300, 60)], "chunk_id string, text string")
    folder = new_folder(spark, "test-postings")
    postings.add_segment(old, folder, buckets=4)
    questions = spark.createDataFrame([(1, "w0 w59"), (2, "w3 w4 fresh")], "query_id int, text string")
    now = old
    for step in range(3):
        n = F.col("chunk_id").cast("long") % 7
        new = now.where(n != step).withColumn("text", F.when(n == step + 1, F.concat("text", F.lit(" fresh w59"))).otherwise(F.col("text")))
        new = new.unionByName(spark.createDataFrame([(str(1000 + step), "fresh w0 w1")], "chunk_id string, text string"))
        hashed = [x.select(F.col("chunk_id").alias("doc_id"), F.xxhash64("text").alias("hash"), F.lit("s").alias("strategy")) for x in (new, now)]
        postings.update(new, index.incremental_diff(*hashed), folder)
        now = new
        assert rows(postings.search(spark, folder, questions, 10)) == rows(search.bm25_topk(now, questions, 10))


def test_an_empty_segment(spark):
    folder = new_folder(spark, "test-postings")
    postings.add_segment(spark.createDataFrame([], "chunk_id long, text string"), folder, buckets=2)
    questions = spark.createDataFrame([(1, "w0")], "query_id int, text string")
    assert rows(postings.search(spark, folder, questions, 10)) == []
    postings.add_segment(spark.createDataFrame([(1, "w0 w1")], "chunk_id long, text string"), folder)
    assert len(rows(postings.search(spark, folder, questions, 10))) == 1


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


def test_postings_are_sent_once_however_many_queries(spark, stored):
    _, folder = stored
    text = " ".join(f"w{i}" for i in range(30))
    ask = lambda n: _shuffled(spark, lambda: rows(postings.search(spark, folder, spark.createDataFrame([(i, text) for i in range(n)], "query_id int, text string"), 10)))
    assert ask(20) < 2.5 * ask(2)


def test_copies_that_tie_at_the_last_place_and_dead_ones(spark):
    docs = spark.createDataFrame([(i, "w0 w1 w2") for i in range(300)] + [(1000 + i, "w0 w3") for i in range(50)], "chunk_id long, text string").repartition(3)
    folder = new_folder(spark, "test-postings")
    postings.add_segment(docs, folder, buckets=2, chunk_tokens=200)
    gone = docs.where("chunk_id % 3 = 0 and chunk_id < 1000").select(F.col("chunk_id").alias("doc_id"), F.lit("removed").alias("status"))
    postings.update(docs.where("chunk_id % 3 != 0 or chunk_id >= 1000"), gone, folder)
    questions = spark.createDataFrame([(1, "w0 w2"), (2, "w3 w0"), (3, "w1")], "query_id int, text string")
    kept = docs.where("chunk_id % 3 != 0 or chunk_id >= 1000")
    assert rows(postings.search(spark, folder, questions, 7)) == rows(search.bm25_topk(kept, questions, 7))
