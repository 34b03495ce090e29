"""Steps whose time grew faster than their input."""

import time

from pyspark.sql import functions as F

from tessera.operators import agent, evaluate, names


def test_names_around_a_hub_are_taken_in_linear_time(spark):
    n = 20_000
    facts = spark.range(n).select(F.lit("Hub").alias("s"), F.lit("has").alias("r"), F.concat(F.lit("Part "), F.format_string("%06d", "id")).alias("o"), F.col("id").cast("string").alias("chunk_id"))
    asked = spark.createDataFrame([(1, "the HUB and part 000001"), (2, "hub " + "long text " * 20_000)], "query_id long, text string")
    began = time.time()
    got = {r["query_id"]: (r["text"][-47:], r["method"]) for r in agent.rewrite(asked, facts).collect()}
    assert time.time() - began < 40
    assert got[1] == ("Part 000000 Part 000002 Part 000003 Part 000004", "graph-expansion")
    assert got[2] == ("Part 000000 Part 000001 Part 000002 Part 000003", "graph-expansion")
    # Without room for names the graph still counts.
    assert agent.rewrite(asked, facts, most=0).where("method = 'graph-expansion'").count() == 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_sought_by_one_pass_or_by_keys_alike(spark, monkeypatch):
    texts = ["one two three four five six seven", "xone two three four five six sevenx", "two three", "", None, "a \U0001f600 b", "one two three four five  six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "one two three four five six seven"), (2, "two three"), (3, ""), (4, None), (5, "\U0001f600"), (6, "two three"), (7, "three four five six seven eight")]
    items = spark.createDataFrame(items, "query_id int, text string")
    found = evaluate.containing(docs, items)
    assert "xxhash64" not in _plan(found)
    want = sorted((d, q) for q, i in items.where("text != ''").collect() for d, t in enumerate(texts) if t and i in t)
    assert sorted(map(tuple, found.select("doc_id", "query_id").collect())) == want
    monkeypatch.setattr(names, "NAME_CHARS", 60)
    keyed = evaluate.containing(docs, items)
    assert "xxhash64" in _plan(keyed)
    assert sorted(map(tuple, keyed.select("doc_id", "query_id").collect())) == want


def test_characters_are_counted_without_an_array_of_them(spark):
    import re

    from tessera.llm import quality_rules as Q

    texts = ["", None, "abC 1.#\n\x0b", "é\U0001f600 Z|z~\\ \"x\"", "a" * 5000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    counted = Q._counts(docs, Q.COMMON)
    assert "[a-z], 0)" not in _plan(counted)
    patterns = [p for _, p in Q.CLASSES[:-1]] + [r"[!-~](?<![a-zA-Z0-9.,;:!?'\"()-])"]
    for r in counted.collect():
        text = texts[r["doc_id"]] or ""
        want = [len(re.findall(p, text)) for p in patterns]
        assert r["chars"] == want and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
