"""Names in texts by an automaton against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, names


def drawn(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcd ", k=draw.randint(1, 7)))
    known = [word() for _ in range(120)] + ["", None, "aa", "aaa", "aaaa"]
    texts = [(i, "".join(draw.choices("abcd ", k=draw.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "a" * 5000), (None, "aaaa")]
    return texts, known


@pytest.mark.parametrize("chars", [names.NAME_CHARS, 100])
def test_occurrences_and_outermost(spark, chars, monkeypatch):
    monkeypatch.setattr(names, "NAME_CHARS", chars)
    texts, known = drawn(chars)
    t = spark.createDataFrame(texts, "id long, text string")
    n = spark.createDataFrame([(x,) for x in known], "name string")
    found = names.occurrences(t, n)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    wanted = sorted({(i, x) for i, text in texts for x in known if x and text and x in text}, key=str)
    assert got == wanted
    outer = sorted((tuple(r) for r in names.outermost(found).collect()), key=str)
    assert outer == sorted([(i, x) for i, x in wanted if not any(j == i and y != x and x in y for j, y in wanted)], key=str)


def test_many_names_in_one_long_text(spark):
    text = " ".join(f"name{i}" for i in range(100_000))
    t = spark.createDataFrame([(1, text)], "query_id int, text string")
    triples = spark.range(20_000).select(F.concat(F.lit("Name"), F.col("id").cast("string")).alias("s"), F.lit("r").alias("r"), F.lit("none").alias("o"), F.lit("c").alias("chunk_id"))
    # Names within longer ones that the text names too go.
    assert graph.link_entities(t, triples).count() == 18_001  # name0 is within none
