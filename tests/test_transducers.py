"""Relations and citations by linear passes against plain patterns with backtracking."""

import random
import re
import time

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluate, graph

PLAIN = {
    "uses": r"(Product\s+[A-Z])\b.*?uses\b.*?((?:Component\s+)?[A-Z]{1,3}-?\d+)",
    "supplied_by": r"((?:Component\s+)?XK-7)\b.*?supplied by\s+([A-Z][A-Za-z.\- ]+(?:GmbH|Inc|LLC|Electrics|Precision)?)",
    "supplies_rev": r"Supplies:\s*((?:Component\s+)?[A-Z]{1,3}-?\d+).*?([A-Z][A-Za-z.\- ]+(?:GmbH|Inc|LLC))",
}
PARTS = [
    "Product A", "product  b", "Product", "Products C", "uses", "causes", "used", "Component ", "Component AB-12", "XK-7", "component xk-7", "xk-77", "AB12", "Z9", "supplied by ", "supplied by",
    "Supplies:", "supplies: ", "Acme GmbH", "Inc", "A Inc", "x.Inc Inc LLC", "GmbH", " ", ",", "\n", ". ", "-", "1", "Nord-Werk LLC 5",
]


def test_chains_equal_patterns():
    draw = random.Random(4)
    seen = 0
    for _ in range(20_000):
        text = draw.choice(["", " "]).join(draw.choices(PARTS, k=draw.randint(1, 14)))
        for chain in graph.RELATIONS:
            wanted = [m.groups() for m in re.finditer(PLAIN[chain.relation], text, re.IGNORECASE | re.DOTALL)]
            assert list(chain.pairs(text)) == wanted, (chain.relation, text)
            # A sentence with a match has the chain's words.
            assert not wanted or all(w in text.lower() for w in chain.words)
            seen += len(wanted)
    assert seen > 1000


def test_long_sentences_take_seconds(spark):
    n = 100_000
    rows = [
        ("a", "Product A " * n), ("b", "Product A uses AB-1 " + "Product A " * n + "uses"), ("c", "Product A uses " * n), ("d", "Supplies: AB-1 " + "a " * n + "Inc"),
        ("e", "Supplies: AB-1 " * n), ("f", "XK-7 " * n + "supplied by"), ("g", "Product A uses AB-1 " * n), ("h", "[" * n + "x]"), ("i", "[a.md] " * n), ("j", "]" * n + "[" * n),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(8)
    begin = time.time()
    got = {(r["s"], r["r"], r["o"]): r["chunk_id"] for r in graph.extract_triples(df, seeds=()).collect()}
    assert got["Product A", "uses", "AB-1"] == "b" and ("AB-1", "supplied_by", ("a " * n + "Inc").strip()) in got
    marks = df.select("chunk_id", F.size(F.filter(evaluate._between_citations(F.col("text")), lambda x: x["mark"].isNotNull())).alias("n"))
    assert {r["chunk_id"]: r["n"] for r in marks.collect()}["i"] == n
    assert time.time() - begin < 60


def test_citations_equal_the_pattern(spark):
    draw = random.Random(6)
    parts = ["[a.md]", "[b.txt]", "[", "]", ".md]", "[c.exe]", " text. ", "\n", "[[x.pdf]", "[.md]", "[a.md", "y.html]", "[two words.docx]"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", evaluate._between_citations(F.col("t")).alias("x"))
    for r in df.collect():
        split = re.split(T.CITATION, r["t"])
        assert [(p["gap"], p["mark"]) for p in r["x"]] == list(zip(split[::2], [*split[1::2], None], strict=True)), r["t"]
