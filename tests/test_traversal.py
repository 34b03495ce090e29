"""Traversal with hubs against breadth-first search."""

import random

import pytest

from tessera.operators import graph


def search(edges, start, hops):
    found, seen, frontier = {}, {start}, {start}
    for hop in range(1, hops + 1):
        met = [e for e in edges if e[0].lower() in frontier or e[2].lower() in frontier]
        for e in met:
            found.setdefault(e[:3], hop)
        frontier = {x.lower() for e in met for x in (e[0], e[2])} - seen
        seen |= frontier
    return found


@pytest.mark.parametrize("hub", [graph.HUB, 5, 1])
def test_six_hops_with_a_hub(spark, hub):
    draw = random.Random(hub)
    edges = [(f"N{draw.randint(0, 300)}", "r", f"n{draw.randint(0, 300)}", "c") for _ in range(150)] + [("Hub", "to", f"n{i}", "c") for i in range(0, 300, 3)] + [("n1", "self", "N1", "c")]
    starts = [(1, "n1"), (1, "n7"), (2, "hub"), (3, "n299"), (4, "nowhere")]
    df = spark.createDataFrame(edges, "s string, r string, o string, chunk_id string")
    got = graph.neighbours(spark.createDataFrame(starts, "query_id int, name string"), df, 6, hub=hub).collect()
    want = {}
    for q, start in starts:
        for edge, hop in search(edges, start, 6).items():
            want[q, *edge] = min(hop, want.get((q, *edge), 99))
    assert {(r["query_id"], r["s"], r["r"], r["o"]): r["hop"] for r in got} == want


@pytest.mark.parametrize("hub", [graph.HUB, 5])
def test_counts_by_hop_are_those_of_the_edges(spark, hub):
    draw = random.Random(3)
    edges = [(f"N{draw.randint(0, 60)}", draw.choice("rs"), f"n{draw.randint(0, 60)}", "c") for _ in range(45)]
    edges += [("Hub", "to", f"leaf{i}", "c") for i in range(40)] + [("leaf1", "back", "hub", "c"), ("leaf2", "self", "Leaf2", "c"), ("hub", "to", "n1", "c"), ("hub", "to", None, "c")]
    edges += [("left", "to", "right", "c"), ("left", "also", "right", "c"), (None, "to", "n1", "c"), (None, "to", None, "c"), ("n1", "self", "N1", "c"), edges[0]]
    names = [f"n{i}" for i in range(61)] + ["Hub", "leaf0", "Leaf1", "leaf2", "left", "right", "nowhere", "leaf0"]
    starts = spark.createDataFrame(list(enumerate(names)), "query_id int, name string")
    df = spark.createDataFrame(edges, "s string, r string, o string, chunk_id string")
    for hops in (1, 2, 5):
        got = graph.hop_counts(starts, df, hops, hub=hub).collect()
        rows = graph.neighbours(starts, df, hops).groupBy("query_id", "hop").count().collect()
        assert sorted((r[0], r[1], r[2]) for r in got) == sorted((r[0], r[1], r[2]) for r in rows)


def test_many_starts_share_a_traversal(spark, monkeypatch):
    """400 leaves of one hub: one traversal, over one edge."""
    df = spark.createDataFrame([(f"leaf{i}", "of", "hub", "c") for i in range(400)] + [("hub", "in", "top", "c"), ("top", "in", "all", "c")], "s string, r string, o string, chunk_id string")
    asked, whole = [], graph.neighbours
    monkeypatch.setattr(graph, "neighbours", lambda starts, *rest: asked.append((starts.count(), rest[0].count())) or whole(starts, *rest))
    out = graph.hop_counts(spark.range(400).selectExpr("id as query_id", "concat('leaf', id) as name"), df, 4).collect()
    assert asked == [(1, 3)] and len(out) == 1200
