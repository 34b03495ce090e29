"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations; nothing but a count of changes reaches the
driver. A vertex with very many neighbours is no single task's work: its edges
are joined with its minimum, never gathered. Up to `ONE_TASK_EDGES` edges, which
are counted first, a round is one task without any exchange; the number of edges
never grows from round to round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

ONE_TASK_EDGES = 200_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v) with u > v; every vertex's larger (or its smaller) neighbours
    are tied to the least vertex among itself and its neighbours."""
    if small:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    else:
        ways = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
        both = edges.select(F.explode(ways).alias("e")).select("e.a", "e.b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if small:
        ways = F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("m").alias("v")))
        tied = joined.select(F.explode(ways).alias("e")).select("e.u", "e.v")
    else:
        tied = joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return tied.where("u != v").distinct()


def connected(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 50, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(vertex, component) of every vertex with an edge to another; component is
    the least vertex. Self-loops and nulls add nothing."""
    now = cut(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where("u is not null and v is not null and u != v")
        .distinct()
    )
    few = now.count() <= one_task_edges
    spread = None
    for _ in range(most_rounds):
        now = now.coalesce(1) if few else now
        now = cut(_star(_star(now, small=False), small=True))
        # A forest of stars: no vertex is both a leaf and a centre, and no leaf has two centres.
        mark = F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1))
        count, total, leaves = now.agg(F.count("*"), F.sum(mark), F.countDistinct("u")).first()
        if (count, total) == spread and count == leaves:
            break
        spread = (count, total)
    else:
        raise RuntimeError("components have not settled")
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
