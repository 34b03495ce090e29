"""Bounded retrieval rounds: weak queries are rewritten and searched again.

A round is one batch over the queries that are still weak; rounds are few and
fixed, and each writes nothing but its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let
from . import graph, models, search
from .lineage import cut

# A word and what to add for it, the first that fits.
SYNONYMS = (
    ("supplier", "supply supplying vendor"),
    ("suppliers", "supply supplying vendor"),
    ("uses", "used using component"),
    ("provides", "supply supplies vendor"),
    ("warranty", "guarantee coverage months"),
    ("requires", "requirement needs"),
)


def synonym_rewrite(text: Column, rules=SYNONYMS) -> Column:
    """The first rule whose word stands in the text and none of whose words does."""
    out = None
    for word, more in rules:
        absent = F.lit(True)
        for w in more.split():
            absent = absent & ~F.contains(F.lower(text), F.lit(w))
        fits = text.rlike(rf"(?i)\b{word}\b") & absent
        changed = F.concat(text, F.lit(" " + more))
        out = F.when(fits, changed) if out is None else out.when(fits, changed)
    return out.otherwise(text)


def rewrite(queries: DataFrame, triples: DataFrame, most: int = 4, hops: int = 2, model: models.Loader | None = None) -> DataFrame:
    """query_id, text, method: names met around the query's entities, else a model's
    rewriting if it is new (queries may have `tried`, lower-case texts), else synonyms.

    Names come by hop, then by code point; one already in the text, or within one
    taken before it, is passed over.
    """
    linked = graph.link_entities(queries, triples)
    facts = graph.neighbours(linked, triples, hops)
    sides = facts.select("query_id", "hop", F.explode(F.array(F.trim("s"), F.trim("o"))).alias("name")).where("name != ''")
    named = sides.groupBy("query_id", "name").agg(F.min("hop").alias("hop"))
    listed = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hop", "name"))).alias("names"))
    rows = queries.select("query_id", "text").join(listed, "query_id", "left")

    # What is taken is asked for up to `most` names; whether there is any, by the first.
    enough, nothing = max(most, 1), F.array().cast("array<string>")

    def taken(text: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            low = F.lower(x["name"])
            known = F.contains(text, low) | F.exists(acc, lambda a: F.contains(F.lower(a), low))
            return F.when((F.size(acc) >= enough) | known, acc).otherwise(F.array_append(acc, x["name"]))

        return F.aggregate(F.coalesce("names", F.array().cast("array<struct<hop:int,name:string>>")), nothing, step)

    # The text is lowered once, not for each name.
    extras = let(F.lower("text"), taken)
    rows = rows.withColumn("extras", extras)
    if model is None:
        rows = rows.withColumn("reply", F.lit(None).cast("string"))
    else:
        # The model is asked only where the graph gives nothing.
        own = models.rewritten(rows.where(F.size("extras") == 0).select("query_id", "text"), model)
        if "tried" in queries.columns:
            own = own.join(queries.select("query_id", "tried"), "query_id").where(~F.array_contains("tried", F.lower("reply")))
        rows = rows.join(own.select("query_id", "reply"), "query_id", "left")
    by_graph, by_model = F.size("extras") > 0, F.col("reply").isNotNull()
    expanded = F.concat_ws(" ", "text", F.array_join(F.slice("extras", 1, most), " "))
    text = F.when(by_graph, expanded).when(by_model, F.col("reply")).otherwise(synonym_rewrite(F.col("text")))
    method = F.when(by_graph, "graph-expansion").when(by_model, "llm-rewrite").otherwise("lexical-rules")
    return rows.select("query_id", text.alias("text"), method.alias("method"))


def run_agent(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    triples: DataFrame,
    top_k: int = 20,
    rounds: int = 3,
    top_n: int = 5,
    model: models.Loader | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reranked hits, trace). docs: chunk_id, text; vectors: chunk_id, vector;
    queries: query_id, text.

    trace: query_id, hop, step, detail. A query leaves the rounds when its recall is
    no longer weak or a rewrite brings back a text that was tried.
    """
    current = queries.select("query_id", "text", F.array(F.lower(T.strip(F.col("text")))).alias("tried"))
    vectors = cut(vectors)
    hits = cut(search.search(docs, vectors, current, top_k=top_k))
    trace = [current.select("query_id", F.lit(1).alias("hop"), F.lit("retrieve").alias("step"), F.col("text").alias("detail"))]
    for hop in range(2, rounds + 1):
        weak = search.recall_mass(hits, current).where("weak").select("query_id")
        weak = cut(current.join(weak, "query_id", "left_semi"))
        if weak.isEmpty():
            break
        new = weak.select("query_id", "tried").join(rewrite(weak, triples, model=model), "query_id")
        own = F.lower(T.strip(F.col("text")))
        moving = new.where(~F.array_contains("tried", own)).withColumn("tried", F.array_append("tried", own))
        moving = cut(moving.select("query_id", "text", "tried", "method"))
        trace.append(moving.select("query_id", F.lit(hop).alias("hop"), F.col("method").alias("step"), F.col("text").alias("detail")))
        moving = moving.drop("method")
        again = search.search(docs, vectors, moving, top_k=top_k)
        hits = cut(hits.join(moving.select("query_id"), "query_id", "left_anti").unionByName(again))
        # Queries that stopped moving keep their hits and are not asked again.
        current = moving
    facts = cut(graph.neighbours(cut(graph.link_entities(queries, triples)), triples))
    merged = graph.merge_graph_hits(hits, facts, docs)
    result = search.lexical_rerank(queries, merged, docs, top_n)
    out = trace[0]
    for more in trace[1:]:
        out = out.unionByName(more)
    return result, out


def expand_follow_ups(queries: DataFrame, turns: DataFrame, triples: DataFrame, most: int = 3) -> DataFrame:
    """queries: query_id, session_id, text, and turns: session_id, turn, q. A question
    that leans on its session gets the entities of earlier ones, oldest first."""
    leaning = queries.where(F.col("session_id").isNotNull() & T.needs_history(F.col("text")))
    past = turns.select(F.struct("session_id", "turn").alias("query_id"), F.col("q").alias("text"))
    named = graph.link_entities(past, triples).select("query_id.session_id", "query_id.turn", "name")
    rows = leaning.join(named, "session_id").where(~F.contains(F.lower("text"), F.lower("name")))
    # Longer names first within a turn.
    order = F.struct("turn", (-F.length("name")).alias("l"), "name")
    first = rows.groupBy("query_id", "name").agg(F.min(order).alias("o"))
    extras = first.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("o")), 1, most).alias("e"))
    joined = queries.join(extras, "query_id", "left")
    names = F.transform("e", lambda x: x["name"])
    return joined.select(
        "query_id",
        "session_id",
        F.when(F.col("e").isNotNull(), F.concat_ws(" ", "text", F.array_join(names, " "))).otherwise(F.col("text")).alias("text"),
        F.coalesce(names, F.array().cast("array<string>")).alias("expansion"),
    )
