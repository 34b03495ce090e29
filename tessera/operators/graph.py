"""A small graph of facts: extraction, aliases, linking and traversal.

A triple table has s, r, o, chunk_id. Names are compared in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut
from .names import occurrences, outermost

# What the parts of a relation look like, and companies' ends.
_PRODUCT, _CODE = r"Product\s+[A-Z]", r"(?:Component\s+)?[A-Z]{1,3}-?\d+"
_SUPPLIER = r"[A-Z][A-Za-z.\- ]+(?:GmbH|Inc|LLC|Electrics|Precision)?"
COMPANY_ENDS = ("GmbH", "Inc", "LLC")
SEED_TRIPLES = (
    ("Product X", "uses", "Component XK-7", "seed"),
    ("Component XK-7", "supplied_by", "Nordwerk Precision GmbH", "seed"),
)
VENDOR = "GmbH|Electrics"
RELATION_HINT = r"(?i)\b(uses|use|supplies|supplied by|provides|provides?|vendor|manufactured by|approved for)\b"


Finder = Callable[[str, int], tuple[int, int, str] | None]


def finder(pattern: str) -> Finder:
    """(start, end, first group) of the leftmost match from a place on."""
    compiled = re.compile(pattern, re.IGNORECASE | re.DOTALL)

    def find(text: str, at: int):
        m = compiled.search(text, at)
        return m and (m.start(), m.end(), m.group(1) if compiled.groups else m.group())

    return find


def company_finder(ends: tuple[str, ...] = COMPANY_ENDS) -> Finder:
    """The leftmost longest name (letters, blanks, dots and dashes, from a letter on) with
    one of the ends after two characters at least. A run is looked at once, from its first
    letter: a later one has less before the same end."""
    run = re.compile(r"[A-Za-z.\- ]+")
    last = re.compile(".*(?:" + "|".join(ends) + ")", re.IGNORECASE | re.DOTALL)
    letter = re.compile("[A-Za-z]")

    def find(text: str, at: int):
        for m in run.finditer(text, at):
            first = letter.search(text, m.start(), m.end())
            name = first and last.match(text, min(first.start() + 2, m.end()), m.end())
            if name:
                return first.start(), name.end(), text[first.start() : name.end()]
        return None

    return find


class Chain:
    """A transducer over a sentence: its steps are found one after another, each at the
    first place after the one before; once the last is found, the first and last give a
    pair, and it starts anew behind them. Places only move forward, and a step that isn't
    found ends the sentence, as no later start has more before it: time is linear."""

    def __init__(self, relation: str, words: tuple[str, ...], *steps: Finder):
        """words: lower-case texts that a sentence must have for any match."""
        self.relation, self.words, self.steps = relation, words, steps

    def pairs(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while True:
            found = []
            for step in self.steps:
                hit = step(text, at)
                if hit is None:
                    return
                found.append(hit[2])
                at = hit[1]
            yield found[0], found[-1]


RELATIONS = (
    Chain("uses", ("product", "uses"), finder(rf"({_PRODUCT})\b"), finder(r"uses\b"), finder(rf"({_CODE})")),
    Chain("supplied_by", ("xk-7", "supplied by"), finder(r"((?:Component\s+)?XK-7)\b"), finder(rf"supplied by\s+({_SUPPLIER})")),
    Chain("supplies_rev", ("supplies:",), finder(rf"Supplies:\s*({_CODE})"), company_finder()),
)


def extract_triples(chunks: DataFrame, relations: tuple[Chain, ...] = RELATIONS, seeds=SEED_TRIPLES, least_chars: int = 12) -> DataFrame:
    """Triples of sentences, each with the first chunk (by id) that states it, and
    the seeds that no chunk states. Only sentences with a relation's words leave the JVM."""
    kind = chunks.schema["chunk_id"].dataType
    sentences = chunks.select("chunk_id", F.explode(T.loose_sentences(F.coalesce("text", F.lit("")))).alias("sentence"))
    low = F.lower("sentence")
    worth = reduce(or_, (reduce(and_, (F.contains(low, F.lit(w)) for w in chain.words)) for chain in relations))
    sentences = sentences.where((F.length("sentence") >= least_chars) & worth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, sentence in enumerate(batch.column(1).to_pylist()):
                for chain in relations:
                    for a, b in dict.fromkeys(chain.pairs(sentence)):
                        rows.append(i)
                        found.append((a, chain.relation, b))
            a, r, b = zip(*found, strict=True) if found else ((), (), ())
            texts = [pa.array(list(c), pa.string()) for c in (a, r, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *texts], ["chunk_id", "a", "r", "b"])

    rows = sentences.mapInArrow(run, f"chunk_id {kind.simpleString()}, a string, r string, b string")
    rows = rows.withColumns({"a": T.collapse(F.col("a")), "b": T.collapse(F.col("b"))})
    a, b, r = F.col("a"), F.col("b"), F.col("r")
    vendor = (r == "supplies_rev") & b.rlike(VENDOR)
    triples = rows.select(
        F.when(vendor, b).otherwise(a).alias("s"),
        F.when(vendor, F.lit("supplies")).when(r == "supplies_rev", F.lit("supplied_by")).otherwise(r).alias("r"),
        F.when(vendor, a).otherwise(b).alias("o"),
        "chunk_id",
    )
    known = triples.groupBy("s", "r", "o").agg(F.min("chunk_id").alias("chunk_id"))
    if not seeds:
        return known
    seeded = chunks.sparkSession.createDataFrame(list(seeds), "s string, r string, o string, chunk_id string")
    return known.unionByName(seeded.join(known.select("s", "r", "o"), ["s", "r", "o"], "left_anti"))


def model_candidates(chunks: DataFrame, distractor: str = "scale_20news") -> DataFrame:
    """Chunks worth a model's reading: those that hint at a relation."""
    return chunks.where(F.col("text").rlike(RELATION_HINT) & ~F.startswith("doc_id", F.lit(distractor)))


def parse_model_triples(replies: DataFrame) -> DataFrame:
    """replies: chunk_id, reply. Triples of the JSON list in a model's reply, if it
    holds one."""
    listed = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    parsed = F.from_json(listed, "array<struct<s:string,r:string,o:string>>", {"mode": "PERMISSIVE"})
    rows = replies.select("chunk_id", F.explode(parsed).alias("t"))
    return rows.where("t.s is not null and t.r is not null and t.o is not null").select("t.s", "t.r", "t.o", "chunk_id")


def node_names(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("s").alias("name")).union(triples.select(F.col("o").alias("name"))).distinct()


def merge_aliases(triples: DataFrame) -> DataFrame:
    """Every name in its canonical form, or the longest other canonical name that
    contains it (of equally long ones the first by code point); directions put
    right; of equal triples the first chunk by id."""
    names = node_names(triples).select("name", T.canonical_name(F.col("name")).alias("canonical"))
    forms = cut(names.select("canonical", F.lower("canonical").alias("low")).distinct())
    # Every form is a text that an automaton of all forms reads.
    held = occurrences(forms.select("canonical", F.col("low").alias("text")), forms.select(F.col("low").alias("name")), ["canonical"])
    held = held.select(F.col("canonical").alias("long"), F.col("name").alias("low"))
    longest = F.min(F.struct((-F.length("long")).alias("l"), "long"))
    inside = forms.join(held, "low").where(F.length("long") > F.length("canonical")).groupBy("canonical").agg(longest.alias("x"))
    resolved = forms.select("canonical").join(inside, "canonical", "left")
    map_ = names.join(resolved, "canonical").select("name", F.coalesce("x.long", "canonical").alias("resolved"))
    left = map_.select(F.col("name").alias("s"), F.col("resolved").alias("rs"))
    right = map_.select(F.col("name").alias("o"), F.col("resolved").alias("ro"))
    turned = triples.join(left, "s").join(right, "o").select(T.oriented(F.col("rs"), F.col("r"), F.col("ro")).alias("t"), "chunk_id")
    return turned.groupBy("t.s", "t.r", "t.o").agg(F.min("chunk_id").alias("chunk_id"))


def link_entities(queries: DataFrame, triples: DataFrame, least_chars: int = 3) -> DataFrame:
    """query_id, name of every node that the query's text names, without those named
    within a longer one that it names too."""
    nodes = node_names(triples).where(F.length("name") >= least_chars).withColumn("low", F.lower("name"))
    nodes = nodes.groupBy("low").agg(F.min("name").alias("name"))
    nodes = cut(nodes)
    asked = queries.select("query_id", F.lower("text").alias("text"))
    found = outermost(occurrences(asked, nodes.select(F.col("low").alias("name")), ["query_id"]), ["query_id"])
    return found.withColumnRenamed("name", "low").join(nodes, "low").select("query_id", "name")


#: Edges of a node that one task joins with its queries; a node with more is split.
HUB = 100_000


def adjacency(triples: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Every edge at both of its nodes (node, piece, s, r, o, chunk_id, other), and the hubs
    (node, pieces): nodes of more than `hub` edges, whose edges are dealt to pieces."""
    edges = triples.select("s", "r", "o", "chunk_id")
    ends = F.explode(F.array(F.struct(F.lower("s").alias("node"), F.lower("o").alias("other")), F.struct(F.lower("o").alias("node"), F.lower("s").alias("other"))))
    both = edges.select("s", "r", "o", "chunk_id", ends.alias("e")).select("e.node", "e.other", "s", "r", "o", "chunk_id").where("node is not null")
    degree = both.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > hub)
    hubs = cut(degree.select("node", F.ceil(F.col("n") / hub).cast("int").alias("pieces")))
    # Twice the edges by `hub` is the most hubs there can be.
    held = both.join(F.broadcast(hubs), "node", "left") if not hubs.isEmpty() else both.withColumn("pieces", F.lit(None).cast("int"))
    piece = F.pmod(F.xxhash64("s", "r", "o", "chunk_id"), F.coalesce("pieces", F.lit(1))).cast("int")
    return held.select("node", piece.alias("piece"), "other", "s", "r", "o", "chunk_id"), hubs


def neighbours(starts: DataFrame, triples: DataFrame, hops: int = 2, key: str = "query_id", hub: int = HUB) -> DataFrame:
    """key, s, r, o, chunk_id, hop: edges within so many hops of the key's names.

    starts: key, name. Each hop is an equi-join of the frontier, the names that the hop
    before met first, with their edges; what a hop has met is kept, so that later ones
    don't compute it again. Edges of a hub are dealt to pieces, to each of which the
    frontier's rows of the hub are sent. An edge keeps the hop at which it was first met.
    """
    edges, hubs = adjacency(triples, hub)
    split = not hubs.isEmpty()
    edges = cut(edges) if hops > 1 else edges
    frontier = cut(starts.select(key, F.lower("name").alias("node")).distinct())
    seen, out = frontier, None
    for hop in range(1, hops + 1):
        asked = frontier.join(F.broadcast(hubs), "node", "left") if split else frontier.withColumn("pieces", F.lit(1))
        asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
        met = asked.join(edges, ["node", "piece"]).select(key, "s", "r", "o", "chunk_id", "other", F.lit(hop).alias("hop"))
        if hop < hops:
            met = cut(met)
            new = met.select(key, F.col("other").alias("node")).where("node is not null").distinct()
            frontier = cut(new.join(seen, [key, "node"], "left_anti"))
            seen = seen.union(frontier)
        out = met if out is None else out.unionByName(met)
        if hop < hops and frontier.isEmpty():
            break
    return out.groupBy(key, "s", "r", "o").agg(F.min("chunk_id").alias("chunk_id"), F.min("hop").alias("hop"))


def _folded(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with numbers in place of names of relations, and the pendants (node, root,
    own). A pendant has one neighbour, its root, which has others; their `own` edges, and all
    of a node's edges to itself or to null, are one edge of the node to null. What else links
    two nodes is one edge. The number of edges that an edge stands for is its chunk_id."""
    s, o = F.lower("s"), F.lower("o")
    ends = triples.select("s", "r", "o").distinct().select(F.least(s, o).alias("a"), F.greatest(s, o).alias("b")).where("a is not null")
    links = cut(ends.groupBy("a", "b").agg(F.count("*").alias("n")))
    both = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("node")
    # Of a node with one link, that link's other end is its only neighbour.
    degree = links.select("a", "b", "n", both).groupBy("node").agg(
        F.count("*").alias("links"), F.max(F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("root"), F.max("n").alias("own")
    )
    single = degree.where("links = 1 and root != node").select("node", "root", "own")
    # Two nodes that have only each other are no pendants.
    pendants = cut(single.join(single.select(F.col("node").alias("root")), "root", "left_anti"))
    hung = pendants.groupBy(F.col("root").alias("node")).agg(F.sum("own").alias("n"))
    own = links.where("a = b").select(F.col("a").alias("node"), "n").unionByName(hung).groupBy("node").agg(F.sum("n").alias("n"))
    between = links.where("a != b")
    for end in ("a", "b"):
        between = between.join(pendants.select(F.col("node").alias(end)), end, "left_anti")
    nothing = F.lit(None).cast("string")
    folded = between.select(F.col("a").alias("s"), F.lit("").alias("r"), F.col("b").alias("o"), F.col("n").alias("chunk_id"))
    return folded.unionByName(own.select(F.col("node").alias("s"), F.lit("").alias("r"), nothing.alias("o"), F.col("n").alias("chunk_id"))), pendants


def hop_counts(starts: DataFrame, triples: DataFrame, hops: int = 2, key: str = "query_id", hub: int = HUB) -> DataFrame:
    """key, hop, edges: how many of the edges that neighbours() gives each key were met at
    each hop. starts: key, name, one name a key.

    A name's traversal doesn't depend on who asks, and that of a node with one neighbour is
    the neighbour's, a hop later and without the edge between. So what is traversed are the
    distinct roots of the starts, over edges in which those to nodes with one neighbour are
    folded into a number at their root. Its work is that of the nodes with more neighbours.
    """
    folded, pendants = _folded(triples)
    asked = starts.select(key, F.lower("name").alias("node"))
    asked = cut(asked.join(pendants, "node", "left").withColumn("root", F.coalesce("root", "node")))
    roots = asked.select("root", F.col("root").alias("name")).distinct()
    met = neighbours(roots, folded, hops, "root", hub)
    counts = met.groupBy("root", "hop").agg(F.sum("chunk_id").alias("edges"))
    later = F.when(F.col("own").isNull(), 0).otherwise(1)
    edges = F.when((F.col("own") > 0) & (F.col("hop") == 1), F.col("edges") - F.col("own")).otherwise(F.col("edges"))
    rows = asked.join(counts, "root").select(key, (F.col("hop") + later).alias("hop"), edges.alias("edges"))
    first = asked.where("own is not null").select(key, F.lit(1).alias("hop"), F.col("own").alias("edges"))
    return rows.where((F.col("hop") <= hops) & (F.col("edges") > 0)).unionByName(first)


def merge_graph_hits(candidates: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates (query_id, chunk_id, rrf, rank) and after them the chunks that state
    the facts (query_id, chunk_id, hop), tagged via_graph."""
    wanted = facts.where("chunk_id != 'seed'").groupBy("query_id", "chunk_id").agg(F.min("hop").alias("hop"))
    wanted = wanted.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    new = wanted.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    last = candidates.groupBy("query_id").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("query_id").orderBy("hop", "chunk_id")
    added = new.join(last, "query_id", "left").select(
        "query_id",
        "chunk_id",
        F.lit(0.01).alias("rrf"),
        (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).alias("rank"),
        F.lit(True).alias("via_graph"),
    )
    own = candidates.select("query_id", "chunk_id", "rrf", "rank", F.lit(False).alias("via_graph"))
    return own.unionByName(added)
