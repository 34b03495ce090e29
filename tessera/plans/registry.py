"""The queries of the retrieval engine over the test tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agent, answer, chunk, clean, evaluate, graph, index, models, postings, search, vectors
from ..operators.lineage import cut, new_folder, written
from ..sources import files, raw
from ..streaming import ops, state
from . import literals as L
from . import pipelines
from .oracle import SQL
from .oracle_rest import SQL as REST

Q = {}


def query(f):
    Q[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: chunk_id, doc_id, text."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


# -- retrieval -------------------------------------------------------------------


@query
def bm25_topk(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return search.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), 10)


@query
def bm25_with_zeros(spark, sf_dir):
    return search.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), 50, include_zero=True)


@query
def bm25_okapi(spark, sf_dir):
    return search.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), 10, variant="okapi")


@query
def term_stats(spark, sf_dir):
    return index.term_stats(_chunks(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(index.token_table(_chunks(spark, sf_dir))).withColumn("avgdl", F.round("avgdl", 6))


@query
def dense_topk(spark, sf_dir):
    """Every hundredth vector against all."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return search.dense_topk(e, e.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 10)


def _vector_index(spark, sf_dir, exact):
    folder = new_folder(spark, "vectors")
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    model = vectors.build(e, folder, cells=32)
    asked = e.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return vectors.search(spark, folder, model, asked, 10, probes=24, exact=exact)


@query
def vector_index_exact(spark, sf_dir):
    """The same by cells and codes, skipping what their bounds rule out."""
    return _vector_index(spark, sf_dir, True)


@query
def vector_index_probes(spark, sf_dir):
    """The same from three quarters of the cells: the test vectors hardly form clusters."""
    return _vector_index(spark, sf_dir, False)


@query
def hash_embed(spark, sf_dir):
    return index.bucket_weights(_chunks(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query
def hashed_topk(spark, sf_dir):
    return search.hashed_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), 10)


def _hybrid(spark, sf_dir, k=20):
    chunks = _chunks(spark, sf_dir)
    return search.search(chunks, index.dense_embedding(chunks), _questions(spark, sf_dir), top_k=k)


@query
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query
def branch_report(spark, sf_dir):
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    dense = search.hashed_topk(chunks, questions, 20)
    out = search.branch_report(dense, search.bm25_topk(chunks, questions, 20))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("dense_top", "sparse_top")})


@query
def recall_mass(spark, sf_dir):
    out = search.recall_mass(_hybrid(spark, sf_dir), _questions(spark, sf_dir))
    return out.withColumn("mass", F.round("mass", 5))


@query
def lexical_rerank(spark, sf_dir):
    return search.lexical_rerank(_questions(spark, sf_dir), _hybrid(spark, sf_dir), _chunks(spark, sf_dir))


@query
def rerank_delta(spark, sf_dir):
    hits = _hybrid(spark, sf_dir)
    return search.rerank_delta(search.lexical_rerank(_questions(spark, sf_dir), hits, _chunks(spark, sf_dir)), hits)


@query
def rrf_fuse(spark, sf_dir):
    """Hand-written branches, and for every order its parts by price and by quantity."""
    schema = "query_id long, chunk_id string, score double, rank int"
    lines = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 10).alias("query_id"), F.col("l_partkey").cast("string").alias("chunk_id"))
    price = search.ranked(lines.agg(F.round(F.max("l_extendedprice"), 2).alias("score")), 4)
    quantity = search.ranked(lines.agg(F.round(F.sum("l_quantity").cast("double"), 2).alias("score")).where("score > 20"), 4)
    return search.fuse(L.frame(spark, L.DENSE, schema).unionByName(price), L.frame(spark, L.SPARSE, schema).unionByName(quantity))


# -- chunking --------------------------------------------------------------------


@query
def sentence_split(spark, sf_dir):
    rows = _strings(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("seq", "sentence"))
    return rows.withColumn("tokens", T.estimated_tokens(F.col("sentence")))


@query
def sliding_window(spark, sf_dir):
    return chunk.sliding_window(_strings(spark, sf_dir), 220, 30).select("chunk_id", "doc_id", "text", "token_est", "seq")


@query
def parent_child(spark, sf_dir):
    return chunk.parent_child(_strings(spark, sf_dir)).select("chunk_id", "doc_id", "text", "parent_id", "token_est", "seq", "role")


@query
def semantic_chunks(spark, sf_dir):
    docs = _strings(spark, sf_dir).unionByName(L.frame(spark, L.STRUCTURED, "doc_id string, text string"))
    return chunk.semantic(docs, 40).select("chunk_id", "text", "token_est", "table_flag", "seq")


@query
def chunk_overlap(spark, sf_dir):
    chunks = chunk.sliding_window(_strings(spark, sf_dir), 220, 30)
    return chunk.consecutive_overlap(chunks).select("chunk_id", F.round("overlap", 6).alias("overlap"))


@query
def ingest_stats(spark, sf_dir):
    docs = clean.clean_documents(_strings(spark, sf_dir))
    return index.ingest_stats(docs, chunk.sliding_window(docs, 220, 30))


@query
def table_annotate(spark, sf_dir):
    docs = _strings(spark, sf_dir).unionByName(L.frame(spark, L.STRUCTURED, "doc_id string, text string")).withColumnRenamed("doc_id", "chunk_id")
    return clean.annotate(docs).select("chunk_id", "has_table", F.col("table_rows").cast("int").alias("table_rows"), "has_figure_ref")


@query
def clean_text(spark, sf_dir):
    docs = _strings(spark, sf_dir).unionByName(L.frame(spark, L.DIRTY, "doc_id string, text string"))
    return clean.clean_documents(docs).select("doc_id", "text", "report.*")


@query
def leak_watch(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    return clean.leak_report(chunks, L.PHRASES)


@query
def parent_expand(spark, sf_dir):
    """Children of every document, three in turn to a query, and the hand-written cases."""
    chunks = L.frame(spark, L.FAMILY, "chunk_id string, doc_id string, text string, parent_id string")
    own = chunk.parent_child(_strings(spark, sf_dir)).select("chunk_id", "doc_id", "text", "parent_id", "seq", "role")
    hits = L.frame(spark, L.HITS, "query_id long, chunk_id string, rank int")
    more = own.where("role = 'child'").select((F.col("doc_id").cast("long") + 1000).alias("query_id"), "chunk_id", (F.col("seq") + 1).alias("rank"))
    return search.expand_parents(hits.unionByName(more), chunks.unionByName(own.drop("seq", "role")), 3)


@query
def searchable_chunks(spark, sf_dir):
    rows = chunk.parent_child(_strings(spark, sf_dir))
    return index.searchable(rows).groupBy("doc_id").agg(F.count("*").alias("children"))


# -- guards and scalar functions ---------------------------------------------------


@query
def pii_redact(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("r"))
    return rows.select("doc_id", F.col("r.text").alias("text"), F.array_join("r.findings", ",").alias("findings"))


@query
def injection_flag(spark, sf_dir):
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    more = L.frame(spark, L.INJECTIONS, "conv_id long, turn long, text string")
    return own.unionByName(more).select("conv_id", "turn", T.injection_flag(F.col("text")).alias("flagged"))


@query
def scalar_functions(spark, sf_dir):
    """The hand-written names, and the pages' addresses."""
    rows = L.frame(spark, L.NAMES, "id long, name string, forwarded string, socket string")
    pages = _table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1000).alias("id"), F.col("url").alias("name"), F.concat_ws(",", F.lit("10.0.0.1"), "url").alias("forwarded"), F.lit("9.9.9.9").alias("socket")
    )
    rows, name = rows.unionByName(pages), F.col("name")
    return rows.select(
        "id",
        T.canonical_name(name).alias("canonical"),
        T.safe_doc_id(name).alias("safe_id"),
        T.escape_tags(name).alias("escaped"),
        T.doc_of(name).alias("doc"),
        T.content_hash(name).alias("hash"),
        T.client_address(F.col("forwarded"), F.col("socket"), 2).alias("client"),
        F.array_join(T.word_pieces(name, 2), "/").alias("pieces"),
        T.answer_key(name, F.lit(5), F.lit("true"), F.lit("false"), F.lit("v1")).alias("key"),
        T.abstains(name).alias("abstains"),
    )


@query
def coref_gate(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", T.needs_history(F.col("text")).alias("needs_history"))


@query
def point_ids(spark, sf_dir):
    return _strings(spark, sf_dir).select("doc_id", index.point_id(F.col("doc_id")).alias("point_id"))


# -- incremental index -------------------------------------------------------------


def _versions(spark, sf_dir):
    """A later state of the documents: a tenth edited, a tenth gone, a tenth new."""
    old = _strings(spark, sf_dir)
    n = F.col("doc_id").try_cast("long") % 10
    new = old.where(n != 0).withColumn("text", F.when(n == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    added = old.where(n == 2).withColumn("doc_id", F.concat(F.lit("new"), "doc_id"))
    return old, new.unionByName(added)


@query
def incremental_diff(spark, sf_dir):
    old, new = (
        x.select("doc_id", T.content_hash(F.col("text")).alias("hash"), F.lit("sliding").alias("strategy")) for x in _versions(spark, sf_dir)
    )
    new = new.withColumn("strategy", F.when(F.col("doc_id").endswith("3"), "semantic").otherwise(F.col("strategy")))
    return index.incremental_diff(new, old)


@query
def vector_reuse(spark, sf_dir):
    old, new = (x.withColumnRenamed("doc_id", "chunk_id") for x in _versions(spark, sf_dir))
    stored = old.withColumn("vector", F.array(F.length("text").cast("double")))
    embed = lambda rows: rows.select("chunk_id", F.array(-F.length("text").cast("double")).alias("vector"))
    out = index.reuse_vectors(new, stored, embed)
    return out.select("chunk_id", "reused", F.get("vector", F.lit(0)).alias("first"))


@query
def stale_purge(spark, sf_dir):
    old, new = (x.withColumnRenamed("doc_id", "chunk_id") for x in _versions(spark, sf_dir))
    kept = index.purge_stale(old, new).select("chunk_id", F.lit("kept").alias("state"))
    return kept.unionByName(index.stale_ids(old, new).withColumn("state", F.lit("stale")))


@query
def priority_limit(spark, sf_dir):
    rows = _strings(spark, sf_dir).select(
        F.concat(F.when(F.col("doc_id").cast("long") % 3 == 0, "scale_").otherwise(""), "doc_id").alias("doc_id")
    )
    return index.limit_by_priority(rows.withColumn("chunk_id", F.concat("doc_id", F.lit("#s0"))), 100)


@query
def upsert_prune(spark, sf_dir):
    old, new = (x.withColumnRenamed("doc_id", "chunk_id") for x in _versions(spark, sf_dir))
    stored = files.upsert_points(old, None)
    return files.prune_points(files.upsert_points(new, stored), new).select("chunk_id", "point_id", F.length("text").alias("n"))


@query
def upsert_buckets(spark, sf_dir):
    """The same in a stored table of which only touched buckets are rewritten."""
    folder = new_folder(spark, "points")
    old, new = (x.withColumnRenamed("doc_id", "chunk_id") for x in _versions(spark, sf_dir))
    files.write_points(old, folder, 32)
    hashed = [x.select(F.col("chunk_id").alias("doc_id"), T.content_hash(F.col("text")).alias("hash"), F.lit("plain").alias("strategy")) for x in (new, old)]
    status = written(index.incremental_diff(*hashed).where("status != 'same'")).withColumnRenamed("doc_id", "chunk_id")
    files.upsert_in_place(new.join(status.where("status in ('added', 'changed')"), "chunk_id", "left_semi"), folder, 32)
    files.prune_in_place(status.where("status = 'removed'"), folder, 32)
    return files.read_points(spark, folder).select("chunk_id", "point_id", F.length("text").alias("n"))


@query
def category_limit(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("category", F.col("source"))
    return files.limited_categories(docs, 20, 200).select("doc_id", "category", "number")


# -- graph -------------------------------------------------------------------------


def _facts(spark, sf_dir):
    """The hand-written facts, the benchmark items' first words, suppliers' nations and
    parts' brands."""
    t = lambda name, *c: _table(spark, sf_dir, name).select(*c)
    word = lambda i: F.get(F.split("text", " "), F.lit(i))
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    own = L.frame(spark, L.TRIPLES, "s string, r string, o string, chunk_id string")
    items = t("benchmark", word(0), F.lit("opens"), F.concat_ws(" ", word(1), word(2)), key("b", "item_id"))
    suppliers = t("supplier", "s_name", F.lit("located in"), key("NATION_", "s_nationkey"), key("s", "s_suppkey"))
    return own.union(items).union(suppliers).union(t("part", "p_name", F.lit("of"), "p_brand", key("p", "p_partkey")))


def _asked(spark, sf_dir):
    """The hand-written questions, and every document as one."""
    own = L.frame(spark, L.QUESTIONS, "query_id long, text string")
    return own.union(_table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, "text"))


@query
def triples(spark, sf_dir):
    own = _strings(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    return graph.extract_triples(L.frame(spark, L.FACT_TEXTS, "chunk_id string, doc_id string, text string").unionByName(own))


@query
def alias_merge(spark, sf_dir):
    return graph.merge_aliases(_facts(spark, sf_dir))


@query
def entity_link(spark, sf_dir):
    return graph.link_entities(_asked(spark, sf_dir), _facts(spark, sf_dir))


@query
def khop_facts(spark, sf_dir):
    facts = cut(_facts(spark, sf_dir))
    return graph.neighbours(graph.link_entities(_asked(spark, sf_dir), facts), facts, 2)


@query
def khop_tables(spark, sf_dir):
    """Three hops from every region over region, nation, customer and order keys."""
    t = lambda name: _table(spark, sf_dir, name)
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = (
        t("nation").select(name("n", "n_nationkey").alias("s"), F.lit("in").alias("r"), name("r", "n_regionkey").alias("o"))
        .union(t("customer").select(name("c", "c_custkey"), F.lit("of"), name("n", "c_nationkey")))
        .union(t("orders").select(name("o", "o_orderkey"), F.lit("by"), name("c", "o_custkey")))
        .withColumn("chunk_id", F.col("s"))
    )
    starts = t("region").select(F.col("r_regionkey").alias("query_id"), name("r", "r_regionkey").alias("name"))
    return graph.neighbours(starts, edges, 3).select("query_id", "s", "r", "o", "hop")


@query
def graph_merge(spark, sf_dir):
    """Chunks that state the facts around a question, after its other candidates: for a
    document, itself and one of the benchmark's items."""
    facts = cut(_facts(spark, sf_dir))
    linked = graph.link_entities(_asked(spark, sf_dir), facts)
    own, item = F.col("doc_id") + 1000, F.concat(F.lit("b"), (F.col("doc_id") % 40).cast("string"))
    docs = _table(spark, sf_dir, "documents")
    candidates = L.frame(spark, L.CANDIDATES, "query_id long, chunk_id string, rrf double, rank int")
    candidates = candidates.union(docs.select(own, F.col("doc_id").cast("string"), F.lit(0.03), F.lit(1))).union(docs.select(own, item, F.lit(0.02), F.lit(2)))
    chunks = L.frame(spark, L.FACT_TEXTS, "chunk_id string, doc_id string, text string").select("chunk_id", "text")
    chunks = chunks.union(_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")), "text"))
    return graph.merge_graph_hits(candidates, graph.neighbours(linked, facts, 2), chunks)


@query
def ingest_tables(spark, sf_dir):
    """Sizes of an index's tables by strategy: cleaned, chunked, embedded."""
    parts = []
    for strategy in ("sliding", "parent_child", "another name"):
        tables = pipelines.ingest(_strings(spark, sf_dir), strategy, 220, 30, facts=False)
        chunks = cut(tables["chunks"])
        row = chunks.agg(F.count("*").alias("chunks"), F.sum("token_est").alias("tokens"), F.sum(F.length("text")).alias("chars"))
        parts.append(row.select(F.lit(strategy).alias("strategy"), "chunks", "tokens", "chars"))
    return parts[0].union(parts[1]).union(parts[2])


@query
def model_triples(spark, sf_dir):
    """Hand-written replies, and one about every document's source and language."""
    listed = F.to_json(F.array(F.struct(F.col("source").alias("s"), F.lit("holds").alias("r"), F.col("lang").alias("o"))))
    own = _strings(spark, sf_dir).select("doc_id").join(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang"), "doc_id")
    more = own.select("doc_id", F.concat(F.lit("Reply: "), listed, F.lit(" end")))
    return graph.parse_model_triples(L.frame(spark, L.REPLIES, "chunk_id string, reply string").union(more))


@query
def query_rewrite(spark, sf_dir):
    return agent.rewrite(_asked(spark, sf_dir), cut(_facts(spark, sf_dir)))


@query
def agent_search(spark, sf_dir):
    """Weak queries: rewritten, searched again, joined by the graph."""
    docs = L.frame(spark, L.FACT_TEXTS, "chunk_id string, doc_id string, text string").unionByName(_strings(spark, sf_dir).withColumn("chunk_id", F.col("doc_id")))
    questions = L.frame(spark, L.QUESTIONS, "query_id long, text string").union(_questions(spark, sf_dir).select(F.col("query_id") + 1000, "text"))
    return agent.run_agent(docs, index.dense_embedding(docs), questions, cut(_facts(spark, sf_dir)))[0]


@query
def follow_ups(spark, sf_dir):
    """The hand-written sessions, and users' last turns after the ones before."""
    users = _table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("session_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    last = users.groupBy("session_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"), F.max("conv_id").alias("conv_id"))
    questions = L.frame(spark, L.FOLLOW_UPS, "query_id long, session_id string, text string").union(last.select(F.col("conv_id") + 1000, "session_id", F.concat(F.left("text", F.lit(40)), F.lit(" it"))))
    before = users.join(last.select("session_id", F.col("turn").alias("last")), "session_id").where("turn < last")
    turns = L.frame(spark, L.TURNS, "session_id string, turn long, q string").union(before.select("session_id", "turn", "text"))
    return agent.expand_follow_ups(questions, turns, cut(_facts(spark, sf_dir))).select(
        "query_id", "text", F.array_join("expansion", ",").alias("expansion")
    )


# -- answers and measures ------------------------------------------------------------


def _contexts(spark, sf_dir):
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hits = search.lexical_rerank(questions, search.bm25_topk(chunks, questions, 10), chunks)
    return questions, hits.join(chunks, "chunk_id")


@query
def extractive_answer(spark, sf_dir):
    return answer.extractive_answers(*_contexts(spark, sf_dir))


@query
def prompt_context(spark, sf_dir):
    questions, contexts = _contexts(spark, sf_dir)
    return answer.build_prompts(questions, contexts.select("query_id", "doc_id", "text", "rank"))


@query
def faithfulness(spark, sf_dir):
    """Of hand-written answers, and of the extractive answers to the benchmark's items."""
    questions, found = _contexts(spark, sf_dir)
    found = cut(found)
    own = (F.col("query_id") + 1000).alias("query_id")
    answers = L.frame(spark, L.ANSWERS, "query_id long, answer string").unionByName(answer.extractive_answers(questions, found).select(own, "answer"))
    contexts = L.frame(spark, L.CONTEXTS, "query_id long, doc_id string, text string")
    contexts = contexts.unionByName(found.select(own, F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return evaluate.faithfulness(answers, contexts).withColumn("faithfulness", F.round("faithfulness", 6))


@query
def answer_relevance(spark, sf_dir):
    """Hand-written answers, and documents as answers to their source's, language's and a
    fixed keyword."""
    rows = L.frame(spark, L.KEYWORDS, "query_id long, answer string, keywords array<string>")
    docs = _table(spark, sf_dir, "documents").where("text is not null and source is not null and lang is not null")
    rows = rows.union(docs.select(F.col("doc_id") + 1000, "text", F.array("source", F.left("lang", F.lit(1)), F.lit("Est"))))
    return evaluate.answer_relevance(rows).withColumn("relevance", F.round("relevance", 6))


def _run(spark, sf_dir, k=10):
    hits = search.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), k)
    name = F.concat(F.lit("doc"), F.lpad(F.col("chunk_id").cast("string"), 9, "0"))
    return hits.select("query_id", F.concat(name, F.lit("#s0")).alias("chunk_id"), name.alias("doc_id"), "rank")


def _gold(spark, sf_dir):
    """Documents that hold an item's whole text."""
    pairs = evaluate.containing(_table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir))
    return pairs.select("query_id", F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("doc_id"))


_MEASURES = ["precision", "recall", "mrr", "ndcg"]


@query
def ir_metrics(spark, sf_dir):
    out = evaluate.retrieval_metrics(_run(spark, sf_dir), cut(_gold(spark, sf_dir)))
    return out.select("query_id", *(F.round(c, 4).alias(c) for c in _MEASURES))


@query
def metric_gate(spark, sf_dir):
    metrics = evaluate.retrieval_metrics(_run(spark, sf_dir), cut(_gold(spark, sf_dir)))
    return evaluate.gate(evaluate.summary(metrics, _MEASURES), {"recall": 0.6, "ndcg": 0.6})


@query
def ndcg_graded(spark, sf_dir):
    """Gold documents whose id ends in an odd digit have grade 1, all others none."""
    gold = cut(_gold(spark, sf_dir)).withColumn("grade", (F.length("doc_id") % 2 + F.substring("doc_id", -1, 1).cast("int") % 2).cast("int"))
    out = evaluate.graded_metrics(_run(spark, sf_dir), gold)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")))


@query
def drift_gate(spark, sf_dir):
    """Measures of the returned lines against those of all."""
    rows = _table(spark, sf_dir, "lineitem")
    of = lambda df: df.agg(F.round(F.avg("l_discount") * 10, 3).alias("faithfulness"), F.round(F.avg("l_tax") * 10, 3).alias("recall"), F.round(F.avg("l_quantity") / 100, 3).alias("ndcg"))
    return evaluate.drift(of(rows.where("l_returnflag = 'R'")), of(rows), ["faithfulness", "recall", "ndcg"])


@query
def ablation(spark, sf_dir):
    """Four configurations; both branches are searched once."""
    gold, chunks, questions = cut(_gold(spark, sf_dir)), _chunks(spark, sf_dir), _questions(spark, sf_dir)
    name = F.concat(F.lit("doc"), F.lpad(F.col("chunk_id").cast("string"), 9, "0"))
    rows = {}
    hits_of = {"dense": cut(search.hashed_topk(chunks, questions, 10)), "bm25": cut(search.bm25_topk(chunks, questions, 10))}
    hits_of["hybrid"] = cut(search.fuse(hits_of["dense"], hits_of["bm25"], top_n=10))
    hits_of["hybrid+rerank"] = cut(search.lexical_rerank(questions, hits_of["hybrid"], chunks))
    for mode, hits in hits_of.items():
        run = hits.select("query_id", F.concat(name, F.lit("#s0")).alias("chunk_id"), name.alias("doc_id"), "rank")
        rows[mode] = evaluate.summary(evaluate.retrieval_metrics(run, gold), _MEASURES)
    return evaluate.ablation(rows)


@query
def qrels(spark, sf_dir):
    """Hand-written lines, and every label as a line, quality and toxicity in turn."""
    labels = _table(spark, sf_dir, "labels")
    line = lambda c, sep: F.concat_ws(sep, F.concat(F.lit("q"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("d"), (F.col("doc_id") % 500).cast("string")), F.col(c).cast("string"))
    more = labels.select(F.col("doc_id") * 2 + 100, line("quality", "\t")).union(labels.select(F.col("doc_id") * 2 + 101, line("toxic", "  ")))
    return files.parse_qrels(L.frame(spark, L.QREL_LINES, "n long, value string").union(more))


# -- sessions, logs, admission ---------------------------------------------------------


@query
def last_turns(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("session_id", F.col("conv_id"))
    return ops.last_per_key(rows, "session_id", "turn", 6).select("session_id", "turn", "role", "recency")


@query
def history_block(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    users = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    turns = users.join(answers, ["conv_id", "turn"]).select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.col("turn").alias("ts"), "q", "a")
    return ops.history_block(ops.session_memory(turns, sessions_kept=None))


@query
def rate_window(spark, sf_dir):
    return ops.trailing_counts(_table(spark, sf_dir, "events"), seconds=3600).select("event_id", "user_id", "in_window")


@query
def rate_limit_state(spark, sf_dir):
    return ops.rate_limit_batch(_table(spark, sf_dir, "events"), limit=2, seconds=86400.0)


def _streamed(spark, rows, transform):
    """rows as a stream of files, through transform."""
    folder = new_folder(spark, "stream")
    rows.write.parquet(f"{folder}/in")
    return state.drain(spark, f"{folder}/in", rows.schema, transform, f"{folder}/out", f"{folder}/checkpoint")


@query
def rate_limit_stream(spark, sf_dir):
    """Admission of the log as a stream with capped state."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, rows, lambda s: state.admissions(s, limit=2, seconds=86400.0))


@query
def session_stream(spark, sf_dir):
    """What is remembered of each conversation after every exchange."""
    rows = _table(spark, sf_dir, "conversations")
    users = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    turns = users.join(answers, ["conv_id", "turn"]).select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.timestamp_seconds("turn").alias("ts"), "q", "a")
    return _streamed(spark, turns, lambda s: state.sessions(s, 2, most=1_000_000))


@query
def answer_cache_stream(spark, sf_dir):
    """Of the log, every third event asks, the one after it stores; answers live a day."""
    e = _table(spark, sf_dir, "events").where("event_id % 3 < 2")
    key = F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))
    answer = F.when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string"))
    rows = e.select(F.col("event_id").alias("query_id"), key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), answer.alias("answer"))
    return _streamed(spark, rows, lambda s: state.answers(s, 86400.0))


@query
def latency_pcts(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "ts", "event_id", F.col("value").alias("ms"))
    return ops.latency_summary(rows)


@query
def event_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("/"), "event_type", F.lit("/x")).alias("path"), (F.col("user_id") % 3).alias("status")
    )
    return ops.request_counts(rows)


@query
def gauges(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value"), F.struct("ts", "event_id").alias("ts"))
    return ops.last_values(rows)


@query
def exposition(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    labels = F.create_map(F.lit("type"), F.concat("event_type", F.lit('"\n')), F.lit("app"), F.lit("x"))
    return ops.exposition(rows.select(F.lit("events_total").alias("name"), labels.alias("labels"), "value"))


@query
def feedback_votes(spark, sf_dir):
    votes = _table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "up").otherwise("down").alias("vote"))
    return ops.vote_counts(votes)


@query
def feedback_stream(spark, sf_dir):
    """Feedback lines of which every third is sent twice, in two goes with a restart
    between, as a log that holds each once."""
    folder = new_folder(spark, "feedback")
    rows = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") % 1800).alias("ts"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("vote")
    )
    goes = [rows.where("id % 2 = 0").union(rows.where("id % 6 = 0")), rows.where("id % 2 = 1").union(rows.where("id % 3 = 0"))]
    for go in goes:
        go.write.mode("append").json(f"{folder}/in")
        log = state.drain(spark, f"{folder}/in", rows.schema, ops.feedback_log, f"{folder}/log", f"{folder}/checkpoint", "json")
    return ops.vote_counts(log)


@query
def khop_deep(spark, sf_dir):
    """Six hops from every hundredth customer over nations and regions to customers and
    suppliers; nations are hubs in pieces."""
    t = lambda name: _table(spark, sf_dir, name)
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = (
        t("nation").select(name("n", "n_nationkey").alias("s"), F.lit("in").alias("r"), name("r", "n_regionkey").alias("o"))
        .union(t("customer").select(name("c", "c_custkey"), F.lit("of"), name("n", "c_nationkey")))
        .union(t("supplier").select(name("s", "s_suppkey"), F.lit("of"), name("n", "s_nationkey")))
        .withColumn("chunk_id", F.col("s"))
    )
    starts = t("customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), name("c", "c_custkey").alias("name"))
    return graph.hop_counts(starts, edges, 6, hub=50)


@query
def answer_cache(spark, sf_dir):
    asked = L.frame(spark, L.ASKED, "query_id int, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    stored = L.frame(spark, L.STORED, "key string, ts string, answer string").withColumn("ts", F.col("ts").cast("timestamp"))
    # Of the log, every third event asks, the one after it has stored an answer.
    e = _table(spark, sf_dir, "events")
    key, when = F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")), F.col("ts").cast("timestamp")
    asked = asked.union(e.where("event_id % 3 = 0").select((F.col("event_id") + 100).cast("int"), key, when))
    stored = stored.union(e.where("event_id % 3 = 1").select(key, when, F.col("event_id").cast("string")))
    return ops.cached_answers(asked, stored)


# -- stored zones and files --------------------------------------------------------------


@query
def stored_index(spark, sf_dir):
    """BM25 over a lexical index that is written, read again and asked."""
    folder = new_folder(spark, "index")
    index.write_index(_chunks(spark, sf_dir), folder)
    return search.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), 10, stored=index.read_index(spark, folder))


@query
def postings_topk(spark, sf_dir):
    """BM25 by blocks of postings, in two segments."""
    folder, chunks = new_folder(spark, "segments"), _chunks(spark, sf_dir)
    for n in (0, 1):
        postings.add_segment(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == n), folder, buckets=8)
    return postings.search(spark, folder, _questions(spark, sf_dir), 10)


@query
def postings_update(spark, sf_dir):
    """The same after a later state of the documents came in by its differences."""
    folder = new_folder(spark, "segments")
    old, new = (x.withColumnRenamed("doc_id", "chunk_id") for x in _versions(spark, sf_dir))
    postings.add_segment(old, folder, buckets=8)
    hashed = [x.select(F.col("chunk_id").alias("doc_id"), T.content_hash(F.col("text")).alias("hash"), F.lit("plain").alias("strategy")) for x in (new, old)]
    postings.update(new, index.incremental_diff(*hashed), folder)
    return postings.search(spark, folder, _questions(spark, sf_dir), 10)


@query
def zone_roundtrip(spark, sf_dir):
    """Cleaned texts, chunks by strategy, vectors by role and edges, stored and read again."""
    folder = new_folder(spark, "zones")
    docs = clean.clean_documents(_strings(spark, sf_dir))
    files.write_zone(docs.select("doc_id", "text"), f"{folder}/cleaned")
    cleaned = spark.read.parquet(f"{folder}/cleaned")
    own = chunk.parent_child(cleaned)
    files.write_zone(own, f"{folder}/chunked", by="strategy")
    chunks = spark.read.schema(chunk.CHUNK_SCHEMA).parquet(f"{folder}/chunked")
    files.write_zone(chunks.join(index.dense_embedding(index.searchable(chunks)), "chunk_id").select("chunk_id", "role", "vector"), f"{folder}/vectors", by="role")
    vectors = spark.read.parquet(f"{folder}/vectors")
    files.write_zone(graph.extract_triples(chunks.select("chunk_id", "doc_id", "text")), f"{folder}/edges")
    parts = [
        cleaned.select(F.lit("cleaned").alias("zone"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")),
        chunks.select(F.lit("chunked"), "chunk_id", F.length("text").cast("long")),
        vectors.where("role = 'child'").select(F.lit("vectors"), "chunk_id", F.size("vector").cast("long")),
        spark.read.parquet(f"{folder}/edges").select(F.lit("edges"), F.concat_ws(" ", "s", "r", "o"), F.length("chunk_id").cast("long")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def json_lines(spark, sf_dir):
    """Turns appended as JSON lines in two goes and read again, with the time of writing."""
    folder = new_folder(spark, "lines")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    for n in (0, 1):
        files.append_json_lines(rows.where(F.col("turn") % 2 == n), folder)
    back = files.read_json_lines(spark, folder, "conv_id long, turn long, text string, ts string")
    return back.select("conv_id", "turn", "text", F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT").alias("stamped"))


@query
def history_last(spark, sf_dir):
    """The last hundred events of a log of JSON lines, in the order of the log."""
    folder = new_folder(spark, "log")
    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("#"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("ts"))
    rows.write.json(folder)
    last = files.read_json_lines(spark, folder, "event_id long, ts string", last=100)
    return last.select("event_id", F.row_number().over(Window.orderBy("ts")).alias("place"))


@query
def corpus_files(spark, sf_dir):
    """A benchmark's corpus, judgements and golden set, written as its files and read again."""
    folder = new_folder(spark, "corpus")
    items = _table(spark, sf_dir, "benchmark")
    items.select(F.col("item_id").cast("string").alias("_id"), F.concat(F.lit(" title "), "item_id").alias("title"), "text").write.json(f"{folder}/corpus")
    lines = items.select(F.concat_ws("\t", "item_id", F.lit("d1"), (F.col("item_id") % 3).cast("string")).alias("value"))
    lines.union(spark.createDataFrame([("query-id\tcorpus-id\tscore",)], "value string")).write.text(f"{folder}/qrels")
    golden = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.split("text", " ").alias("answer_keywords"), F.array(F.lit("d1")).alias("relevant_docs"), F.lit("n").alias("notes"))
    golden.write.json(f"{folder}/golden")
    corpus = files.read_corpus(spark, f"{folder}/corpus")
    graded = evaluate.restrict(files.read_qrels(spark, f"{folder}/qrels"), items.where("item_id % 2 = 0").select(F.col("item_id").cast("string").alias("query_id")))
    asked = files.read_golden(spark, f"{folder}/golden", multi_line=False)
    out = corpus.join(asked.select(F.col("id").alias("doc_id"), F.size("answer_keywords").alias("keywords")), "doc_id")
    return out.join(graded.select(F.col("query_id").alias("doc_id"), "grade"), "doc_id", "left").select("doc_id", "text", "keywords", "grade")


@query
def raw_scan(spark, sf_dir):
    """A folder of text files, one for each nation, some blank."""
    folder = new_folder(spark, "raw")
    nations = _table(spark, sf_dir, "nation")
    text = F.when(F.col("n_nationkey") % 5 == 0, "  ").otherwise(F.concat_ws(" ", F.lit("# Nation"), "n_name"))
    nations.select(F.concat(F.lit("key"), F.col("n_nationkey").cast("string")).alias("name"), text.alias("value")).repartition("name").write.partitionBy("name").text(folder)
    docs = files.read_raw(spark, folder)
    return docs.select(F.regexp_extract("doc_id", "name=([^/]+)/", 1).alias("name"), T.strip(F.col("text")).alias("text"))


@query
def rich_documents(spark, sf_dir):
    """Customers' rows as DOCX, PDF and text files in folders by nation, read again."""
    folder = new_folder(spark, "rich")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")

    def documents(frames):
        for frame in frames:
            names, contents = [], []
            for r in frame.itertuples(index=False):
                kind = ("docx", "pdf", "txt")[r.c_custkey % 3]
                lines = [f"Customer {r.c_name} (no. {r.c_custkey})", f"Segment: {r.c_mktsegment}"]
                names.append(f"n{r.c_nationkey}/c{r.c_custkey}.{kind}")
                contents.append({"docx": lambda: raw.docx_document(lines[:1], [["field", "value"], lines[1].split(": ")]), "pdf": lambda: raw.pdf_document([lines[:1], lines[1:]]), "txt": lambda: "\n".join(lines).encode()}[kind]())
            yield pd.DataFrame({"name": names, "content": contents})

    raw.write_files(raw.dealt(rows, "c_custkey").mapInPandas(documents, "name string, content binary"), folder)
    return raw.read_folder(spark, folder).select("doc_id", "text")


@query
def result_files(spark, sf_dir):
    """A run's summary as a result file, read again as the baseline of another run."""
    folder = new_folder(spark, "result")
    rows = _table(spark, sf_dir, "lineitem")
    summary = rows.agg(F.round(F.avg("l_discount") * 10, 3).alias("faithfulness"), F.round(F.avg("l_tax") * 10, 3).alias("recall"), F.round(F.avg("l_quantity") / 100, 3).alias("ndcg"))
    files.write_result(summary, folder)
    base = files.read_result(spark, folder, L.SUMMARY)
    return evaluate.drift(L.frame(spark, L.NOW, L.SUMMARY), base, ["faithfulness", "recall", "ndcg"])


# -- model tiers, with stand-ins for models ------------------------------------------------


def _length_scores():
    return lambda questions, texts: (texts.str.len() % 97 + questions.str.len() % 7) / 100.0


def _broken():
    raise RuntimeError("no model here")


def _letter_counts():
    return lambda texts: [[float(len(t)), 1.0 + t.count("a"), 1.0 + t.count("e")] for t in texts]


def _echo():
    return lambda system, prompts: [f"{len(p)} characters" if len(p) % 3 else "" for p in prompts]


def _pairs():
    return lambda system, prompts: [
        "Reply: " + ", ".join(f'[{{"s":"T{len(p) % 5}","r":"uses","o":"T{len(p) % 11}"}}]' for _ in range(1)) for p in prompts
    ]


@query
def rerank_tiers(spark, sf_dir):
    """The second tier's model where the first doesn't load."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hits = search.bm25_topk(chunks, questions, 20)
    out, method = search.rerank(questions, hits, chunks, "auto", {"cross-encoder": _broken, "flashrank": _length_scores})
    return out.withColumn("method", F.lit(method))


@query
def embed_tiers(spark, sf_dir):
    """Dense search by a model's vectors; a question asked twice is embedded once."""
    embed = index.embed_with(_letter_counts)
    return search.dense_topk(embed(_chunks(spark, sf_dir), "chunk_id"), search.embed_queries(_questions(spark, sf_dir), embed), 10)


@query
def model_answers(spark, sf_dir):
    """A model's answers, and extractive ones where its reply is empty, with their usage."""
    questions, contexts = _contexts(spark, sf_dir)
    answers = models.generate(questions, contexts, _echo)
    prompts = answer.build_prompts(questions, contexts.select("query_id", "doc_id", "text", "rank"))
    out = answer.usage(prompts.join(answers, "query_id"))
    return out.select("query_id", "method", F.when(F.col("method") == "model", F.col("answer")).alias("reply"), "prompt_tokens")


@query
def model_facts(spark, sf_dir):
    """Triples that a model reads from hinting chunks, up to the cap."""
    own = _strings(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "doc_id", F.concat("text", F.lit(" vendor")).alias("text"))
    return models.extract_triples(own, _pairs)


@query
def model_rewrite(spark, sf_dir):
    """A model's rewriting of questions around which the graph has nothing."""
    more = _questions(spark, sf_dir).select((F.col("query_id") + 1000).alias("query_id"), "text")
    asked = L.frame(spark, L.QUESTIONS, "query_id long, text string").unionByName(more)
    return agent.rewrite(asked, cut(_facts(spark, sf_dir)), model=_echo)


@query
def benchmark_systems(spark, sf_dir):
    """The three systems of the benchmark, to depth 50, ten reported."""
    chunks = _chunks(spark, sf_dir)
    return search.benchmark_run(chunks, index.dense_embedding(chunks), _questions(spark, sf_dir))


@query
def backend_fallback(spark, sf_dir):
    """Dense search with a store that fails: the search here stands in."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))

    def store(vectors, queries, k):
        raise ConnectionError("no store here")

    return search.dense_topk(e, e.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 10, backend=store)


@query
def admission_cap(spark, sf_dir):
    """Which clients an admission state of so many keys still holds after each event."""
    return ops.tracked_keys(_table(spark, sf_dir, "events"), seconds=86400.0, most_keys=50)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    every = SQL | REST
    return {name: every[name] for name in Q if name in every}
