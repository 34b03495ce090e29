"""Whole runs: ingest, question answering, and evaluation, each as few jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agent, answer, chunk, clean, evaluate, graph, index, models, search


def ingest(docs: DataFrame, strategy: str = "parent_child", size: int = 512, overlap: int = 80, facts: bool = True) -> dict[str, DataFrame]:
    """Tables of an index: cleaned documents with hashes, chunks, vectors and, with `facts`,
    triples, whose names are gathered and merged at once; the others are computed as used."""
    cleaned = clean.clean_documents(docs).withColumns({"hash": T.content_hash(F.col("text")), "strategy": F.lit(strategy)})
    chunks = clean.annotate(chunk.chunk_documents(cleaned, strategy, size, overlap))
    own = index.searchable(chunks)
    tables = {"documents": cleaned, "chunks": chunks, "vectors": index.dense_embedding(own)}
    return tables | ({"triples": graph.merge_aliases(graph.extract_triples(own))} if facts else {})


def ask(queries: DataFrame, tables: dict[str, DataFrame], top_k: int = 20, top_n: int = 5, use_agent: bool = True, expand: bool = True, model: models.Loader | None = None) -> dict[str, DataFrame]:
    """Answers to many questions: query_id, answer, flagged; hits and prompts beside.

    Questions that look like injections are flagged and get no retrieval.
    """
    flagged = queries.withColumn("flagged", T.injection_flag(F.col("text")))
    safe = flagged.where(~F.col("flagged")).drop("flagged")
    own = index.searchable(tables["chunks"])
    if use_agent:
        hits, trace = agent.run_agent(own, tables["vectors"], safe, tables["triples"], top_k, top_n=top_n, model=model)
    else:
        found = search.search(own, tables["vectors"], safe, top_k=top_k)
        hits, trace = search.lexical_rerank(safe, found, own, top_n), None
    if expand:
        contexts = search.expand_parents(hits.select("query_id", "chunk_id", "rank"), tables["chunks"], top_n)
        scores = hits.select("query_id", F.col("chunk_id").alias("via"), "rerank_score")
        via = F.coalesce("retrieved_via", "context_id")
        contexts = contexts.withColumn("via", via).join(scores, ["query_id", "via"], "left").drop("via")
    else:
        contexts = hits.join(own.select("chunk_id", "doc_id", "text"), "chunk_id").withColumnRenamed("chunk_id", "context_id")
    contexts = answer.redacted(contexts)
    plain = safe.withColumn("text", T.redact(F.col("text"))["text"])
    answers = models.generate(plain, contexts, model)
    out = flagged.select("query_id", "flagged").join(answers, "query_id", "left")
    return {"answers": out, "hits": hits, "contexts": contexts, "prompts": answer.build_prompts(plain, contexts), "trace": trace}


def evaluate_run(golden: DataFrame, tables: dict[str, DataFrame], mode: str = "hybrid", use_rerank: bool = True, use_agent: bool = False, k: int = 5) -> DataFrame:
    """One row: the mean measures of golden questions (id, question, answer_keywords,
    relevant_docs) and the gate."""
    queries = golden.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    own = index.searchable(tables["chunks"])
    if use_agent:
        hits, _ = agent.run_agent(own, tables["vectors"], queries, tables["triples"])
    else:
        hits = search.search(own, tables["vectors"], queries, mode, 10)
        hits = search.lexical_rerank(queries, hits, own, k) if use_rerank else hits.where(F.col("rank") <= k)
    run = hits.join(own.select("chunk_id", "doc_id", "text"), "chunk_id")
    gold = golden.select(F.col("id").alias("query_id"), F.explode("relevant_docs").alias("doc_id"))
    ranks = evaluate.retrieval_metrics(run.select("query_id", "chunk_id", "doc_id", "rank"), gold, k)
    score = F.col("rerank_score") if "rerank_score" in run.columns else F.lit(None).cast("double")
    answers = answer.extractive_answers(queries, run.withColumn("rerank_score", score))
    faithful = evaluate.faithfulness(answers, run.select("query_id", "doc_id", "text"))
    words = golden.select(F.col("id").alias("query_id"), F.col("answer_keywords").alias("keywords"))
    relevant = evaluate.answer_relevance(answers.join(words, "query_id"))
    every = ranks.join(faithful, "query_id").join(relevant, "query_id")
    row = evaluate.summary(every, ["precision", "recall", "mrr", "ndcg", "faithfulness", "relevance"])
    return evaluate.gate(row, {"faithfulness": 0.6, "recall": 0.6})
