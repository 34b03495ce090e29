"""Retrieval of many queries in one job: BM25, vectors, fusion, rerank, parents.

Hits are rows (query_id, chunk_id, score, rank). Scores are rounded to four digits
first and ties go to the lesser id, so that ranks don't depend on summing order.

Searches score a document within its row: what they need of the queries goes to the
workers in lots of bounded size, a batch of documents meets a lot as one matrix
product, and each partition sends on the best k of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .index import bm25_statistics, dense_embedding, token_table
from .lineage import cut
from .topk import Best, rounded

#: Numbers of a lot of queries that go to every worker: pairs of query and term, or entries of vectors.
QUERY_NUMBERS = 4_000_000
#: Documents scored at once, times queries; and pairs of posting and query added up at once.
SCORES = 1_000_000
#: Tokens of documents that are looked up at once.
TOKENS = 500_000


def ranked(hits: DataFrame, k: int, id_col: str = "chunk_id", score: str = "score") -> DataFrame:
    """The first k of each query. Spark cuts each partition to k before shuffling."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lots(rows: DataFrame, numbers: int) -> list[DataFrame]:
    """The queries in lots; `numbers` is what all of them hold."""
    lots = max(1, -(-numbers // QUERY_NUMBERS))
    return [rows.where(F.pmod(F.xxhash64("query_id"), F.lit(lots)) == i) for i in range(lots)] if lots > 1 else [rows]


def _no_hits(docs: DataFrame, queries: DataFrame, id_col: str) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    return docs.select(F.lit(None).cast(kind).alias("query_id"), id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")


def bm25_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    include_zero: bool = False,
    k1: float = 1.5,
    b: float = 0.75,
    variant: str = "plain",
    stored: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The best k chunks of each query, with scores above zero.

    Every occurrence of a term in the query counts. variant "okapi" takes the
    classical idf, negatives lifted to a quarter of the mean over the queries' terms.
    With include_zero, queries with fewer hits are filled with the first chunks by
    id, as a ranking of the whole corpus is. `stored` is an index of read_index():
    docs is not read then, and no text is tokenised.
    """
    tokens = token_table(docs) if stored is None else stored["tokens"]
    asked = queries.select("query_id", F.explode(T.code_tokens(F.coalesce("text", F.lit("")))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weighed = bm25_statistics(tokens, asked.select("term").distinct(), variant, stored)
    lots = _lots(asked, asked.count())
    if len(lots) > 1:  # what all lots need is computed once
        weighed, tokens = cut(weighed), tokens if stored is not None else cut(tokens)
    out = None
    for lot in lots:
        held = lot.join(weighed, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("w"), "avgdl").collect()
        if not held:
            continue
        part = tokens.select("chunk_id", "tokens").mapInArrow(
            _bm25_search(tokens, held, queries, k, k1, b), f"query_id {_kind(queries, 'query_id')}, chunk_id {_kind(tokens, 'chunk_id')}, score double"
        )
        out = part if out is None else out.unionByName(part)
    hits = _no_hits(tokens, queries, "chunk_id") if out is None else ranked(out, k)
    if not include_zero:
        return hits
    first = tokens.select("chunk_id").orderBy("chunk_id").limit(2 * k)
    fill = queries.select("query_id").crossJoin(F.broadcast(first)).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return ranked(hits.drop("rank").unionByName(fill.withColumn("score", F.lit(0.0))), k)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _blocks(tokens: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """(first, rows) of blocks of so many rows and TOKENS tokens at most, one row at least."""
    ends, at = tokens.offsets.to_numpy(), 0
    while at < len(tokens):
        upto = int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1
        upto = min(max(upto, at + 1), at + rows, len(tokens))
        yield at, upto - at
        at = upto


def _bm25_search(docs: DataFrame, held: list, queries: DataFrame, k: int, k1: float, b: float):
    """Scores of batches of (chunk_id, tokens) against query weights."""
    number: dict = {}
    for r in held:
        number.setdefault(r["query_id"], len(number))
    ids = list(number)
    # Sparse by term: its queries and their weights lie side by side.
    rows = sorted((r["term"], number[r["query_id"]], r["w"]) for r in held)
    names = np.array([r[0] for r in rows], object)
    begins = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    terms = names[begins].tolist()
    offsets = np.r_[begins, len(rows)]
    shared = docs.sparkSession.sparkContext.broadcast((ids, terms, offsets, np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float), held[0]["avgdl"]))
    q_type = to_arrow_type(queries.schema["query_id"].dataType)
    id_type = to_arrow_type(docs.schema["chunk_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, offsets, query, weight, avgdl = shared.value
        best, known, n = Best(len(ids), k, id_type), pa.array(terms, pa.string()), len(ids)
        for whole in batches:
            for at, rows in _blocks(whole.column(1), max(1, SCORES // n)):
                batch = whole.slice(at, rows)
                tokens = batch.column(1)
                sizes = np.diff(tokens.offsets.to_numpy())
                found = pc.index_in(tokens.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(batch.num_rows), sizes)[found >= 0]
                pairs, f = np.unique(doc * len(terms) + found[found >= 0], return_counts=True)
                doc, term = pairs // len(terms), pairs % len(terms)
                part = f * (k1 + 1) / (f + k1 * (1 - b + b * np.maximum(sizes, 1)[doc] / avgdl))
                scores = np.zeros(batch.num_rows * n)
                asked = offsets[term + 1] - offsets[term]
                upto = np.cumsum(asked)
                low = 0
                while low < len(pairs):
                    # As many postings as give SCORES pairs with queries, one at least.
                    high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SCORES, "right")))
                    many = asked[low:high]
                    place = np.repeat(offsets[term[low:high]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    scores += np.bincount(np.repeat(doc[low:high], many) * n + query[place], np.repeat(part[low:high], many) * weight[place], len(scores))
                    low = high
                scores = rounded(scores.reshape(batch.num_rows, n))
                best.add(batch.column(0), scores, scores > 0)
        yield best.batch(pa.array(ids, q_type), "chunk_id")

    return run


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "chunk_id", positive: bool = False, backend=None) -> DataFrame:
    """Exact cosine search. vectors: id, vector; queries: query_id, vector.

    A zero vector scores 0. With `positive`, only pairs with a product above 0 count.
    Vectors of another length than the longest query's are no hits and find none.
    A `backend` (vectors, queries, k) -> hits is asked first, and this search stands
    in where it fails.
    """
    if backend is not None:
        try:
            return backend(vectors, queries, k)
        except Exception as error:  # whatever a remote store raises
            print(f"vector backend failed, searching here: {error}")
    rows = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    width, count = rows.agg(F.max(F.size("vector")), F.count("*")).first()
    alike = F.size("vector") == F.lit(width or 0)
    out = None
    for lot in _lots(rows.where(alike), (width or 1) * count):
        held = lot.collect()
        if not held:
            continue
        matrix = _unit(np.array([r["vector"] for r in held], float))
        shared = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in held], matrix))
        part = vectors.select(id_col, F.col("vector").cast("array<double>").alias("vector")).where(alike).mapInArrow(
            _block_search(shared, k, id_col, vectors, queries, positive), f"query_id {_kind(queries, 'query_id')}, {id_col} {_kind(vectors, id_col)}, score double"
        )
        out = part if out is None else out.unionByName(part)
    return _no_hits(vectors, queries, id_col) if out is None else ranked(out, k, id_col)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    norms[norms == 0] = 1.0
    return matrix / norms


def _block_search(shared, k: int, id_col: str, vectors: DataFrame, queries: DataFrame, positive: bool):
    q_type = to_arrow_type(queries.schema["query_id"].dataType)
    id_type = to_arrow_type(vectors.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        best = Best(len(query_ids), k, id_type)
        step = max(1, SCORES // max(matrix.shape))
        for whole in batches:
            known = np.flatnonzero(whole.column(1).is_valid().to_numpy(zero_copy_only=False))
            for at in range(0, len(known), step):
                batch = whole.take(pa.array(known[at : at + step]))
                block = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                raw = _unit(block) @ matrix.T
                best.add(batch.column(0), rounded(raw), raw > 0 if positive else None)
        yield best.batch(pa.array(query_ids, q_type), id_col)

    return run


def hashed_topk(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Cosine search over hash embeddings of texts: chunk_id, text (or vector) against
    query_id, text. Chunks that share no bucket with a query are no hits."""
    stored = docs.select("chunk_id", "vector") if "vector" in docs.columns else dense_embedding(docs)
    return dense_topk(stored, embed_queries(queries), k, positive=True)


def embed_queries(queries: DataFrame, embed=None) -> DataFrame:
    """query_id, vector. Equal questions, in lower case and stripped, are embedded once.
    embed: (key, text) rows -> key, vector; hash embeddings by default."""
    keyed = queries.select("query_id", F.lower(T.strip(F.coalesce("text", F.lit("")))).alias("key"))
    distinct = keyed.select("key", F.col("key").alias("text")).distinct()
    vectors = dense_embedding(distinct, "key") if embed is None else embed(distinct)
    return keyed.join(vectors, "key").select("query_id", "vector")


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, top_n: int = 10) -> DataFrame:
    """Reciprocal-rank fusion. Both: query_id, chunk_id, score, rank; a branch that
    lacks a hit adds nothing."""
    sides = [
        df.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
        for name, df in (("dense", dense), ("bm25", sparse))
    ]
    merged = sides[0].join(sides[1], ["query_id", "chunk_id"], "full_outer")
    part = lambda name: F.coalesce(1 / (k + F.col(f"{name}_rank")), F.lit(0.0))
    raw = merged.withColumn("raw", part("dense") + part("bm25"))
    order = Window.partitionBy("query_id").orderBy(
        F.col("raw").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "chunk_id"
    )
    score = lambda name: F.coalesce(f"{name}_score", F.lit(0.0)).alias(f"{name}_score")
    return (
        raw.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("query_id", "chunk_id", F.round("raw", 5).alias("rrf"), score("dense"), score("bm25"), "rank")
    )


def branch_report(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, how many hits each branch gave, and its first three."""
    top = F.transform(
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), 1, 3), lambda x: x["chunk_id"]
    )
    # A branch holds at most its k rows for a query.
    a = dense.groupBy("query_id").agg(F.count("*").alias("dense_n"), top.alias("dense_top"))
    b = sparse.groupBy("query_id").agg(F.count("*").alias("sparse_n"), top.alias("sparse_top"))
    return a.join(b, "query_id", "full_outer").na.fill(0)


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, mode: str = "hybrid", top_k: int = 20, stored: dict | None = None, embed=None) -> DataFrame:
    """mode: dense, bm25 or hybrid. vectors: chunk_id, vector, of the embedder that
    `embed` is (hash embeddings by default)."""
    if mode == "bm25":
        return bm25_topk(docs, queries, top_k, stored=stored)
    dense = dense_topk(vectors, embed_queries(queries, embed), top_k, positive=embed is None)
    if mode == "dense":
        return dense
    return fuse(dense, bm25_topk(docs, queries, top_k, stored=stored), top_n=top_k)


def benchmark_run(docs: DataFrame, vectors: DataFrame, queries: DataFrame, depth: int = 50, reported: int = 10) -> DataFrame:
    """system, query_id, chunk_id, rank: dense, bm25 and their fusion, each branch a
    ranking of the whole corpus (zero scores included) to `depth`."""
    dense = dense_topk(vectors, embed_queries(queries), depth)
    sparse = bm25_topk(docs, queries, depth, include_zero=True)
    runs = {"dense": dense, "bm25": sparse, "hybrid": fuse(dense, sparse, top_n=depth)}
    parts = [df.where(F.col("rank") <= reported).select(F.lit(name).alias("system"), "query_id", "chunk_id", "rank") for name, df in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lexical_rerank(queries: DataFrame, candidates: DataFrame, chunks: DataFrame, top_n: int = 5) -> DataFrame:
    """candidates: query_id, chunk_id, rank. Share of the query's words that the
    chunk has, and half a point for a product code in common."""
    asked = queries.select(
        "query_id",
        F.array_distinct(T.plain_tokens(F.coalesce("text", F.lit("")))).alias("q"),
        T.product_codes(F.coalesce("text", F.lit(""))).alias("qc"),
    )
    texts = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = candidates.select("query_id", "chunk_id", F.col("rank").alias("prior")).join(texts, "chunk_id").join(asked, "query_id")
    shared = F.size(F.array_intersect("q", T.plain_tokens(F.col("text")))) / F.greatest(F.size("q"), F.lit(1))
    boost = F.when(F.arrays_overlap("qc", T.product_codes(F.col("text"))), 0.5).otherwise(0.0)
    scored = rows.select("query_id", "chunk_id", "prior", F.round(shared + boost, 4).alias("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "prior")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def rerank_with(queries: DataFrame, candidates: DataFrame, chunks: DataFrame, score, top_n: int = 5, chars: int = 2000) -> DataFrame:
    """As lexical_rerank, by a model: score(question Series, text Series) -> Series."""
    @F.pandas_udf("double")
    def own(q: pd.Series, t: pd.Series) -> pd.Series:
        return score(q, t)

    rows = (
        candidates.select("query_id", "chunk_id", F.col("rank").alias("prior"))
        .join(chunks.select("chunk_id", F.substring("text", 1, chars).alias("t")), "chunk_id")
        .join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    )
    scored = rows.select("query_id", "chunk_id", "prior", own("q", "t").alias("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "prior")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


#: Characters of a text that each kind of model reads.
RERANK_CHARS = {"cross-encoder": 2000, "flashrank": 1500}


def rerank(
    queries: DataFrame, candidates: DataFrame, chunks: DataFrame, mode: str = "auto", models: dict | None = None, top_n: int = 5
) -> tuple[DataFrame, str]:
    """(reranked hits, method). Tiers: a cross-encoder, a light model, the words in
    common. `models` maps a tier to a loader that gives score(questions, texts) or
    raises; mode auto takes the first that loads, another mode that one. Where none
    does, words decide, and the method says so."""
    if mode not in ("auto", "heuristic", *RERANK_CHARS):
        raise ValueError(f"no such mode: {mode}")
    failed = []
    for tier, chars in RERANK_CHARS.items():
        if mode not in ("auto", tier):
            continue
        try:
            score = (models or {})[tier]()
        except Exception as error:  # whatever a model's loader raises
            failed.append(f"{tier}: {error}")
            continue
        return rerank_with(queries, candidates, chunks, score, top_n, chars), tier
    method = "heuristic" if mode == "heuristic" else f"heuristic({'; '.join(failed)})"
    return lexical_rerank(queries, candidates, chunks, top_n), method


def rerank_delta(reranked: DataFrame, candidates: DataFrame, top_n: int = 5) -> DataFrame:
    """query_id and how many of the reranked weren't among the first top_n before."""
    before = candidates.where(F.col("rank") <= top_n).select("query_id", "chunk_id", F.lit(1).alias("was"))
    after = reranked.select("query_id", "chunk_id").join(before, ["query_id", "chunk_id"], "left")
    return after.groupBy("query_id").agg(F.sum(F.when(F.col("was").isNull(), 1).otherwise(0)).alias("rerank_delta"))


def expand_parents(hits: DataFrame, chunks: DataFrame, top_n: int = 5) -> DataFrame:
    """hits: query_id, chunk_id, rank. A child becomes its parent, of equal results
    the first stays, and ranks close up."""
    store = chunks.select("chunk_id", "doc_id", "text", "parent_id")
    own = hits.join(store, "chunk_id", "left")
    parents = chunks.select(F.col("chunk_id").alias("pid"), F.col("doc_id").alias("pdoc"), F.col("text").alias("ptext"))
    joined = own.join(parents, F.col("parent_id") == F.col("pid"), "left")
    found = F.col("pid").isNotNull()
    rows = joined.select(
        "query_id",
        F.when(found, F.col("pid")).otherwise(F.col("chunk_id")).alias("context_id"),
        F.when(found, F.col("pdoc")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(found, F.col("ptext")).otherwise(F.col("text")).alias("text"),
        F.when(found, F.col("chunk_id")).alias("retrieved_via"),
        "rank",
    )
    first = F.row_number().over(Window.partitionBy("query_id", "context_id").orderBy("rank"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return (
        rows.withColumn("n", first)
        .where("n = 1")
        .drop("n")
        .withColumn("rank", again)
        .where(F.col("rank") <= top_n)
    )


def recall_mass(hits: DataFrame, queries: DataFrame, first: int = 5, least: float = 0.02) -> DataFrame:
    """query_id, mass of the first hits' rrf, weak."""
    mass = hits.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= first, F.col("rrf"))).alias("mass"))
    joined = queries.select("query_id").join(mass, "query_id", "left")
    value = F.coalesce("mass", F.lit(0.0))
    return joined.select("query_id", value.alias("mass"), (F.col("mass").isNull() | (value < least)).alias("weak"))
