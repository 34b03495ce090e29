"""The searchable index as tables: postings, statistics, vectors, and what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import first_rows


def searchable(chunks: DataFrame) -> DataFrame:
    """All but parents; a missing role counts as a child."""
    return chunks.where(F.coalesce("role", F.lit("child")) != "parent")


def token_table(docs: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """id, tokens of each text."""
    return docs.select(id_col, T.code_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def document_frequencies(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """term, df. Terms are made distinct within the row, so partial counts shrink
    before they are shuffled."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def okapi_idf(n: Column, df: Column) -> Column:
    """The classical form; may be negative (see `okapi_floor` in search)."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """n, avgdl of the whole index: one row."""
    size = F.size("tokens")
    return tokens.agg(
        F.count("*").alias("n"), (F.coalesce(F.sum(size), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl")
    )


def term_stats(docs: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """term, df, idf."""
    tokens = token_table(docs, id_col)
    one_row = tokens.agg(F.count("*").alias("n"))
    return document_frequencies(tokens, id_col).crossJoin(F.broadcast(one_row)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def bm25_statistics(tokens: DataFrame, terms: DataFrame, variant: str = "plain", stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """term, idf, avgdl of the terms that the corpus has: one pass over the tokens, in
    which only those terms leave the scan, or a lookup in a stored index."""
    if stored is not None:
        df, stats = stored["terms"].join(terms, "term"), stored["stats"]
    else:
        held = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).join(terms, "term")
        df, stats = held.groupBy("term").agg(F.count("*").alias("df")), corpus_stats(tokens)
    df = df.crossJoin(F.broadcast(stats))
    if variant != "okapi":
        return df.select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    raw = df.withColumn("idf", okapi_idf(F.col("n"), F.col("df")))
    mean = raw.agg((0.25 * F.avg("idf")).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), "avgdl")


def write_index(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Stores the lexical index of chunk_id, text as Parquet: the tokens of each chunk,
    the document frequencies in files by hash of the term, and the corpus' statistics."""
    tokens = token_table(docs)
    tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    tokens = docs.sparkSession.read.parquet(f"{path}/tokens")
    terms = document_frequencies(tokens).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    terms.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms")
    corpus_stats(tokens).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What write_index() stored, for bm25_topk()."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("tokens", "terms", "stats")}


def sparse_embedding(tokens: Column, size: int = T.EMBEDDING_SIZE) -> Column:
    """Map of bucket to weight, not normalised, from a text's tokens."""
    distinct = F.array_distinct(tokens)
    n = F.size(tokens)

    def entry(t: Column) -> Column:
        c = n - F.size(F.array_remove(tokens, t))
        return F.struct(T.embedding_bucket(t, size).alias("bucket"), (c * (1 + 0.1 * F.log(1 + c))).alias("w"))

    return F.transform(distinct, entry)


def _embedding_blocks(size: int, id_col: str):
    """(id, tokens) batches to (id, vector): a batch's distinct tokens are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                tokens, n = batch.column(1), batch.num_rows
                coded = tokens.flatten().dictionary_encode()
                doc = np.repeat(np.arange(n), np.diff(tokens.offsets.to_numpy()))
                width = max(1, len(coded.dictionary))
                pairs, c = np.unique(doc * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                names = coded.dictionary.to_pylist()
                bucket = np.array([int.from_bytes(hashlib.md5(t.encode()).digest(), "big") % size for t in names], np.int64)
                place = (pairs // width) * size + bucket[pairs % width] if len(pairs) else pairs
                vectors = np.bincount(place, c * (1 + 0.1 * np.log1p(c)), n * size).reshape(n, size)
                norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
                norms[norms == 0] = 1.0
                flat = pa.array((vectors / norms).reshape(-1))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], [id_col, "vector"])

    return run


def dense_embedding(docs: DataFrame, id_col: str = "chunk_id", size: int = T.EMBEDDING_SIZE) -> DataFrame:
    """id, vector of `size` doubles, of unit length; zeros for a text without tokens.

    A term that stands c times weighs c * (1 + 0.1 ln(1 + c)) in the bucket of its
    hash. A text is embedded within its row; nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return token_table(docs, id_col).mapInArrow(_embedding_blocks(size, id_col), f"{id_col} {kind}, vector array<double>")


def bucket_weights(docs: DataFrame, id_col: str = "chunk_id", size: int = T.EMBEDDING_SIZE) -> DataFrame:
    """id, bucket, weight: the nonzero parts of the embeddings."""
    parts = F.posexplode("vector").alias("bucket", "weight")
    return dense_embedding(docs, id_col, size).select(id_col, parts).where("weight > 0")


def embed_with(model, id_col: str = "chunk_id", size: int = T.EMBEDDING_SIZE):
    """An embedder by a model, as embed_queries() and reuse_vectors() take one: rows of
    id and text to id and vector. model() gives encode(list of texts) -> array; it is
    called once a task. Where it raises, hash embeddings stand in."""

    def embed(rows: DataFrame, key: str | None = None) -> DataFrame:
        key = key or next(c for c in (id_col, "key", "query_id", "chunk_id") if c in rows.columns)
        kind = rows.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                encode = model()
            except Exception:  # whatever a model's loader raises
                encode = None
            for batch in batches:
                if encode is None:
                    yield from _embedding_blocks(size, key)(iter([batch.select([0, 2]).rename_columns([key, "tokens"])]))
                    continue
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                vectors = np.asarray(encode(texts), float).reshape(len(texts), -1)
                norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
                norms[norms == 0] = 1.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors / norms), pa.list_(pa.float64()))], [key, "vector"])

        own = rows.select(key, "text", T.code_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
        return own.mapInArrow(run, f"{key} {kind}, vector array<double>")

    return embed


def incremental_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, status (added, removed, changed, same) of doc_id, hash, strategy tables."""
    was = old.select("doc_id", F.col("hash").alias("old_hash"), F.col("strategy").alias("old_strategy"))
    both = new.select("doc_id", "hash", "strategy").join(was, "doc_id", "full_outer")
    same = (F.col("hash") == F.col("old_hash")) & (F.col("strategy") == F.col("old_strategy"))
    status = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("hash").isNull(), "removed")
        .when(same, "same")
        .otherwise("changed")
    )
    return both.select("doc_id", status.alias("status"))


def reuse_vectors(chunks: DataFrame, stored: DataFrame, embed) -> DataFrame:
    """chunks with vectors: the stored one where id and text are the same, else
    embed(rows that lack one), a table of chunk_id, vector. Vectors of chunks that
    are gone don't come back."""
    kept = stored.where("vector is not null and size(vector) > 0").select("chunk_id", "text", F.col("vector").alias("vector"))
    reused = chunks.join(kept, ["chunk_id", "text"], "left").withColumn("reused", F.col("vector").isNotNull())
    fresh = embed(chunks.join(kept.select("chunk_id", "text"), ["chunk_id", "text"], "left_anti"))
    fresh = fresh.select("chunk_id", F.col("vector").alias("fresh"))
    return reused.join(fresh, "chunk_id", "left").withColumn("vector", F.coalesce("vector", "fresh")).drop("fresh")


def purge_stale(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of stored whose chunk is live."""
    return stored.join(live.select("chunk_id"), "chunk_id", "left_semi")


def stale_ids(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.select("chunk_id").join(live.select("chunk_id"), "chunk_id", "left_anti")


def point_id(chunk_id: Column) -> Column:
    """Version 5 UUID of the id in the URL namespace, as vector stores key points."""
    # Fixed value: the URL namespace.
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    digest = F.sha1(F.concat(space, chunk_id.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def limit_by_priority(chunks: DataFrame, n: int, distractor: str = "scale_") -> DataFrame:
    """The first n chunks, those of distractor documents last."""
    return first_rows(chunks, n, F.startswith("doc_id", F.lit(distractor)), F.col("chunk_id"))


def ingest_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, characters, reduction, mean estimate, split documents."""
    chars = docs.agg(
        F.count("*").alias("docs"),
        F.sum("report.chars_in").alias("chars_in"),
        F.sum("report.chars_out").alias("chars_out"),
    )
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("c"), F.sum("token_est").alias("t"))
    parts = per_doc.agg(
        F.sum("c").alias("chunks"),
        F.round(F.sum("t") / F.sum("c"), 1).alias("mean_token_est"),
        F.sum((F.col("c") > 1).cast("int")).alias("split_docs"),
    )
    reduction = F.round(100 * (1 - F.col("chars_out") / F.greatest("chars_in", F.lit(1))), 1)
    return chars.crossJoin(parts).withColumn("reduction_pct", reduction)
