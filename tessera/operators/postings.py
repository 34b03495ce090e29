"""An inverted index in segments: term-bucketed posting blocks with bounds, searched with
dynamic pruning.

A block is up to 128 postings of one term: the first document's number, the others as
differences from it, counts and document lengths. Its greatest count and least length
bound what it can add to a score, whatever the corpus' mean length becomes, so that
segments can be added. Blocks lie in files by hash of the term, sorted by term: a search
opens the buckets of its terms and skips row groups by their bounds.

Search, for all queries at once:

1. The blocks with the greatest bounds are scored, and the documents that are best by these
   partial scores are scored whole; the k-th best of them is a threshold that the k-th best
   of all can't be under.
2. Terms whose bounds together stay under the threshold can't make a hit; only the other
   terms' blocks give candidates, and of those only the ones that could pass with the rest
   at its best.
3. Of the terms left aside only the blocks are decoded that hold a candidate's number and
   could lift it over the threshold.

The documents that a task inverts at once are a cell; no block leaves its cell. Steps 2 and 3
are done by cell: the blocks of the queries' terms are sent there once, packed as they are
and however many queries ask for them, and a cell sends on k documents a query.

What the driver holds: a row of statistics, and up to FILTER_TERMS distinct terms of the
queries, which then prune the scan; more terms are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .index import idf
from .lineage import cut, new_folder, written
from .search import ranked

BLOCK, BUCKETS, SPREAD = 128, 64, 4
#: Parts in which a bucket is sorted and written.
PARTS = 8
#: Tokens that a task inverts at once.
CHUNK_TOKENS = 4_000_000
#: Blocks of a query that are scored for its threshold.
SEEDS = 16
#: Distinct terms up to which the scan is pruned by a list of them.
FILTER_TERMS = 2_000
#: Rows of queries' best blocks and documents that go to every worker.
SMALL = 1_000_000
#: Scores are rounded to four digits: what is closer than this to a threshold stays.
SLACK = 1e-4

_BLOCKS = "cell long, term string, bucket int, first long, last long, n int, max_tf int, min_dl int, docs array<int>, tfs array<int>, dls array<int>"


def _inverted(segment: int, id_type: pa.DataType, buckets: int, chunk_tokens: int):
    """(id, tokens) batches to a row for each document and each block."""

    def invert(ids: pa.Array, tokens: pa.Array, first: int, chunk: int) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(tokens.offsets.to_numpy())
        coded = tokens.flatten().dictionary_encode()
        terms, width = coded.dictionary, max(1, len(coded.dictionary))
        doc = np.repeat(np.arange(len(ids)), sizes)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, tf = np.unique(code * len(ids) + doc, return_counts=True)
        term, doc = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        # The terms of each document, for later updates.
        order = np.argsort(doc, kind="stable")
        offsets = np.searchsorted(doc[order], np.arange(len(ids) + 1)).astype(np.int32)
        forward = pa.ListArray.from_arrays(pa.array(offsets), terms.take(pa.array(term[order])))
        numbers = first + np.arange(len(ids))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(numbers), pa.array(sizes.astype(np.int32)), forward, pa.array(np.full(len(ids), first)), *(pa.nulls(len(ids), t) for t in _TYPES)], _NAMES
        )
        if not len(pairs):
            return
        # Where a term begins, and every BLOCK postings of it.
        begins = np.searchsorted(term, np.arange(width))
        within = np.arange(len(term)) - begins[term]
        starts = np.flatnonzero(within % BLOCK == 0)
        ends = np.r_[starts[1:], len(term)]
        base = doc[starts]
        lists = pa.array(np.r_[starts, len(term)].astype(np.int32))
        as_list = lambda values: pa.ListArray.from_arrays(lists, pa.array(values.astype(np.int32)))
        dl = np.maximum(sizes[doc], 1)
        names = terms.take(pa.array(term[starts]))
        # A frequent term's blocks are spread over buckets by chunk.
        frequent = np.bincount(term, minlength=width)[term[starts]] > 8 * BLOCK
        bucket = (np.array([_bucket(t) for t in terms.to_pylist()], np.int64)[term[starts]] + np.where(frequent, chunk % SPREAD, 0)) % buckets
        columns = [
            pa.array(np.full(len(starts), first)), names, pa.array(bucket.astype(np.int32)), pa.array(first + base), pa.array(first + doc[ends - 1]), pa.array((ends - starts).astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(dl, starts).astype(np.int32)),
            as_list(doc - np.repeat(base, ends - starts)), as_list(tf), as_list(dl),
        ]
        m = len(starts)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.string())), *columns], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, chunk, held, count = (segment << 48) + (TaskContext.get().partitionId() << 28), TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch.column(1).flatten())
            if count >= chunk_tokens:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield from invert(whole["id"].combine_chunks(), whole["tokens"].combine_chunks(), first, chunk)
                first, chunk, held, count = first + len(whole), chunk + 1, [], 0
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from invert(whole["id"].combine_chunks(), whole["tokens"].combine_chunks(), first, chunk)

    return run


_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *(pa.int32(),) * 3, *(pa.list_(pa.int32()),) * 3]
_NAMES = ["chunk_id", "doc", "dl", "terms", *(f.split()[0] for f in _BLOCKS.split(", "))]


def _bucket(term: str) -> int:
    """A number of 31 bits from the term, alike in every worker."""
    h = 2166136261
    for byte in term.encode():
        h = (h ^ byte) * 16777619 & 0xFFFFFFFF
    return h >> 1


def _segments(spark: SparkSession, path: str) -> DataFrame | None:
    """segment, n, tokens: a row for each segment and each update; None without any."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("segment int, buckets int, n long, tokens long").parquet(f"{path}/stats")
    except AnalysisException:
        return None


def add_segment(docs: DataFrame, path: str, buckets: int = BUCKETS, chunk_tokens: int = CHUNK_TOKENS) -> int:
    """Adds docs (chunk_id, text; ids that the index doesn't hold) as a segment; its number.
    The statistics are written last: a segment without them is not read."""
    spark = docs.sparkSession
    before = _segments(spark, path)
    last = before.agg(F.max("segment"), F.max("buckets")).first() if before is not None else (None, None)
    segment, buckets = (0 if last[0] is None else last[0] + 1), last[1] or buckets
    kind = docs.schema["chunk_id"].dataType
    tokens = docs.select(F.col("chunk_id").alias("id"), T.code_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    staged = new_folder(spark, "postings")
    run = _inverted(segment, to_arrow_type(kind), buckets, chunk_tokens)
    tokens.mapInArrow(run, f"chunk_id {kind.simpleString()}, doc long, dl int, terms array<string>, {_BLOCKS}").write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    own, blocks = rows.where("term is null").select("cell", "doc", "chunk_id", "dl", "terms"), rows.where("term is not null").drop("doc", "chunk_id", "dl", "terms")
    own.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs/segment={segment}")
    ordered = blocks.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(PARTS))).sortWithinPartitions("bucket", "term", "first")
    # Small row groups, so that a term's bounds leave most of a bucket unread.
    ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(f"{path}/blocks/segment={segment}")
    _write_terms(blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.collect_set("bucket").alias("held_in")), path, segment, buckets)
    stats = own.agg(F.lit(segment).alias("segment"), F.lit(buckets).alias("buckets"), F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens"))
    stats.write.mode("append").parquet(f"{path}/stats")
    return segment


def _write_terms(terms: DataFrame, path: str, segment: int, buckets: int, kind: str = "added") -> None:
    part = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    terms.withColumn("part", part).repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms/segment={segment}/kind={kind}")


def _terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, df long, held_in array<int>, part int").parquet(f"{path}/terms")


def update(docs: DataFrame, changes: DataFrame, path: str) -> int:
    """Brings the index to docs (chunk_id, text) by changes (doc_id, status of
    incremental_diff): added and changed documents become a segment, changed and removed
    ones are marked dead, and their terms are taken off the counts. Nothing else is
    rewritten."""
    spark = docs.sparkSession
    status = written(changes.select(F.col("doc_id").alias("chunk_id"), "status").where("status != 'same'"))
    gone = status.where("status in ('changed', 'removed')").select("chunk_id")
    alive = _alive(spark, path, spark.read.parquet(f"{path}/docs"))
    dead = cut(alive.join(gone, "chunk_id", "left_semi").select("cell", "doc", "dl", "terms"))
    segment = add_segment(docs.join(status.where("status in ('added', 'changed')"), "chunk_id", "left_semi"), path)
    buckets = _segments(spark, path).agg(F.max("buckets")).first()[0]
    dead.select("cell", "doc").write.mode("overwrite").parquet(f"{path}/dead/segment={segment}")
    fewer = dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"), F.array().cast("array<int>").alias("held_in"))
    _write_terms(fewer, path, segment, buckets, "dead")
    less = dead.agg(F.lit(segment).alias("segment"), F.lit(buckets).alias("buckets"), (-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).cast("long").alias("tokens"))
    less.write.mode("append").parquet(f"{path}/stats")
    return segment


def _dead(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/dead").select("cell", "doc")
    except AnalysisException:
        return None


def _alive(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    dead = _dead(spark, path)
    return rows if dead is None else rows.join(dead.select("doc"), "doc", "left_anti")


def _impact(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))


def read_blocks(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The blocks of terms (column term): of up to FILTER_TERMS, only their buckets are
    opened and row groups skipped; the rows are the terms' blocks in any case."""
    blocks = spark.read.schema(f"{_BLOCKS}, segment int").parquet(f"{path}/blocks")
    asked = terms.select("term").distinct()
    if len(asked.limit(FILTER_TERMS + 1).collect()) > FILTER_TERMS:
        return blocks.join(asked, "term", "left_semi")
    # A row for each segment and term, in files by hash of the term; SPREAD buckets at most.
    known = _terms(spark, path).join(asked, "term").groupBy("term").agg(F.array_distinct(F.flatten(F.collect_set("held_in"))).alias("held_in")).collect()
    wanted = sorted({bucket for r in known for bucket in r["held_in"]})
    return blocks.where(F.col("bucket").isin(wanted) & F.col("term").isin([r["term"] for r in known]))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank: as bm25_topk over the documents of the index."""
    _, by_cell = _prepared(spark, path, queries, k, k1, b)
    found = by_cell(_scores)
    scores = found.select("query_id", "doc", F.round("score", 4).alias("score")).where("score > 0")
    # Ties at the last place stay until ids decide.
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    top = scores.withColumn("place", place).where(F.col("place") <= k).drop("place")
    hits = top.join(spark.read.parquet(f"{path}/docs").select("doc", "chunk_id"), "doc").select("query_id", "chunk_id", "score")
    return ranked(hits, k)


def pruning(spark: SparkSession, path: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, blocks (of its terms), decoded (of them, to find its hits)."""
    heads, by_cell = _prepared(spark, path, queries, k, 1.5, 0.75)
    every = heads.groupBy("query_id").agg(F.count("*").alias("blocks"))
    decoded = by_cell(_decoded).groupBy("query_id").agg(F.sum("decoded").alias("decoded"))
    return every.join(decoded, "query_id", "left").na.fill(0)


def _small(df: DataFrame) -> DataFrame:
    """Rows that are kept, broadcast where they are few."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def _prepared(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float, b: float):
    """The queries' blocks (without postings), and a function that runs another by cell."""
    n, tokens = _segments(spark, path).agg(F.sum("n"), F.sum("tokens")).first()
    avgdl = max(tokens / max(n, 1), 1e-9)
    asked = queries.select("query_id", F.explode(T.code_tokens(F.coalesce("text", F.lit("")))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    df = _terms(spark, path).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weights = _small(asked.join(df.where("df > 0"), "term").select("query_id", "term", (F.col("qf") * idf(F.lit(n), F.col("df"))).alias("w")))
    blocks = read_blocks(spark, path, weights)
    bound = F.col("w") * _impact(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b)
    heads = blocks.select("term", "first", "max_tf", "min_dl").join(weights, "term").select("query_id", "term", "first", "w", bound.alias("bound"))
    postings = F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")
    doc, part = (F.col("first") + F.col("p.docs")).alias("doc"), F.col("w") * _impact(F.col("p.tfs"), F.col("p.dls"), avgdl, k1, b)
    # 1. The threshold.
    best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "term", "first")
    seeds = _small(heads.withColumn("i", F.row_number().over(best)).where(F.col("i") <= SEEDS).select("query_id", "term", "first", "w"))
    bodies = blocks.select("term", "first", "docs", "tfs", "dls")
    partial = bodies.join(seeds, ["term", "first"]).select("query_id", "w", "first", postings).select("query_id", doc, part.alias("part"))
    partial = _alive(spark, path, partial.groupBy("query_id", "doc").agg(F.sum("part").alias("part")))
    kth = Window.partitionBy("query_id").orderBy(F.col("part").desc(), "doc")
    first = partial.withColumn("i", F.row_number().over(kth)).where(F.col("i") <= 2 * k).select("query_id", "doc")
    wanted = _small(first.join(weights, "query_id"))
    whole = bodies.select("term", "first", postings).select("term", doc, "p").join(wanted, ["term", "doc"])
    whole = whole.groupBy("query_id", "doc").agg(F.sum(part).alias("part"))
    least = whole.withColumn("i", F.row_number().over(kth)).where(F.col("i") == k).select("query_id", (F.col("part") - SLACK).alias("least"))
    # 2. Terms by rising bound: those before the sum reaches the threshold are left aside.
    terms = heads.groupBy("query_id", "term").agg(F.max("w").alias("w"), F.max("bound").alias("top")).join(least, "query_id", "left").na.fill(0.0, ["least"])
    upto = Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("query_id")
    terms = terms.withColumns({"aside": F.sum("top").over(upto) < F.col("least"), "all": F.sum("top").over(every)})
    terms = cut(terms.withColumn("rest", F.sum(F.when(F.col("aside"), F.col("top")).otherwise(0.0)).over(every)))

    def by_cell(work) -> DataFrame:
        kind = queries.schema["query_id"].dataType
        packed = blocks.select("cell", "term", "first", "last", "max_tf", "min_dl", "docs", "tfs", "dls")
        dead = _dead(spark, path)
        if dead is not None:
            packed = packed.unionByName(dead.select("cell", F.col("doc").alias("first")), allowMissingColumns=True)
        # A row for each CHUNK_TOKENS tokens of documents.
        cells = F.broadcast(blocks.select(F.col("cell").alias("of")).distinct())
        sent = terms.crossJoin(cells)
        run, schema = work(to_arrow_type(kind), k, avgdl, k1, b)
        return packed.groupBy("cell").cogroup(sent.groupBy("of")).applyInArrow(run, f"query_id {kind.simpleString()}, {schema}")

    return heads, by_cell


def _judged(packed: pa.Table, sent: pa.Table, avgdl: float, k1: float, b: float):
    """Of each query (its first row in sent): how many blocks were decoded for it, its
    candidates' places in the cell and their scores."""
    dead = packed.filter(packed["term"].is_null())["first"].to_numpy()
    packed = packed.filter(packed["term"].is_valid()).sort_by([("term", "ascending"), ("first", "ascending")]).combine_chunks()
    if not len(packed) or not len(sent):
        return
    base, column = packed["cell"][0].as_py(), lambda c: packed[c].to_numpy()
    impact = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    sizes = packed["docs"].combine_chunks().value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    first, last = column("first") - base, column("last") - base
    place = np.repeat(first, sizes) + packed["docs"].combine_chunks().flatten().to_numpy()
    parts = impact(packed["tfs"].combine_chunks().flatten().to_numpy(), packed["dls"].combine_chunks().flatten().to_numpy())
    highest = impact(column("max_tf"), column("min_dl"))
    alive = np.ones(int(last.max()) + 1, bool)
    alive[(dead - base)[dead - base < len(alive)]] = False
    names = packed["term"].to_numpy()
    begins = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    blocks_of = dict(zip(names[begins], zip(begins, np.r_[begins[1:], len(names)], strict=True), strict=True))
    by_query: dict = {}
    for i, q in enumerate(sent["query_id"].to_pylist()):
        by_query.setdefault(q, []).append(i)
    asked, w, top, aside, every, least, rest = (sent[c].to_pylist() for c in ("term", "w", "top", "aside", "all", "least", "rest"))

    def add(scores: np.ndarray, chosen: np.ndarray, weight: float) -> None:
        # A document stands once in a term's postings.
        many = sizes[chosen]
        at = np.repeat(ends[chosen] - np.cumsum(many), many) + np.arange(many.sum())
        scores[place[at]] += weight * parts[at]

    for rows in by_query.values():
        limit, over, decoded = least[rows[0]], rest[rows[0]], 0
        scores = np.zeros(len(alive))
        held = [(i, np.arange(*blocks_of[asked[i]])) for i in rows if asked[i] in blocks_of]
        for i, of in held:
            if not aside[i]:
                of = of[every[i] - top[i] + w[i] * highest[of] >= limit]
                decoded += len(of)
                add(scores, of, w[i])
        found = np.flatnonzero((scores > 0) & (scores + over >= limit) & alive)
        before = np.r_[scores[found], -np.inf]
        for i, of in held:
            if aside[i] and len(found):
                # The best candidate within each block's numbers.
                low, high = np.searchsorted(found, first[of]), np.searchsorted(found, last[of], "right")
                of, low, high = of[low < high], low[low < high], high[low < high]
                if len(of):
                    most = np.maximum.reduceat(before, np.c_[low, high].ravel())[::2]
                    of = of[most + over - top[i] + w[i] * highest[of] >= limit]
                    decoded += len(of)
                    add(scores, of, w[i])
        yield rows[0], decoded, base + found, scores[found]


def _scores(q_type: pa.DataType, k: int, avgdl: float, k1: float, b: float):
    """A cell's best k of each query, with all that may tie with the last."""

    def run(packed: pa.Table, sent: pa.Table) -> pa.Table:
        rows, docs, scores = [], [], []
        for row, _, found, score in _judged(packed, sent, avgdl, k1, b):
            if len(score) > k:
                near = score >= np.partition(score, -k)[-k] - 2 * SLACK
                found, score = found[near], score[near]
            rows.append(np.full(len(found), row))
            docs.append(found)
            scores.append(score)
        joined = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        ids = sent["query_id"].cast(q_type).take(pa.array(joined(rows, np.int64)))
        return pa.table({"query_id": ids, "doc": joined(docs, np.int64), "score": joined(scores, np.float64)})

    return run, "doc long, score double"


def _decoded(q_type: pa.DataType, k: int, avgdl: float, k1: float, b: float):
    """The blocks that a cell decodes for each query."""

    def run(packed: pa.Table, sent: pa.Table) -> pa.Table:
        counted = [(row, decoded) for row, decoded, _, _ in _judged(packed, sent, avgdl, k1, b)]
        ids = sent["query_id"].cast(q_type).take(pa.array([row for row, _ in counted], pa.int64()))
        return pa.table({"query_id": ids, "decoded": pa.array([decoded for _, decoded in counted], pa.int64())})

    return run, "decoded long"
