"""Chunking: sentences packed into windows, structural blocks, parents and children.

Packing is one aggregate over a text's sentences with prefix sums of their
estimated tokens, so a document is chunked within its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let, running

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, text string, parent_id string, strategy string, "
    "token_est int, table_flag boolean, seq int, role string"
)
_RANGES = "array<struct<first:int,last:int,tokens:int>>"


def packed_ranges(tokens: Column, size: int, overlap: int) -> Column:
    """[first, last, tokens] of each window over sentences with so many tokens.

    A window is closed by the sentence that would lift it above `size`; the next
    one begins with its last sentences, as many whole ones as `overlap` holds.
    """

    def walk(p: Column) -> Column:
        start = F.struct(F.array().cast(_RANGES).alias("out"), F.lit(0).alias("first"), F.lit(0).alias("next"))

        def step(acc: Column, t: Column) -> Column:
            first, i = acc["first"], acc["next"]
            total = F.get(p, i) - F.get(p, first)
            full = (i > first) & (total + t > size)
            beyond = F.size(F.filter(F.slice(p, first + 1, i - first), lambda x: F.get(p, i) - x > overlap))
            window = F.struct(first.alias("first"), (i - 1).alias("last"), total.alias("tokens"))
            return F.struct(
                F.when(full, F.array_append(acc["out"], window)).otherwise(acc["out"]).alias("out"),
                F.when(full, first + beyond).otherwise(first).alias("first"),
                (i + 1).alias("next"),
            )

        def finish(acc: Column) -> Column:
            first, n = acc["first"], acc["next"]
            last = F.struct(first.alias("first"), (n - 1).alias("last"), (F.get(p, n) - F.get(p, first)).alias("tokens"))
            return F.array_append(acc["out"], last)

        return F.aggregate(tokens, start, step, finish)

    return let(running(tokens, F.lit(0)), walk)


def windows(text: Column, size: int, overlap: int) -> Column:
    """[text, tokens] of each window of a text."""

    def pack(own: Column) -> Column:
        ranges = packed_ranges(F.transform(own, T.estimated_tokens), size, overlap)
        return F.transform(
            ranges,
            lambda r: F.struct(
                F.array_join(F.slice(own, r["first"] + 1, r["last"] - r["first"] + 1), " ").alias("text"),
                r["tokens"].alias("tokens"),
            ),
        )

    flat = F.replace(text, F.lit("\n\n"), F.lit("\n"))
    return let(T.sentences(flat), pack)


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    base = {
        "chunk_id": F.lit(None),
        "doc_id": F.col("doc_id"),
        "text": F.col("c.text"),
        "parent_id": F.lit(None),
        "strategy": F.lit(None),
        "token_est": F.col("c.tokens"),
        "table_flag": F.lit(False),
        "seq": F.col("seq"),
        "role": F.lit(None),
    } | columns
    kinds = dict(part.split() for part in CHUNK_SCHEMA.split(", "))
    return df.select(*(base[name].cast(kind).alias(name) for name, kind in kinds.items()))


def _id(tag: str) -> Column:
    return F.concat(F.col("doc_id"), F.lit(f"#{tag}"), F.col("seq"))


def sliding_window(docs: DataFrame, size: int = 512, overlap: int = 80) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = docs.select("doc_id", F.posexplode(windows(F.col("text"), size, overlap)).alias("seq", "c"))
    return _rows(own, chunk_id=_id("s"), strategy=F.lit("sliding"))


def semantic(docs: DataFrame, size: int = 512) -> DataFrame:
    """Paragraphs gathered up to `size`; tables alone, oversize paragraphs windowed."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paragraphs = F.filter(
        F.transform(F.split("text", r"(?U)\n\s*\n", -1), T.strip), lambda p: F.length(p) > 0
    )
    block = "struct<text:string,tokens:int,flag:boolean>"
    start = F.struct(
        F.array().cast(f"array<{block}>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("tokens")
    )

    def flushed(acc: Column) -> Column:
        whole = F.struct(acc["held"].alias("text"), acc["tokens"].alias("tokens"), T.is_table_block(acc["held"]).alias("flag"))
        return F.when(acc["held"] != "", F.array_append(acc["out"], whole)).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        n = T.estimated_tokens(p)
        table, large = T.is_table_block(p), n > size
        over = (acc["tokens"] + n > size) & (acc["held"] != "")
        alone = F.array(F.struct(p.alias("text"), n.alias("tokens"), F.lit(True).alias("flag")))
        parts = F.transform(
            windows(p, size, 40), lambda w: F.struct(w["text"].alias("text"), w["tokens"].alias("tokens"), F.lit(False).alias("flag"))
        )
        closed = table | large | over
        out = F.when(closed, flushed(acc)).otherwise(acc["out"])
        out = F.when(table, F.concat(out, alone)).when(large, F.concat(out, parts)).otherwise(out)
        joined = F.when(closed | (acc["held"] == ""), p).otherwise(F.concat(acc["held"], F.lit("\n\n"), p))
        # Tokens are the sum over paragraphs, from the last block on.
        total = F.when(closed, n).otherwise(acc["tokens"] + n)
        return F.struct(
            out.alias("out"),
            F.when(table | large, F.lit("")).otherwise(joined).alias("held"),
            F.when(table | large, F.lit(0)).otherwise(total).alias("tokens"),
        )

    own = docs.select("doc_id", F.posexplode(F.aggregate(paragraphs, start, step, flushed)).alias("seq", "c"))
    return _rows(own, chunk_id=_id("m"), strategy=F.lit("semantic"), table_flag=F.col("c.flag"))


def parent_child(docs: DataFrame, parent_size: int = 1000, child_size: int = 220, overlap: int = 40) -> DataFrame:
    """Large windows as parents, small windows of each parent's text as children."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def row(parent, seq: Column, w: Column, role: str) -> Column:
        return F.struct(parent.cast("int").alias("parent"), seq.cast("int").alias("seq"), w["text"].alias("text"), w["tokens"].alias("tokens"), F.lit(role).alias("role"))

    # Parents are packed once, and children numbered through the document, within the row.
    def family(parents: Column) -> Column:
        top = F.transform(parents, lambda w, i: row(F.lit(None), i, w, "parent"))
        nested = F.flatten(
            F.transform(
                parents,
                lambda p, i: F.transform(
                    windows(p["text"], child_size, 30),
                    lambda w: F.struct(i.cast("int").alias("parent"), w["text"].alias("text"), w["tokens"].alias("tokens")),
                ),
            )
        )
        return F.concat(top, F.transform(nested, lambda w, i: row(w["parent"], i, w, "child")))

    own = docs.select("doc_id", F.explode(let(windows(F.col("text"), parent_size, overlap), family)).alias("c"))
    own = own.withColumn("seq", F.col("c.seq"))
    child = F.col("c.role") == "child"
    parent_id = F.concat(F.col("doc_id"), F.lit("#p"), F.col("c.parent"))
    return _rows(
        own,
        chunk_id=F.when(child, F.concat(parent_id, F.lit("c"), F.col("seq"))).otherwise(_id("p")),
        parent_id=F.when(child, parent_id),
        strategy=F.when(child, "parent_child").otherwise("parent_child_parent"),
        table_flag=child & T.is_table_block(F.col("c.text")),
        role=F.col("c.role"),
    )


def chunk_documents(docs: DataFrame, strategy: str = "sliding", size: int = 512, overlap: int = 80) -> DataFrame:
    if strategy == "semantic":
        return semantic(docs, size)
    if strategy == "parent_child":
        return parent_child(docs)
    return sliding_window(docs, size, overlap)


def consecutive_overlap(chunks: DataFrame) -> DataFrame:
    """chunk_id, overlap: words shared with the chunk before, by the smaller of both."""
    from pyspark.sql import Window

    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"(?U)\s+", -1), lambda w: w != ""))
    before = F.lag("words").over(Window.partitionBy("doc_id").orderBy("seq"))
    paired = chunks.select("chunk_id", "doc_id", "seq", words.alias("words")).withColumn("before", before)
    smaller = F.greatest(F.least(F.size("words"), F.size("before")), F.lit(1))
    return paired.where("before is not null").select(
        "chunk_id", "doc_id", (F.size(F.array_intersect("words", "before")) / smaller).alias("overlap")
    )
