"""Language models as an interface: none is part of this library.

A model is a loader, called once a task, that gives reply(system, prompts) -> list of
replies. A loader or a call that raises gives no reply, and what needs none stands in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import answer, graph
from .lineage import cut

# The instructions that go with each kind of prompt.
ANSWERING = "Answer only from context, with citations."
REWRITING = (
    "Rewrite the user question for keyword + vector retrieval over enterprise docs. Expand entities (e.g. 'supplier of Product X' "
    "→ include likely component terms). Reply with ONLY the rewritten question, one line."
)
EXTRACTING = (
    "Extract entity relations as JSON list. Entities: products, components, suppliers. Relations: uses, supplied_by, supplies. "
    'Reply ONLY with JSON like [{"s":"Product X","r":"uses","o":"Component XK-7"}]. If none, reply [].'
)
TRIPLE_CHARS = 1500
MOST_TRIPLES = 20

Loader = Callable[[], Callable[[str, list[str]], list[str]]]


def replies(model: Loader, system: str, prompt: Column) -> Column:
    """The model's reply to each prompt, null where there is none."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            reply = model()
        except Exception:  # whatever a model's loader raises
            reply = None
        for prompts in batches:
            try:
                out = list(reply(system, prompts.tolist())) if reply else [None] * len(prompts)
            except Exception:  # or its client
                out = [None] * len(prompts)
            yield pd.Series(out, dtype=object)

    return ask(prompt)


def generate(queries: DataFrame, contexts: DataFrame, model: Loader | None = None, name: str = "model") -> DataFrame:
    """query_id, answer, method: the model's answer to the prompt of each question, or
    the extractive answer where it has none. As in build_prompts() and
    extractive_answers()."""
    quoted = answer.extractive_answers(queries, contexts)
    if model is None:
        return quoted.withColumn("method", F.lit("extractive"))
    asked = answer.build_prompts(queries, contexts).select("query_id", replies(model, ANSWERING, F.col("prompt")).alias("reply"))
    both = quoted.join(asked, "query_id", "left")
    good = F.coalesce(F.length(T.strip(F.col("reply"))) > 0, F.lit(False))
    return both.select(
        "query_id", F.when(good, F.col("reply")).otherwise(F.col("answer")).alias("answer"), F.when(good, name).otherwise("extractive").alias("method")
    )


def streamed(answers: DataFrame, words: int = 8) -> DataFrame:
    """query_id, piece, text: answers in pieces of a few words, as they are sent."""
    return answers.select("query_id", F.posexplode(T.word_pieces(F.col("answer"), words)).alias("piece", "text"))


def rewritten(queries: DataFrame, model: Loader) -> DataFrame:
    """query_id, reply: the first line of the model's rewriting; null where it has none."""
    first = F.get(F.split(T.strip(replies(model, REWRITING, F.col("text"))), "\n", -1), F.lit(0))
    return queries.select("query_id", F.nullif(first, F.lit("")).alias("reply"))


def extract_triples(chunks: DataFrame, model: Loader, most: int = MOST_TRIPLES, lot: int = 2 * MOST_TRIPLES) -> DataFrame:
    """Triples that a model reads from chunks that hint at a relation, in order of
    chunk ids. A chunk is read while fewer than `most` triples came before it: the model
    is asked for the first `lot` chunks, then for twice as many, and so on, until it has
    given enough."""
    hinting = graph.model_candidates(chunks).where("chunk_id is not null").select("chunk_id", F.substring("text", 1, TRIPLE_CHARS).alias("text"))
    out, last, held = None, None, 0
    while out is None or held < most:
        rest = hinting if last is None else hinting.where(F.col("chunk_id") > F.lit(last))
        asked = cut(rest.orderBy("chunk_id").limit(lot))
        count, last = asked.agg(F.count("*"), F.max("chunk_id")).first()
        got = cut(graph.parse_model_triples(asked.repartition("chunk_id").select("chunk_id", replies(model, EXTRACTING, F.col("text")).alias("reply"))))
        held += got.count()
        out = got if out is None else out.unionByName(got)
        if count < lot:
            break
        lot *= 2
    return first_triples(out, most)


def first_triples(triples: DataFrame, most: int = MOST_TRIPLES) -> DataFrame:
    """The triples of chunks by id, up to the chunk with which `most` is reached."""
    counts = triples.groupBy("chunk_id").agg(F.count("*").alias("n")).orderBy("chunk_id").limit(most)
    # A chunk has one triple at least, so the first `most` chunks decide; they are few.
    earlier = counts.alias("a").join(counts.alias("b"), F.col("b.chunk_id") < F.col("a.chunk_id"), "left")
    before = earlier.groupBy("a.chunk_id").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return triples.join(before.where(F.col("before") < most).select("chunk_id"), "chunk_id", "left_semi").select("s", "r", "o", "chunk_id")
