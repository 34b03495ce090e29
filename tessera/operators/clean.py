"""Cleaning of raw documents, with a report of what went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and others. Adds report; text is the clean one."""
    staged = docs.withColumn("_s", T.without_scaffold(F.coalesce("text", F.lit(""))))
    staged = staged.withColumn("_a", F.col("_s.text"))
    # Only texts that hold a pattern's fixed part are searched by it.
    asked, meta = T.held(F.col("_a"), *T.TEST_QUERY_PARTS), T.held(F.col("_b"), *T.META_PARTS)
    staged = staged.withColumn("_b", F.when(asked, F.regexp_replace("_a", T.TEST_QUERY_LINE, "")).otherwise(F.col("_a")))
    staged = staged.withColumn("_l", T.normalised_lines(F.when(meta, F.regexp_replace("_b", T.META_SENTENCE, " ")).otherwise(F.col("_b"))))
    lines = F.when(T.held(F.col("_l"), *T.BOILERPLATE_PARTS), F.regexp_replace("_l", T.BOILERPLATE, "")).otherwise(F.col("_l"))
    staged = staged.withColumn("_c", T.strip(lines))
    before, after = F.length(F.coalesce("text", F.lit(""))), F.length("_c")
    report = F.struct(
        before.alias("chars_in"),
        F.col("_s.dropped").alias("scaffold_sections_dropped"),
        F.when(asked, F.regexp_count("_a", F.lit(T.TEST_QUERY_LINE))).otherwise(0).alias("test_query_lines_dropped"),
        F.when(meta, F.regexp_count("_b", F.lit(T.META_SENTENCE))).otherwise(0).alias("meta_sentences_dropped"),
        after.alias("chars_out"),
        F.round(100 * (1 - after / F.greatest(before, F.lit(1))), 1).alias("reduction_pct"),
    )
    return staged.withColumns({"report": report, "text": F.col("_c")}).drop("_s", "_a", "_b", "_l", "_c")


def annotate(chunks: DataFrame) -> DataFrame:
    """Adds has_table, table_rows and has_figure_ref."""
    text = F.coalesce("text", F.lit(""))
    rows = T.table_rows(text)
    return chunks.withColumns({"has_table": rows >= 2, "table_rows": rows, "has_figure_ref": T.has_figure(text)})


def leak_report(chunks: DataFrame, phrases: list[str]) -> DataFrame:
    """chunk_id and phrase of every watched phrase that a chunk holds."""
    watched = F.array(*(F.lit(p.lower()) for p in phrases))
    hits = F.filter(watched, lambda p: F.contains(F.lower("text"), p))
    return chunks.select("chunk_id", F.explode(hits).alias("phrase"))
