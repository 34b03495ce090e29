"""Adversarial rows of a million characters through every operator on documents, in time
that grows with them, beside an ordinary row."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations, decontam, line_dedup, mixing, ngram_join, pii, quality_rules, secret_scan, substring_dedup

LONG = 1_000_000
ROWS = [
    "a-" * (LONG // 2), "a" * LONG, "A" * LONG, "a" * LONG + "@b.c", "a@" * (LONG // 2), "a@b.c " * (LONG // 6), "1" * LONG, "1." * (LONG // 2), "1 " * (LONG // 2), "+1 (" * (LONG // 4),
    " " * LONG, "\n" * LONG, "x\n" * (LONG // 2), "[" * LONG, "token=" * (LONG // 6), "AKIA" * (LONG // 4), "f0" * (LONG // 2), "password: '" * (LONG // 11), "a b " * (LONG // 4),
    "an ordinary text of some words, with a mail to someone@example.org in it.",
]

OPERATORS = {
    "quality": quality_rules.judge,
    "pii": pii.find_personal_data,
    "secrets": secret_scan.scan_and_report,
    "lines": line_dedup.report,
    "jaccard": lambda d: ngram_join.jaccard_components(d, 3, 90, 100),
    "mix": mixing.mix_sources,
    "substrings": substring_dedup.remove_repeats,
    "decontaminate": lambda d: d.select("doc_id").join(decontam.decontaminate(d, d.select(F.lit(1).cast("long").alias("item_id"), F.lit("w1 w2 w3 w4 w5 w6 w7 w8").alias("text")).limit(1)).select("doc_id"), "doc_id", "left"),
    "conversations": lambda d: conversations.repair(d.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_rows(spark, name):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(len(rows))
    begin = time.time()
    assert OPERATORS[name](docs).count() == len(rows)
    assert time.time() - begin < 120
