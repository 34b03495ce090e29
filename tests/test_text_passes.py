"""Cheaper forms of text functions against the patterns that define them."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import clean

STRIP = r"(?U)^\s++|(?<!\s)\s++$"
ENDS = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9#|\-])"


def test_white_space_and_sentence_ends(spark):
    draw = random.Random(5)
    odd = list(T.WHITE) + list("\x1c\x1f᠎​﻿.!?A9#|-aé😀")
    texts = ["", " ", ". ", *(c for c in odd), *("".join(draw.choice(odd) for _ in range(draw.randint(1, 25))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for new, old in (
        (T.strip(t), F.regexp_replace(t, STRIP, "")),
        (F.split(t, T.SENTENCE_END, -1), F.split(t, ENDS, -1)),
        (F.rtrim(t, F.lit(T.WHITE)), F.regexp_replace(t, r"(?U)(?<!\s)\s++$", "")),
(F.regexp_replace(t, "[ \u00a0]{2,}|\u00a0", " "), F.regexp_replace(t, "[ \u00a0]+", " ")),
    ):
        assert df.where(~new.eqNullSafe(old)).count() == 0
    assert "regexp" not in df.select(T.strip(t))._jdf.queryExecution().toString().lower()


def test_other_forms_of_letters_are_cleaned(spark):
    """The pattern for the meta sentence takes ſ for s and K for k."""
    rows = [("a. Thiſ row-level fact teſtſ table-aware parſing and parent-child chunKing.\nPAGE 1 of 2 x\nTest QUERY: y", 1), ("Draft V2 left", 2), (None, 3), ("plain  text", 4)]
    got = clean.clean_documents(spark.createDataFrame(rows, "text string, doc_id int")).orderBy("doc_id").select("text", "report.meta_sentences_dropped", "report.test_query_lines_dropped").collect()
    assert [tuple(r) for r in got] == [("a.  x", 1, 1), ("left", 0, 0), ("", 0, 0), ("plain text", 0, 0)]


def test_only_texts_with_a_fixed_part_are_searched(spark):
    """Every pattern of the cleaning stands behind a look for its fixed part."""
    df = clean.clean_documents(spark.createDataFrame([("a", 1)], "text string, doc_id int"))
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("contains(lower(") >= 6
