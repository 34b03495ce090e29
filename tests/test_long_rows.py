"""One adversarial row of a million characters through every text function, in seconds."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T

LONG = 1_000_000
ROWS = {
    "joined tokens": "a-" * (LONG // 2),
    "letters": "a" * LONG,
    "capitals": "A" * LONG,
    "letters before an at": "a" * LONG + "@",
    "addresses": "a@b.c_" * (LONG // 6),
    "digits": "1" * LONG,
    "phone": "+1" + " 2" * (LONG // 2),
    "blanks inside": "a" + " " * LONG + "b",
    "blanks": " " * LONG,
    "lines": "\n" * LONG,
    "dots": ". " * (LONG // 2),
    "pipes": "| a |\n" * (LONG // 6),
    "closing tags": "</" * (LONG // 2),
    "hashes": "# a\n" * (LONG // 4),
}
FUNCTIONS = {
    "strip": T.strip,
    "collapse": T.collapse,
    "code_tokens": lambda x: F.size(T.code_tokens(x)),
    "plain_tokens": lambda x: F.size(T.plain_tokens(x)),
    "product_codes": lambda x: F.size(T.product_codes(x)),
    "sentences": lambda x: F.size(T.sentences(x)),
    "loose_sentences": lambda x: F.size(T.loose_sentences(x)),
    "is_table_block": T.is_table_block,
    "table_rows": T.table_rows,
    "has_figure": T.has_figure,
    "redact": lambda x: F.length(T.redact(x)["text"]),
    "injection_flag": T.injection_flag,
    "escape_tags": lambda x: F.length(T.escape_tags(x)),
    "needs_history": T.needs_history,
    "abstains": T.abstains,
    "canonical_name": lambda x: F.length(T.canonical_name(x)),
    "normalised_lines": lambda x: F.length(T.normalised_lines(x)),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_time_is_linear(spark, name):
    df = spark.createDataFrame(list(ROWS.items()), "name string, text string").repartition(len(ROWS))
    begin = time.time()
    assert df.select("name", FUNCTIONS[name](F.col("text")).alias("out")).agg(F.count("out")).first()[0] == len(ROWS)
    assert time.time() - begin < 20


def test_patterns_find_what_they_found(spark):
    """Possessive and guarded patterns match as the plain ones."""
    plain = {
        "email": (T.EMAIL, r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
        "token": (T.CODE_TOKEN, r"([a-z0-9]+(?:[-_/][a-z0-9]+)*)"),
        "code": (T.PRODUCT_CODE, r"([A-Z]{2,}-\d+)"),
        "meta": (T.META_SENTENCE, r"(?iU)\s*This row-level fact tests table-aware parsing and parent-child chunking( \([^)]*\))?\.?\s*"),
    }
    texts = [
        "a@b.c_x@d.e, q@w.z+r@t.y a..b@c-.d@e.f x@y.z@v.w", "ab-12/c_d--e-f_ /g 7-", "AB-1XYZ-22A-3 -AB-4 ABC-D5", "",
        "one  This row-level fact tests table-aware parsing and parent-child chunking (x).  This row-level fact tests table-aware parsing and parent-child chunking two",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, (now, before) in plain.items():
        for r in df.select(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(c) for c, p in (("now", now), ("before", before)))).collect():
            assert r["now"] == r["before"], name
