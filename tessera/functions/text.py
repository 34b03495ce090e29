"""Scalar text functions as Column expressions.

Every function takes and returns Columns and runs inside the JVM. `\\s` in the
patterns is Unicode-aware (`(?U)`) and `(?d)` makes `\\n` the only line end, so that
results don't depend on the platform. Repeats that can't give back are possessive, and
runs are entered at their first character only: a text takes time near linear in its
length, and no match needs a stack that grows with it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running

# Token, sentence, boilerplate and guard patterns, and word lists.
CODE_TOKEN = r"([a-z0-9]++(?:[-_/][a-z0-9]++)*+)"
PLAIN_TOKEN = r"([a-z0-9]++)"
# White space is looked for first: it is rarer than what may stand before it.
SENTENCE_END = r"(?U)\s(?<=[.!?]\s)\s*+(?=[A-Z0-9#|\-])"
LOOSE_SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
PRODUCT_CODE = r"(?<![A-Z])([A-Z]{2,}+-\d+)"
BOILERPLATE = r"(?i)(page \d+ of \d+|confidential — internal|draft v\d+)"
SCAFFOLD_HEADING = r"(?id)^#{1,3}\s+(why this document exists|relational note)\b.*$"
ANY_HEADING = r"^#{1,3}\s+"
TEST_QUERY_LINE = r"(?imd)^test query:.*$"
META_SENTENCE = r"(?iU)(?:(?<!\s)\s++)?This row-level fact tests table-aware parsing and parent-child chunking( \([^)]*\))?\.?\s*"
# What a match of a pattern holds in lower case. Letters that have other forms in Unicode
# (s, k, i) are left out where the pattern takes those forms.
BOILERPLATE_PARTS = ("page ", "confidential", "draft v")
TEST_QUERY_PARTS = ("test query:",)
META_PARTS = ("row-level fact te",)
TABLE_ROW = r"(?md)^\|.*\|$"
FIGURE = r"Figure\s+F-\d+|Fig\.\s*\d+"
# `\G` lets an address begin where the one before ended.
EMAIL = r"(?:\G|(?<![a-zA-Z0-9_.+-]))[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+\d[\d\s\-()]{7,}\d"
PHONE_NATIONAL = r"(?:\(\d{3}\)\s*|\b\d{3}[-.])\d{3}[-.]\d{4}\b"
INJECTION = r"(?i)(ignore (all )?previous instructions|system prompt|jailbreak|DAN mode|exfiltrate|reveal your prompt)"
CLOSING_TAG = r"(?i)</\s*(retrieved-context|context|system|instruction)\s*>"
PRONOUN = r"\b(it|its|they|them|their|this|that|these|those|he|she|him|her)\b"
ABSTENTION = (
    r"(?i)(i don'?t have|no information|(do|does) not (contain|mention|state|have)|not (found|present|contained|mentioned)"
    r"|cannot answer|unable to answer|isn'?t (in|covered)|lack\w* (information|context))"
)
CITED_KINDS = ("md", "txt", "pdf", "docx", "html")
CITATION = r"\[([^\]]+\.(?:md|txt|pdf|docx|html))\]"
NEGATIONS = ("not", "never", "no", "n't", "without", "fails", "failed", "against", "none")
EMBEDDING_SIZE = 384
#: Unicode's white space, as `(?U)\s` takes it.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def held(x: Column, *parts: str) -> Column:
    """Whether x, in lower case, holds one of the parts: cheaper than a pattern that
    is tried at every character."""
    low = F.lower(x)
    return reduce(or_, (F.contains(low, F.lit(part)) for part in parts))


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def code_tokens(x: Column) -> Column:
    """Lower-cased tokens; codes such as ab-12 stay whole."""
    return F.regexp_extract_all(F.lower(x), F.lit(CODE_TOKEN), F.lit(1))


def plain_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(PLAIN_TOKEN), F.lit(1))


def product_codes(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(x), F.lit(PRODUCT_CODE), F.lit(1)))


def estimated_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def sentences(x: Column) -> Column:
    """Sentences; a text without any is one sentence."""
    whole = strip(x)
    parts = F.filter(F.transform(F.split(whole, SENTENCE_END, -1), strip), lambda s: F.length(s) > 0)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(whole))


def loose_sentences(x: Column) -> Column:
    return F.split(x, LOOSE_SENTENCE_END, -1)


def is_table_block(x: Column) -> Column:
    rows = F.size(F.filter(F.split(x, "\n", -1), lambda s: F.startswith(strip(s), F.lit("|"))))
    return F.when(F.contains(x, F.lit("|")), rows >= 2).otherwise(x.isNull() & F.lit(None).cast("boolean"))


def table_rows(x: Column) -> Column:
    return F.regexp_count(x, F.lit(TABLE_ROW))


def has_figure(x: Column) -> Column:
    return x.rlike(FIGURE)


def content_hash(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def embedding_bucket(token: Column, size: int = EMBEDDING_SIZE) -> Column:
    """The token's 128-bit MD5 modulo `size`, one 32-bit word after another."""
    digest = F.md5(token.cast("binary"))
    carry = (1 << 32) % size
    out = F.lit(0).cast("long")
    for i in range(4):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * carry + word) % size
    return out.cast("int")


def redact(x: Column) -> Column:
    """[text, findings]: personal data replaced, and label:count of each pass that hit.
    Each pass takes up the text of the one before, and only texts that may have a match
    are searched."""
    passes = (
        (EMAIL, "EMAIL", lambda t: F.contains(t, F.lit("@"))),
        (PHONE, "PHONE", lambda t: F.contains(t, F.lit("+"))),
        (PHONE_NATIONAL, "PHONE", lambda t: t.rlike(r"\d{3}[-.]\d{4}")),
    )

    def step(pattern: str, label: str, may):
        def of(acc: Column) -> Column:
            n = F.when(may(acc["text"]), F.regexp_count(acc["text"], F.lit(pattern))).otherwise(0)

            def replaced(count: Column) -> Column:
                hit = count > 0
                more = F.array(F.concat(F.lit(f"{label}:"), count.cast("string")))
                return F.struct(
                    F.when(hit, F.regexp_replace(acc["text"], pattern, f"[REDACTED:{label}]")).otherwise(acc["text"]).alias("text"),
                    F.when(hit, F.concat(acc["findings"], more)).otherwise(acc["findings"]).alias("findings"),
                )

            return let(n, replaced)

        return of

    out = F.struct(x.alias("text"), F.array().cast("array<string>").alias("findings"))
    for one in passes:
        out = let(out, step(*one))
    return out


def injection_flag(x: Column) -> Column:
    return x.rlike(INJECTION)


def escape_tags(x: Column) -> Column:
    return F.regexp_replace(x, CLOSING_TAG, "[escaped-tag]")


def safe_doc_id(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("?")), r"[<>\r\n]", ""), 1, 120)


def needs_history(x: Column) -> Column:
    """Whether a question leans on earlier turns: a pronoun, or four words or fewer."""
    return F.lower(x).rlike(PRONOUN) | (F.size(plain_tokens(x)) <= 4)


def abstains(answer: Column) -> Column:
    first = F.get(F.split(strip(answer), "\n", -1), F.lit(0))
    return F.substring(first, 1, 300).rlike(ABSTENTION)


def doc_of(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, "#", 1)


def canonical_name(x: Column) -> Column:
    """Products and components in one spelling; others only tidied."""
    name = F.regexp_replace(collapse(x), r"^[.,;:]++|(?<![.,;:])[.,;:]++$", "")
    code = F.upper(F.regexp_extract(name, r"(?i)^(?:component\s+)?([a-z]{1,3}-?\d+)$", 1))
    letter = F.upper(F.regexp_extract(name, r"(?i)^product\s+([a-z])$", 1))
    return (
        F.when(letter != "", F.concat(F.lit("Product "), letter))
        .when(code != "", F.concat(F.lit("Component "), code))
        .otherwise(name)
    )


def oriented(s: Column, r: Column, o: Column) -> Column:
    """[s, r, o] with two directions put right: components don't supply others, and
    nothing but a component is supplied by a component's supplier."""
    left, right = F.startswith(s, F.lit("Component ")), F.startswith(o, F.lit("Component "))
    supplies = (r == "supplies") & left & ~right
    supplied = (r == "supplied_by") & ~left & right
    return F.struct(
        F.when(supplies | supplied, o).otherwise(s).alias("s"),
        F.when(supplies, F.lit("uses")).otherwise(r).alias("r"),
        F.when(supplies | supplied, s).otherwise(o).alias("o"),
    )


def client_address(forwarded: Column, socket: Column, trusted_hops: int) -> Column:
    """The address that the outermost trusted proxy saw; the socket's without proxies."""
    if trusted_hops <= 0:
        return F.coalesce(socket, F.lit("?"))
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), strip), lambda p: F.length(p) > 0)
    return F.coalesce(F.try_element_at(parts, F.lit(-trusted_hops)), socket, F.lit("?"))


def word_pieces(x: Column, words: int = 8) -> Column:
    """The text in pieces of so many words, each with a space at its end."""
    parts = F.split(x, " ", -1)
    starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(words))
    return F.transform(starts, lambda i: F.concat(F.array_join(F.slice(parts, i + 1, words), " "), F.lit(" ")))


def answer_key(query: Column, top_k: Column, use_agent: Column, use_graph: Column, index_version: Column) -> Column:
    """A key of everything that an answer depends on."""
    parts = F.concat_ws("|", F.lower(strip(query)), top_k, use_agent, use_graph, index_version)
    return F.sha2(parts.cast("binary"), 256)


def without_scaffold(x: Column) -> Column:
    """[text, dropped]: no lines from a scaffold heading to the next heading. The last
    heading up to a line decides, by running totals."""

    def of(lines: Column) -> Column:
        # 1 for a scaffold heading, 0 for another, null for other lines.
        kind = lambda s: F.when(s.rlike(ANY_HEADING), s.rlike(SCAFFOLD_HEADING).cast("int"))
        kinds = F.transform(lines, lambda line: kind(strip(line)))
        last = running(kinds, F.lit(0), lambda a, b: F.coalesce(b, a))

        def split(skipping: Column) -> Column:
            kept = F.filter(lines, lambda _, i: F.get(skipping, i + 1) == 0)
            return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("dropped"))

        return let(last, split)

    return let(F.split(x, "\n", -1), of)


def normalised_lines(x: Column) -> Column:
    """Line ends and tabs made plain; blanks collapsed, in table rows at the ends too."""
    plain = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" "))

    def tidy(line: Column) -> Column:
        # A single space stays as it is.
        other = F.rtrim(F.regexp_replace(line, "[ \u00a0]{2,}|\u00a0", " "), F.lit(WHITE))
        return F.when(F.startswith(strip(line), F.lit("|")), collapse(line)).otherwise(other)

    joined = F.array_join(F.transform(F.split(plain, "\n", -1), tidy), "\n")
    return F.regexp_replace(joined, "\n{3,}", "\n\n")
