"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and its histogram of common words
are compared with references of its language by Jensen-Shannon distance (base-2
logarithms, from 0 to 1). References are the summed histograms of all documents
of the language that pass the base rules; each document counts with shares, so
no long document rules. Languages outside the configured ones share one
reference, so there never are more than a handful. Texts below `min_chars`
characters are not judged by characters, those below `min_words` words not by
words.

The base rules are n_words < 10 and repeated five-word windows over 20 %.

Defined cases: a null or empty text has no words and fails; a null language is
an other one; repeated rows count each, and are judged alike; a distance equal to its
limit passes; ids may have any type and be null, as a stage judges rows by text and
language; very long texts count in linear time and, with shares, for one document;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import write_table

# Very common words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "at", "by", "this", "an", "or", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "au", "sur", "avec", "il", "ce"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"),
}
#: Character classes, counted by pattern; what is in none of them is `other`.
CLASSES = (
    ("lower", "[a-z]"),
    ("upper", "[A-Z]"),
    ("digit", "[0-9]"),
    ("space", r"[\x20\x09-\x0D]"),
    ("stop", r"[.,;:!?'\"()-]"),
    ("symbol", r"[\x21-\x7E&&[^a-zA-Z0-9.,;:!?'\"()-]]"),
)
_WORD = r"[^\x20\x09-\x0D]+"

MIN_CHARS = 600
MIN_WORDS = 80
MAX_CHAR_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.32


def repeated_words(words: Column) -> Column:
    """Words in five-word windows found twice or more in the array."""
    n = F.size(words)
    grams = F.when(
        n >= 5,
        F.transform(
            F.sequence(F.lit(0), n - 5),
            lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return grams


def _covered(grams: Column) -> Column:
    """The windows' hashes to the number of words under repeated ones: places in
    order of hash, those beside an equal hash kept, in order of place; each covers
    five words, or up to the next."""
    placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(all_: Column) -> Column:
        return F.filter(
            all_,
            lambda x, k: (F.get(all_, k - 1)["h"] == x["h"]) | (F.get(all_, k + 1)["h"] == x["h"]),
        )

    def total(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-10).cast("int").alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    # let-bindings by one-element arrays, so that nothing is computed twice
    bound = F.transform(F.array(placed), twice)
    places = F.transform(bound, lambda a: F.array_sort(F.transform(a, lambda x: x["i"])))
    return F.element_at(F.transform(places, total), 1)


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base measures, with the words and the windows as arrays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(
        F.col("doc_id"),
        F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"),
    )
    grams = words.withColumn("grams", repeated_words(F.col("words")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD))
    bound = grams.withColumn("lines", lines)
    return bound


def _counts(docs: DataFrame, languages: dict) -> DataFrame:
    bound = base_features(docs)
    lang = F.when(F.col("lang").isin(*languages), F.col("lang")).otherwise(F.lit("other"))
    lower = F.transform(F.col("words"), F.lower)
    every = sorted({w for own in languages.values() for w in own})
    common = F.filter(lower, lambda w: w.isin(*every))
    counted = bound.withColumns({"lang": lang, "common": common})
    # How many of each common word: what taking it out leaves.
    size = F.size("common")
    histograms = {
        code: F.array(*(size - F.size(F.array_remove("common", w)) for w in own)) for code, own in languages.items()
    }
    word_counts = F.coalesce(
        *(F.when(F.col("lang") == code, h) for code, h in histograms.items()),
        histograms[next(iter(languages))],
    )
    # A class' characters are what taking out its runs leaves away. The lower letters go
    # first: the other classes, which share none with them, are counted in the rest.
    without = lambda x, p: F.regexp_replace(x, p + "+", "")
    counted = counted.withColumn("rest", without(F.col("text"), CLASSES[0][1]))
    in_rest = lambda p: F.length("rest") - F.length(without(F.col("rest"), p))
    chars = [F.length(F.make_valid_utf8("text")) - F.length("rest"), *(in_rest(p) for _, p in CLASSES[1:])]
    return counted.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        in_rest(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) == F.size("grams"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("grams")))
        .alias("n_repeat_words"),
        F.array(*chars).alias("chars"),
        word_counts.alias("common"),
    )


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, b: a + b)


def _shares(counts: Column, total: Column) -> Column:
    """Shares of each count and of the rest of the total."""
    parts = F.concat(F.transform(counts, lambda c: c.cast("double")), F.array(total - _sum(counts)))
    return F.when(total > 0, F.transform(parts, lambda c: c / total))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms of shares: the root of the base-2 divergence."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))) / 2))


def judge(
    docs: DataFrame,
    languages: dict = COMMON,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang): measures, distances, kept."""
    counted = _counts(docs, languages)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    shared = counted.withColumns(
        {
            "base_failed": failed,
            "chars": _shares(F.col("chars"), F.col("n_chars").cast("double")),
            "common": _shares(F.col("common"), F.col("n_words").cast("double")),
        }
    )
    shared = write_table(shared, "quality")
    width = len(CLASSES) + 1
    common_width = len(next(iter(languages.values()))) + 1
    sound = shared.where(~F.col("base_failed"))
    means = sound.groupBy("lang").agg(
        F.array(*(F.avg(F.get("chars", F.lit(i))) for i in range(width))).alias("char_reference"),
        F.array(*(F.avg(F.get("common", F.lit(i))) for i in range(common_width))).alias("word_reference"),
    )
    # A row for each configured language and one for the rest: a proven bound.
    judged = shared.join(F.broadcast(means.limit(len(languages) + 1)), "lang", "left")
    distance = {
        "char_distance": F.when(F.col("n_chars") >= min_chars, jensen_shannon(F.col("chars"), F.col("char_reference"))),
        "word_distance": F.when(F.col("n_words") >= min_words, jensen_shannon(F.col("common"), F.col("word_reference"))),
    }
    judged = judged.withColumns(distance)
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance
    )
    return judged.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "char_distance",
        "word_distance",
        (~F.col("base_failed") & fits).alias("kept"),
    )


def keep_sound(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that fail, each by its own text and language."""
    digest = F.sha2(F.concat(F.coalesce("lang", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"), 256)
    # The id rides along so that copies, which have one digest, don't meet in one task.
    judged = judge(docs.select(F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("doc_id"), "text", "lang"), **options)
    kept = judged.where("kept").select(F.col("doc_id.id").alias("sound"), F.col("doc_id.digest").alias("sound_digest")).distinct()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), digest.alias("digest"))
    same = F.col("id").eqNullSafe(F.col("sound")) & (F.col("digest") == F.col("sound_digest"))
    return keyed.join(kept, same, "left_semi").select("row.*")
