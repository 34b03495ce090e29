"""Line deduplication across documents by deletion neighbourhoods, in DataFrame
functions alone.

Lines part at `\n`; a line is its sequence of words, and the edit bound is one
word put in, left out or exchanged. With `words_per_edit` it grows with the line:
one word for each so many of the shorter line's, at least one. Lines with fewer
than `min_words` words are never dropped. Those with fewer than `near_words` go only
as exact repeats: an edit is to be a fifth of the words at most. Of equal or near
lines the earliest stays, by document id, digest of the text, and number of the
line; a line is dropped if an earlier one is within the bound of it.

1. Lines with equal words (by 128 bits of hash) are grouped; all but the first go.
2. Two lines within the bound agree in their first words or in their last, as many
   as nearly half of the shorter. Distinct lines whose beginning and end nobody
   shares can't have a partner and need no variants.
3. Each other line emits, hashed, itself and every variant with one word deleted.
   Variants deleted at the same place and equal otherwise are one exchange apart;
   a variant equal to a whole line is one word longer. The least place of each
   group is an aggregate, so a variant that very many lines share is no task of
   its own, and no pairs within a group are made.
4. Each line and the earliest line it meets are compared word for word.
5. Bounds of d > 1 edits: cut into d + 1 runs, the shorter line has one that no
   edit touches. Lines emit the least hash of the short runs in every window of
   such a length, so lines within the bound have one in common. A line is first
   compared to the earliest line of each of its hashes; what that leaves, to all
   earlier ones, by the edit distance over words.

The hash of a sequence is the exclusive or of 64-bit hashes of its words and their
places, so that a variant's follows from running totals, and a line's variants take
time in proportion to its words. Of a variant's lines only the earliest is compared:
two of them that differ though their 64 bits agree could hide a third.

Defined cases: null and empty texts have no lines to drop; rows with equal id and
text are one document and treated alike; null ids come first; very long texts and
lines take time near proportional to their length; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let, running

from .storage import cut, write_table

MIN_WORDS = 1
NEAR_WORDS = 5
_WORD = r"[^\x20\x09-\x0D]+"
_DOC = ("doc_id", "digest")
_PLACE = ("doc_id", "digest", "line")


def _digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that has words: doc_id, digest, line, words."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "content")
    lines = docs.select("doc_id", _digest().alias("digest"), split)
    return lines.select(*_PLACE, F.regexp_extract_all("content", F.lit(_WORD), F.lit(0)).alias("words"))


def _near_half(n: Column) -> Column:
    """Up to half of n, rounded down so that few lengths differ from their neighbours."""
    half = F.shiftright(n, 1)
    return half - half % F.greatest(F.shiftright(half, 3), F.lit(1))


def _ends(words: Column, n: Column) -> Column:
    """Hashes of the line's first and of its last words, as many as the shorter of it
    and a partner gives. The partner may be a word shorter."""

    def keys(k: Column) -> Column:
        return F.array(F.xxhash64(F.lit(0), F.slice(words, F.lit(1), k)), F.xxhash64(F.lit(1), F.slice(words, n - k + 1, k)))

    return F.flatten(F.transform(F.array_distinct(F.array(_near_half(n), _near_half(n - 1))), keys))


def _variants(words: Column) -> Column:
    """[at, key]: the whole line at -1, and each deletion of the word at a place."""
    n = F.size(words)
    pairs = F.transform(words, lambda w, k: F.struct(F.xxhash64(w, k).alias("own"), F.xxhash64(w, k - 1).alias("earlier")))

    def xor(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b)

    def keys(p: Column) -> Column:
        # Without word i: the words before it at their places, those after it one place earlier.
        before = running(F.transform(p, lambda x: x["own"]), None, xor)
        through = running(F.transform(p, lambda x: x["earlier"]), None, xor)

        def each(x: Column) -> Column:
            def without(b: Column, i: Column) -> Column:
                after = F.get(x["through"], n).bitwiseXOR(F.get(x["through"], i + 1))
                return F.struct(i.cast("int").alias("at"), F.xxhash64(n - 1, b.bitwiseXOR(after)).alias("key"))

            whole = F.struct(F.lit(-1).alias("at"), F.xxhash64(n, F.get(x["before"], n)).alias("key"))
            return F.concat(F.array(whole), F.transform(F.slice(x["before"], F.lit(1), n), without))

        return let(F.struct(before.alias("before"), through.alias("through")), each)

    return let(pairs, keys)


def within_one(a: Column, b: Column) -> Column:
    """Whether one word put in, left out or exchanged makes the arrays equal."""

    def first_difference(x: Column, y: Column) -> Column:
        # Arrays of words have no nulls, so what one lacks differs.
        return F.array_position(F.zip_with(x, y, lambda u, v: ~u.eqNullSafe(v)), True).cast("int")

    def longer(x: Column, y: Column) -> Column:
        i = first_difference(x, y)
        return F.slice(x, i + 1, F.size(x)) == F.slice(y, i, F.greatest(F.size(y), F.lit(1)))

    exchanged = F.size(F.filter(F.zip_with(a, b, lambda u, v: ~u.eqNullSafe(v)), lambda d: d)) <= 1
    return (
        F.when(F.size(a) == F.size(b), exchanged)
        .when(F.size(a) == F.size(b) + 1, longer(a, b))
        .when(F.size(b) == F.size(a) + 1, longer(b, a))
        .otherwise(False)
    )


def _chars(words: Column, code) -> Column:
    """A string with the character of code(word), below 2**20, for each word."""
    point = lambda w: F.lpad(F.hex(code(w) + F.lit(1 << 16)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, point), "")), "UTF-32")


def _hashed(words: Column) -> Column:
    return _chars(words, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 20)))


def within(a: Column, b: Column, edits: Column | int) -> Column:
    """Whether at most so many words put in, left out or exchanged make the arrays equal."""
    vocabulary = F.array_distinct(F.concat(a, b))
    exact = let(
        F.struct(vocabulary.alias("v"), a.alias("a"), b.alias("b")),
        lambda p: F.levenshtein(
            _chars(p["a"], lambda w: F.array_position(p["v"], w)), _chars(p["b"], lambda w: F.array_position(p["v"], w))
        ),
    )
    return exact <= edits


def _least(k: int):
    """The least of each k neighbours in an array."""

    def least(h: Column) -> Column:
        parts = h
        for j in range(1, k):
            size = F.size(h) - j
            parts = F.zip_with(F.slice(parts, F.lit(1), size), F.slice(h, F.lit(j + 1), size), lambda x, y: F.least(x, y))
        return parts

    return least


def _runs(words: Column, n: Column, words_per_edit: int) -> Column:
    """Distinct keys of a line of at least 2 * words_per_edit words: any two lines
    within the bound, as the shorter one's length gives it, have one in common."""
    e = words_per_edit
    # Shortest untouched run of lines of up to 4e - 1 words, and of longer ones.
    classes = [(2 * e, 4 * e, min(2 * e // 3, 3 * e // 4)), (4 * e, None, 4 * e // 5)]
    out = []
    for low, high, run in classes:
        gram = max(1, run - 2)
        apart = run - gram + 1
        # A partner is at most 1 / e longer than the shorter line.
        has = (n >= low) if high is None else (n >= low) & (n * e <= (high - 1) * (e + 1))
        grams = F.transform(F.sequence(F.lit(1), n - gram + 1), lambda i: F.xxhash64(F.lit(run), F.slice(words, i, F.lit(gram))))

        # Any run has the same grams in both lines, so the same least one.
        keys = F.array_distinct(let(grams, _least(run - gram + 1)))
        out.append(F.when(has, keys).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*out)


def _far(own: DataFrame, gone: DataFrame, words_per_edit: int) -> DataFrame:
    """Numbers of lines that an earlier one is within a bound of several edits of.
    own: n, words. gone: numbers that need not be looked at."""
    size = F.size("words")
    texts = own.where(size >= 2 * words_per_edit).select("n", "words", _hashed(F.col("words")).alias("chars"))
    firsts_of = texts.select(F.col("n").alias("first"), F.col("words").alias("first_words"), F.col("chars").alias("first_chars"))
    runs = texts.select("n", size.alias("size"), F.explode(_runs(F.col("words"), size, words_per_edit)).alias("key"))
    runs = write_table(runs, "runs")

    def bound(x: Column, y: Column) -> Column:
        return F.floor(F.least(x, y) / words_per_edit).cast("int")

    def confirmed(pairs: DataFrame) -> DataFrame:
        edits = bound(F.size("words"), F.size("first_words"))
        # Characters by hash may agree where words differ, so they only rule out.
        rough = F.call_function("levenshtein", F.col("chars"), F.col("first_chars"), edits) >= 0
        both = pairs.join(texts, "n").join(firsts_of, "first").where(rough)
        return both.where(within(F.col("words"), F.col("first_words"), edits)).select("n").distinct()

    close = (F.col("first") < F.col("n")) & (F.abs(F.col("size") - F.col("first_size")) <= bound(F.col("size"), F.col("first_size")))
    groups = runs.groupBy("key").agg(F.min(F.struct("n", "size")).alias("f"), F.count("*").alias("held")).where("held > 1")
    groups = groups.select("key", F.col("f.n").alias("first"), F.col("f.size").alias("first_size"))
    asked = runs.join(gone, "n", "left_anti")
    found = cut(confirmed(asked.join(groups, "key").where(close).select("n", "first").distinct()))
    rest = asked.join(found, "n", "left_anti")
    earlier = runs.select("key", F.col("n").alias("first"), F.col("size").alias("first_size"))
    more = confirmed(rest.join(earlier, "key").where(close).select("n", "first").distinct())
    return found.union(more)


def _sharing(keyed: DataFrame) -> DataFrame:
    """h1 of the lines that have a key another line has. keyed: h1, key."""
    shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
    return keyed.join(shared, "key", "left_semi").select("h1").distinct()


def dropped_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, words_per_edit: int | None = None
) -> DataFrame:
    """doc_id, digest and the sorted numbers of the lines to drop, of documents that
    have any. docs: doc_id, text. Without words_per_edit the bound is one word."""
    if words_per_edit is not None and (words_per_edit < 3 or min_words > 2 * words_per_edit or near_words > 2 * words_per_edit):
        raise ValueError("words_per_edit needs 3 at least, and half of min_words and near_words")
    docs = docs.select("doc_id", "text")
    n = F.size("words")
    near_enough = F.when(n >= near_words, _ends(F.col("words"), n)).otherwise(F.array().cast("array<bigint>"))
    columns = [*_PLACE, F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), near_enough.alias("ends")]
    if words_per_edit is not None:
        columns.append(_runs(F.col("words"), n, words_per_edit).alias("runs"))
    lines = _lines(docs).where(n >= min_words).select(*columns)
    lines = write_table(lines, "lines")
    place = F.struct(*_PLACE)
    groups = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = groups.where("first != last").select("h1", "h2", "first")
    exact = lines.select(*_PLACE, "h1", "h2").join(repeated, ["h1", "h2"]).where(place != F.col("first")).select(*_PLACE)

    # Lines that share an end with another, told by one hash: a collision lets more through.
    likely = _sharing(lines.select("h1", F.explode("ends").alias("key")))
    if words_per_edit is not None:
        far = _sharing(lines.select("h1", F.explode("runs").alias("key")))
        likely = cut(likely.withColumn("near", F.lit(True)).union(far.withColumn("near", F.lit(False))))
        one_edit = likely.where("near").select("h1")
        likely = likely.select("h1").distinct()
    firsts = lines.select(*_PLACE, "h1", "h2").join(likely, "h1", "left_semi").groupBy("h1", "h2").agg(F.min(place).alias("place"))
    near = cut(firsts.select("place.*"))
    of_document = near.groupBy(*_DOC).agg(F.collect_list("line").alias("wanted"))
    wanted = of_document.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "wanted")
    keyed = docs.select("doc_id", _digest().alias("digest"), "text")
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    split = let(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda content: F.transform("wanted", lambda i: F.struct(i.alias("line"), F.get(content, i).alias("content"))),
    )
    own = texts.select(*_DOC, F.explode(split).alias("x")).select(
        F.struct("doc_id", "digest", F.col("x.line").alias("line")).alias("place"),
        F.regexp_extract_all("x.content", F.lit(_WORD), F.lit(0)).alias("words"),
    )
    # Numbers that rise with the place stand for it: a range sort, then a count within each part.
    own = own.dropDuplicates(["place"]).orderBy("place").withColumn("n", F.monotonically_increasing_id())
    own = write_table(own, "near-lines")
    changed = own
    if words_per_edit is not None:
        changed = own.withColumn("h1", F.xxhash64("words")).join(one_edit, "h1", "left_semi")
    variants = changed.select("n", F.explode(_variants(F.col("words"))).alias("v")).select("n", "v.at", "v.key")
    variants = write_table(variants, "variants")
    deleted, whole = variants.where("at >= 0"), variants.where("at < 0").select("n", "key")
    exchanges = deleted.groupBy("key", "at").agg(F.min("n").alias("first"), F.max("n").alias("last")).where("first != last")
    shorter = whole.groupBy("key").agg(F.min("n").alias("first"))
    # The whole lines against the earliest line that has them as a variant.
    longer = deleted.groupBy("key").agg(F.min("n").alias("first")).join(whole.select("key").distinct(), "key", "left_semi")
    met = [
        deleted.join(exchanges.drop("last"), ["key", "at"]),
        deleted.join(shorter, "key"),
        whole.join(longer, "key"),
    ]
    meetings = met[0].select("n", "first").union(met[1].select("n", "first")).union(met[2].select("n", "first"))
    meetings = meetings.where("first < n").distinct()
    texts_of_first = own.select(F.col("n").alias("first"), F.col("words").alias("first_words"))
    verified = meetings.join(own, "n").join(texts_of_first, "first").where(within_one(F.col("words"), F.col("first_words")))
    if words_per_edit is not None:
        numbers = cut(verified.select("n").distinct())
        numbers = numbers.union(_far(own, numbers, words_per_edit))
        verified = own.join(numbers, "n", "left_semi")
    every = exact.union(verified.select("place.*"))
    return every.groupBy(*_DOC).agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def _with_dropped(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """row (all columns of docs) and dropped (null where none), so that no name of
    docs meets one of ours."""
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), _digest().alias("own"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest"))
    return left.join(dropped.select(*_DOC, "dropped"), same, "left").select("row", "dropped")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the numbers of the dropped lines, for every
    row of docs."""
    dropped = dropped_lines(docs, **options)
    n_lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long")
    small = docs.select("doc_id", _digest().alias("own"), n_lines.alias("n_lines"))
    right = dropped.select(F.col("doc_id").alias("id"), "digest", "dropped")
    joined = small.join(right, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest")), "left")
    return joined.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"),
    )


def _without(lines: Column, dropped: Column) -> Column:
    """lines less those at the sorted places dropped: the stretches between them."""
    ends = F.concat(dropped, F.array(F.size(lines)))
    begins = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda i: i + 1))
    return F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def drop_repeated_lines(docs: DataFrame, least_left: float = 0, **options) -> DataFrame:
    """docs without the lines; n_chars, if there, is counted anew. A document that
    loses lines and has no word left goes.

    With `least_left` documents that would keep less than that share of their words
    are copies of earlier ones and go first, with all they have; the earliest holders
    of lines are then chosen among the rest."""
    dropped = cut(dropped_lines(docs, **options))
    if least_left > 0:
        copies = _shortened(docs, dropped).where("dropped is not null and words_left < words * %r" % float(least_left))
        gone = cut(copies.select(F.col("row.doc_id").alias("id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("own")).distinct())
        keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("doc"), _digest().alias("digest"))
        same = F.col("doc").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own"))
        docs = write_table(keyed.join(gone, same, "left_anti").select("row.*"), "first-copies")
        dropped = cut(dropped_lines(docs, **options))
    out = _shortened(docs, dropped).where("dropped is null or words_left > 0")
    changed = F.col("dropped").isNotNull()
    columns = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == "text":
            own = F.when(changed, F.col("left")).otherwise(own)
        elif c == "n_chars":
            own = F.when(changed, F.length("left").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns)


def _shortened(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """row, dropped, left (the text without its dropped lines), words and words_left."""
    left = let(F.split("row.text", "\n", -1), lambda lines: F.array_join(_without(lines, F.col("dropped")), "\n"))
    out = _with_dropped(docs, dropped).withColumn("left", F.when(F.col("dropped").isNotNull(), left))
    return out.withColumns({"words": F.regexp_count("row.text", F.lit(_WORD)), "words_left": F.regexp_count("left", F.lit(_WORD))})
