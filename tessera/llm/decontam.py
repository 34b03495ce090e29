"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs outside ASCII punctuation and space. A mask is laid
over every window of words; only the positions that it selects enter the hash,
so a substituted word at an ignored position keeps it. Equal hashes of a test
item and a document are hits. Around each hit the item is laid over the document
on the hit's diagonal, and words are compared one by one. A document is
contaminated by an item if at least `min_overlap` of the item's words agree.

The masks follow from an item's length, so that no such overlap lacks a hit: if k
of n words agree, the k - q + 1 rows of q agreeing words in succession span at most
(q - 1) (n - 1) words together, and the shortest at most their mean. All masks of
weight q up to that span are used.

Items under `whole_below` words are sought whole, by one hash of all their words.

Defined cases: a null or empty text has no words and no hits; an item without
words matches nothing; ids may have any type, and null ids are kept as ids; a stage
judges rows by their text, so null ids and repeated ids are no way past it; repeated
rows give repeated results; of diagonals that agree alike the first counts; very long
texts take time proportional to their length, in memory of one text; other columns
are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from . import kernel
from .storage import cut, write_table

#: Items with fewer words are sought whole: half of a few words is no sign of a copy.
WHOLE_BELOW = 7
#: Masks of greater weight have fewer chance hits, but there are more; up to so many are taken.
MOST_MASKS = 12
#: Hits, and words to compare, that are held at once.
HITS = 1 << 20
#: Items up to this many characters altogether are broadcast; more are joined by shuffle.
#: At ten masks or so, each of their words takes some 160 bytes of every worker.
BROADCAST_CHARS = 12_000_000

_COUNTS = ("n_hits", "matched_words", "item_words", "first_word")


def _result(doc_id: T.DataType, item_id: T.DataType) -> T.StructType:
    out = T.StructType([T.StructField("doc_id", doc_id), T.StructField("item_id", item_id)])
    for name in _COUNTS:
        out.add(name, T.LongType())
    return out.add("overlap", T.DoubleType())


def least_agreeing(n: int, min_overlap: float) -> int:
    """The least number of words, of an item's n, that makes an overlap."""
    return max(1, next(k for k in range(n + 1) if k >= min_overlap * n or k == n))


@functools.cache
def masks_of(n: int, min_overlap: float, whole_below: int = WHOLE_BELOW) -> tuple[str, ...]:
    """Masks (1: the word counts) of which one hits, whichever of an item's n words agree."""
    if n < whole_below:
        return ("1" * n,) if n else ()
    k = least_agreeing(n, min_overlap)
    best: tuple[str, ...] = ()
    for q in range(1, min(k, 8) + 1):
        span = min(n - 1, (q - 1) * (n - 1) // (k - q + 1))
        count = 1 if q == 1 else sum(math.comb(s - 1, q - 2) for s in range(q - 1, span + 1))
        if q > 3 and count > MOST_MASKS:
            break
        inner = ((s, c) for s in range(q - 1, span + 1) for c in itertools.combinations(range(1, s), q - 2)) if q > 1 else ()
        best = tuple("".join("1" if i in (0, s, *c) else "0" for i in range(s + 1)) for s, c in inner) if q > 1 else ("1",)
    return best


def _picks(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of len(mask) words."""
    number = int(mask, 2)
    m = len(words) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(number % (1 << 64)), np.uint64)
    for k in _picks(mask):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + m]
    return kernel.mix(out)


class Items:
    """Test items: their words, and a sorted array of seed hashes with places."""

    def __init__(self, ids: list, texts: pa.Array, min_overlap: float, whole_below: int = WHOLE_BELOW):
        self.ids, self.min_overlap = ids, min_overlap
        own: list[np.ndarray] = []
        for _, _, data, offsets in kernel.chunks(texts):
            words, first = kernel.word_hashes(data, offsets, kernel.PUNCTUATION)
            own += [words[a:b].copy() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.words = np.concatenate(own) if own else np.zeros(0, np.uint64)
        self.sizes = np.array([len(w) for w in own], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        of_item = [masks_of(len(w), min_overlap, whole_below) for w in own]
        self.least = np.array([len(w) if len(w) < whole_below else least_agreeing(len(w), min_overlap) for w in own], np.int64)
        self.masks = sorted({m for masks in of_item for m in masks})
        hashes, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for item, (words, masks) in enumerate(zip(own, of_item, strict=True)):
            for mask in masks:
                h = seed_hashes(words, mask)
                hashes.append(h)
                items.append(np.full(len(h), item, np.int32))
                places.append(np.arange(len(h), dtype=np.int32))
        self.hashes = np.concatenate(hashes)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.items, self.places = self.hashes[order], np.concatenate(items)[order], np.concatenate(places)[order]
        bits = max(16, int(len(self.hashes)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.hashes >> self.shift).astype(np.int64)] = True

    def hits(self, words: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions, items and positions in the items of equal seed hashes, in lots.
        last: where the text of each word ends; no window goes beyond."""
        for mask in self.masks:
            hashes = seed_hashes(words, mask)
            maybe = np.flatnonzero(self.filter[(hashes >> self.shift).astype(np.int64)])
            maybe = maybe[maybe + len(mask) <= last[maybe]]
            low = np.searchsorted(self.hashes, hashes[maybe], "left")
            count = np.searchsorted(self.hashes, hashes[maybe], "right") - low
            maybe, low, count = maybe[count > 0], low[count > 0], count[count > 0]
            ends = np.cumsum(count)
            lot = (ends - count) // HITS
            for i in np.unique(lot).tolist():
                n, own = count[lot == i], low[lot == i]
                k = np.repeat(own - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(maybe[lot == i], n), self.items[k].astype(np.int64), self.places[k].astype(np.int64)

    def agreeing(self, words: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Words of each item, laid from `begin`, that agree with those of words[low:high]."""
        out, at = np.zeros(len(item), np.int64), 0
        while at < len(item):
            # As many as have HITS words together, one at least.
            upto = at + max(1, int(np.searchsorted(np.cumsum(self.sizes[item[at : at + HITS]]), HITS, "right")))
            own, n = item[at:upto], self.sizes[item[at:upto]]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(begin[at:upto], n) + inner
            inside = (where >= np.repeat(low[at:upto], n)) & (where < np.repeat(high[at:upto], n))
            same = inside & (words[np.where(inside, where, 0)] == self.words[np.repeat(self.starts[own], n) + inner])
            out[at:upto] = np.bincount(np.repeat(np.arange(upto - at), n)[same], minlength=upto - at)
            at = upto
        return out


def agreeing(document: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Words of the item that agree with the document laid at `shift`."""
    low, high = max(0, -shift), min(len(item), len(document) - shift)
    return int(np.count_nonzero(item[low:high] == document[low + shift : high + shift])) if high > low else 0


def overlaps(words: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple]:
    """(text, item, hits, agreeing words, item's words, first word) of verified overlaps."""
    found = np.zeros((0, 4), np.int64)
    for at, item, inner in items.hits(words, np.repeat(first[1:], np.diff(first))):
        text = np.searchsorted(first, at, "right") - 1
        lot, n = np.unique(np.stack([text, item, at - inner - first[text]], 1), axis=0, return_counts=True)
        same = items.agreeing(words, first[lot[:, 0]] + lot[:, 2], first[lot[:, 0]], first[lot[:, 0] + 1], lot[:, 1])
        good = same >= items.least[lot[:, 1]]
        found = np.concatenate([found, np.column_stack([lot, n])[good]]) if good.any() else found
    if not len(found):
        return
    diagonals, of = np.unique(found[:, :3], axis=0, return_inverse=True)
    hits = np.bincount(of.reshape(-1), found[:, 3], len(diagonals)).astype(np.int64)
    text, item, shift = diagonals.T
    same = items.agreeing(words, first[text] + shift, first[text], first[text + 1], item)
    best: dict[tuple[int, int], list[int]] = {}
    for t, i, d, n, x in zip(text.tolist(), item.tolist(), shift.tolist(), hits.tolist(), same.tolist(), strict=True):
        old = best.get((t, i))
        total = n + (old[0] if old else 0)
        best[t, i] = [total, x, d] if old is None or x > old[1] else [total, *old[1:]]
    for (t, i), (n, x, d) in best.items():
        yield t, i, n, x, int(items.sizes[i]), max(0, d)


def _by_broadcast(docs: DataFrame, benchmark: DataFrame, min_overlap: float, whole_below: int) -> DataFrame:
    rows = benchmark.select("item_id", "text").collect()
    shared = docs.sparkSession.sparkContext.broadcast(
        ([r["item_id"] for r in rows], [r["text"] for r in rows])
    )
    built: list[Items] = []
    schema = _result(docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType)
    item_type = to_arrow_type(schema["item_id"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            ids, texts = shared.value
            built.append(Items(ids, pa.array(texts, pa.string()), min_overlap, whole_below))
        items = built[0]
        item_ids = pa.array(items.ids, item_type)
        for batch in batches:
            for low, _, data, offsets in kernel.chunks(batch.column(1)):
                words, first = kernel.word_hashes(data, offsets, kernel.PUNCTUATION)
                found = list(overlaps(words, first, items))
                if not found:
                    continue
                text, item, hits, same, size, at = (np.array(x, np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(low + text)),
                        item_ids.take(pa.array(item)),
                        *map(pa.array, (hits, same, size, at, same / size)),
                    ],
                    schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in kernel.chunks(batch.column(0)):
            first = kernel.word_hashes(data, offsets, kernel.PUNCTUATION)[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.diff(first)).astype(np.int64))], ["size"])


def _by_shuffle(docs: DataFrame, benchmark: DataFrame, min_overlap: float, whole_below: int) -> DataFrame:
    """Both sides' seed hashes meet in an equi-join, then both texts' words."""

    def emit(sought: list[str] | None):
        """Seeds by the masks sought, or by each item's own."""

        def run(batches):
            for batch in batches:
                rows = batch.column(0).to_numpy()
                for low, high, data, offsets in kernel.chunks(batch.column(1)):
                    words, first = kernel.word_hashes(data, offsets, kernel.PUNCTUATION)
                    for i in range(high - low):
                        own = words[first[i] : first[i + 1]]
                        used = masks_of(len(own), min_overlap, whole_below) if sought is None else sought
                        for mask in used:
                            h = seed_hashes(own, mask)
                            if len(h):
                                row = pa.array(np.full(len(h), rows[low + i]))
                                yield pa.RecordBatch.from_arrays(
                                    [row, pa.array(h.view(np.int64)), pa.array(np.arange(len(h)))], ["row", "hash", "at"]
                                )

        return run

    items = write_table(
        benchmark.select(F.monotonically_increasing_id().alias("item_row"), "item_id", F.col("text").alias("item_text")),
        "items",
    )
    numbered = write_table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "docs")
    # Lengths of items: as many numbers as there are distinct ones.
    sizes = items.select("item_text").mapInArrow(_sizes, "size long").distinct().collect()
    sought = sorted({m for r in sizes for m in masks_of(r["size"], min_overlap, whole_below)})
    seeds = "row long, hash long, at long"
    left = numbered.select("row", "text").mapInArrow(emit(sought), seeds)
    right = items.select("item_row", "item_text").mapInArrow(emit(None), seeds)
    right = right.select(F.col("row").alias("item_row"), "hash", F.col("at").alias("item_at"))
    hits = left.join(right, "hash").groupBy("row", "item_row", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count("*").alias("n_hits")
    )
    pairs = hits.join(numbered.select("row", "text"), "row").join(items.select("item_row", "item_text"), "item_row")
    kept = ("row", "item_row", *_COUNTS)

    def verify(batches):
        for batch in batches:
            r = batch.to_pydict()
            out = []
            for i in range(batch.num_rows):
                two = []
                for text in (r["text"][i], r["item_text"][i]):
                    [(_, _, data, offsets)] = kernel.chunks(pa.array([text or ""]))
                    two.append(kernel.word_hashes(data, offsets, kernel.PUNCTUATION)[0])
                n = len(two[1])
                same = agreeing(two[0], two[1], r["shift"][i])
                if same >= (n if n < whole_below else least_agreeing(n, min_overlap)):
                    out.append((r["row"][i], r["item_row"][i], r["n_hits"][i], same, n, max(0, r["shift"][i])))
            columns = zip(*out, strict=True) if out else [()] * len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(kept))

    found = pairs.select("row", "item_row", "n_hits", "shift", "text", "item_text").mapInArrow(verify, ", ".join(f"{c} long" for c in kept))
    best = F.max(F.struct("matched_words", (-F.col("first_word")).alias("back")))
    of_pair = found.groupBy("row", "item_row", "item_words").agg(F.sum("n_hits").alias("n_hits"), best.alias("best"))
    named = of_pair.join(numbered.select("row", "doc_id"), "row").join(items.select("item_row", "item_id"), "item_row")
    return named.select(
        "doc_id",
        "item_id",
        "n_hits",
        F.col("best.matched_words").alias("matched_words"),
        "item_words",
        (-F.col("best.back")).alias("first_word"),
        (F.col("best.matched_words") / F.col("item_words")).alias("overlap"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    min_overlap: float = 0.5,
    whole_below: int = WHOLE_BELOW,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """A row for each contaminated document row and item that it holds.

    docs has doc_id and text, benchmark item_id and text. The items' characters
    are summed first: up to `broadcast_chars` they go to every worker, beyond
    that seed hashes are joined by shuffle.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    chars = benchmark.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    way = _by_broadcast if chars <= broadcast_chars else _by_shuffle
    return way(docs, benchmark, min_overlap, whole_below)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their ids."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    bad = decontaminate(docs.select(digest.alias("doc_id"), "text"), benchmark, **options)
    bad = cut(bad.select(F.col("doc_id").alias("bad")).distinct())
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("digest"))
    return keyed.join(bad, F.col("digest") == F.col("bad"), "left_anti").select("row.*")
