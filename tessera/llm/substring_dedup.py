"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes.

A window is `width` consecutive words (`[^\\x20\\x09-\\x0D]+`) of one document. A word is
removed if a window that covers it has a word sequence that also starts earlier: in a
document of smaller id, or earlier in the same document. Windows are judged on the
input; overlapping ones merge into maximal intervals.

1. Documents are dealt into chunks of bounded text by a hash of id and text: the one
   shuffle of texts, used by both passes.
2. A chunk hashes every window (64 bits) and sends each distinct hash once, with the
   least id that has it: sorted, as differences, parted by ranges of the hash. However
   often a passage is repeated, a chunk sends it once.
3. A range of hashes, a bounded number of windows, finds for each chunk which of its
   hashes a smaller id has elsewhere, and answers with one bit a hash.
4. The chunk hashes its windows once more, takes the bits, and cuts the words out.

Two different windows share a hash by a chance of 2^-64 a pair; they count as equal.

Defined cases: a null or empty text has no words; a text of fewer than `width` words
keeps all; a very long text is hashed whole, in pieces of a megabyte unless it is longer
itself; null ids come after all others; rows of equal ids are documents of their own, none
earlier than the other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

WIDTH = 20
#: Characters of text in a chunk, and of the texts whose windows meet in a range of hashes.
CHUNK_CHARS = 8_000_000
RANGE_CHARS = 12_000_000


def _windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word (within the row) of every window, and the words of each row."""
    hashes, rows, starts, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low, _, data, offsets in kernel.chunks(texts):
        own, first = kernel.word_hashes(data, offsets, fold=False)
        n = np.diff(first)
        every = kernel.rolling_hashes(own, width)
        m = np.maximum(n - width + 1, 0)
        row = np.repeat(np.arange(len(n)), m)
        start = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        hashes.append(every[first[row] + start])
        rows.append(row + low)
        starts.append(start)
        words.append(n)
    return tuple(map(np.concatenate, (hashes, rows, starts, words)))


def _ordered(table: pa.Table) -> pa.Table:
    """Rows by id, nulls last."""
    return table.take(pc.sort_indices(table, [("id", "ascending")], null_placement="at_end")).combine_chunks()


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Ends of the sorted hashes of each range of equal width."""
    part = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))


def _packed(numbers: np.ndarray) -> bytes:
    """Rising numbers as differences of as many bytes as the greatest needs."""
    steps = np.diff(numbers, prepend=np.uint64(0))
    # The first is as large as the range's place; it goes in full.
    size = next(b for b in range(1, 9) if b == 8 or len(steps) < 2 or int(steps[1:].max()) < 1 << 8 * b)
    body = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return bytes([size]) + numbers[:1].astype("<u8").tobytes() + body.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    size, raw = blob[0], np.frombuffer(blob, np.uint8)[1:]
    body = raw[8:].reshape(-1, size)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[0] = raw[:8]
    steps[1:, :size] = body
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def _sent(width: int, ranges: int, id_type: pa.DataType):
    """A chunk's distinct hashes, by range, with the least id of each."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("who", pa.binary()), ("ids", pa.list_(id_type))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = _ordered(table)
        hashes, rows, _, _ = _windows(table["text"], width)
        distinct, first = np.unique(hashes, return_index=True)
        row, ids, out = rows[first], table["id"].combine_chunks(), []
        ends = _ranges(distinct, ranges)
        for part, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if a == b:
                continue
            used, who = np.unique(row[a:b], return_inverse=True)
            who = who.astype("<u2" if len(used) <= 1 << 16 else "<u4")
            out.append((part, key[0].as_py(), _packed(distinct[a:b]), who.tobytes(), ids.take(pa.array(used))))
        columns = zip(*out, strict=True) if out else [[]] * 5
        arrays = [pa.array(list(c), t) if i < 4 else _lists(c, id_type) for i, (c, t) in enumerate(zip(columns, schema.types, strict=True))]
        return pa.Table.from_arrays(arrays, schema=schema)

    return run


def _lists(parts, id_type: pa.DataType) -> pa.Array:
    parts = list(parts)
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(parts) if parts else pa.array([], id_type))


def _answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each chunk, which of its hashes in this range a smaller id has in another."""
    lists = table["ids"].combine_chunks()
    rank = np.asarray(pc.rank(lists.flatten(), "ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    hashes, ranks, sizes = [], [], []
    for i, (blob, who) in enumerate(zip(table["hashes"], table["who"], strict=True)):
        own = _unpacked(blob.as_py())
        narrow = starts[i + 1] - starts[i] <= 1 << 16
        hashes.append(own)
        ranks.append(rank[starts[i] + np.frombuffer(who.as_py(), "<u2" if narrow else "<u4").astype(np.int64)])
        sizes.append(len(own))
    every, ranks = np.concatenate(hashes), np.concatenate(ranks)
    del hashes
    order = np.argsort(every, kind="stable")
    every, sorted_ranks = every[order], ranks[order]
    begins = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    least = np.repeat(np.minimum.reduceat(sorted_ranks, begins), np.diff(np.r_[begins, len(every)]))
    later = np.empty(len(every), bool)
    later[order] = sorted_ranks > least
    ends = np.cumsum(sizes)
    found = [(c.as_py(), key[0].as_py(), np.packbits(later[e - n : e]).tobytes()) for c, e, n in zip(table["chunk"], ends, sizes, strict=True) if later[e - n : e].any()]
    columns = zip(*found, strict=True) if found else [[]] * 3
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chunk", "part", "later"])


def _cut(width: int, ranges: int):
    """A chunk's documents without the words that repeated windows cover."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(table)
        hashes, rows, starts, words = _windows(table["text"], width)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        ends, later = _ranges(distinct, ranges), np.zeros(len(distinct), bool)
        for part, bits in zip(answers["part"].to_pylist(), answers["later"].to_pylist(), strict=True):
            n = ends[part + 1] - ends[part]
            later[ends[part] : ends[part + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        repeated = later[place] | (np.arange(len(hashes)) > first[place])
        ranks = np.asarray(pc.rank(table["id"].combine_chunks(), "ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
        for rank in np.flatnonzero(np.bincount(ranks) > 1):
            # Rows of one id: none is earlier than the other.
            for row in np.flatnonzero(ranks == rank).tolist():
                own = slice(*np.searchsorted(rows, [row, row + 1]))
                again = np.ones(own.stop - own.start, bool)
                again[np.unique(hashes[own], return_index=True)[1]] = False
                repeated[own] = later[place[own]] | (ranks[rows[first[place[own]]]] < rank) | again
        at = np.cumsum(words) - words
        begins = at[rows[repeated]] + starts[repeated]
        change = np.zeros(words.sum() + width + 1, np.int64)
        np.add.at(change, begins, 1)
        np.add.at(change, begins + width, -1)
        removed = np.cumsum(change)[: words.sum()] > 0
        lost = np.r_[0, np.cumsum(removed)]
        n_removed = lost[at + words] - lost[at]
        kept = []
        for text, a, n, gone in zip(table["text"], at.tolist(), words.tolist(), n_removed.tolist(), strict=True):
            # Splitting bytes at white space parts words at \x20 and \x09-\x0D, and nowhere else.
            parts = (text.as_py() or "").encode().split() if gone < n else []
            kept.append(b" ".join(parts if not gone else [parts[i] for i in np.flatnonzero(~removed[a : a + n]).tolist()] if parts else []).decode())
        return pa.Table.from_arrays([table["id"], pa.array(words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, chunk_chars: int = CHUNK_CHARS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """docs: doc_id, text. A row for each row: doc_id, n_words, n_removed, kept (the words
    left, joined by one space)."""
    if width < 1:
        raise ValueError("a window has one word at least")
    from pyspark.sql.pandas.types import to_arrow_type

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, ranges = (max(1, -(-chars // n)) for n in (chunk_chars, range_chars))
    kind = docs.schema["doc_id"].dataType
    id_type, name = to_arrow_type(kind), kind.simpleString()
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    sent = dealt.groupBy("chunk").applyInArrow(_sent(width, ranges, id_type), f"part int, chunk int, hashes binary, who binary, ids array<{name}>")
    answers = sent.groupBy("part").applyInArrow(_answers, "chunk int, part int, later binary")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(width, ranges), f"id {name}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", "doc_id")
