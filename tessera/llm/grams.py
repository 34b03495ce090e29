"""Interpolated modified Kneser-Ney over n-grams of any order.

The general form of lm.py's pair model, and its way beyond 2**32 distinct words: every
n-gram is a 64-bit hash of its words. Tasks hash the windows of their texts in NumPy and
count equal ones; Spark aggregates them, level by level:

* the highest level counts its n-grams; each lower one counts with how many different
  words before it a gram stands (its distinct longer grams);
* each context (a gram less its last word) has the sum of its grams' counts and how many
  of them count one, two, and more.

Each level is stored as sorted hash arrays with their values beside, by shards of the
hash's first bits, which workers map into memory and search.

p(w | c) = max(n(cw) - D, 0) / n(c) + g(c) p(w | shorter c), down to the single word,
which shares what is left with the unknown word. Texts begin with order - 1 begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .storage import Arrays, new_folder, save_array, write_table

#: Rows of a stored shard, and windows that a task counts before it sends them on.
SHARD_ROWS = 2_000_000
BUFFER = 1_000_000
BEGIN, END = np.uint64(0x00000000B0E0610A), np.uint64(0x00000000E0D0E0D1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CONTEXT = ("total", "ones", "twos", "more")


def sequences(words: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words with begins before and an end after each; the places of their
    tokens (words and ends) and each text's first token."""
    texts, pad = len(first) - 1, order - 1
    sizes = np.diff(first)
    starts = np.cumsum(sizes + order) - (sizes + order)
    every = np.full(len(words) + texts * order, BEGIN, np.uint64)
    inner = np.arange(len(words)) - np.repeat(first[:-1], sizes)
    every[np.repeat(starts + pad, sizes) + inner] = words
    every[starts + pad + sizes] = END
    tokens = np.repeat(starts + pad, sizes + 1) + np.arange(len(words) + texts) - np.repeat(first[:-1] + np.arange(texts), sizes + 1)
    return every, tokens, np.append(first[:-1] + np.arange(texts), len(words) + texts)


def keys_at(every: np.ndarray, tokens: np.ndarray, size: int, back: int = 0) -> np.ndarray:
    """Hashes of the `size` words that end `back` words before each token's place."""
    out = np.full(len(tokens), np.uint64(size), np.uint64)
    for lag in range(size - 1 + back, back - 1, -1):
        out = kernel.mix(out * _BASE + every[tokens - lag])
    return out


@dataclass
class GramModel:
    uri: str
    order: int
    bits: dict = field(default_factory=dict)  # of each table: the first bits of a key are its shard
    present: dict = field(default_factory=dict)  # of each table: the shards that have rows
    discounts: dict = field(default_factory=dict)  # of each level
    tokens: int = 0
    types: int = 0
    left: float = 0.0  # what single words leave to all
    arrays: Arrays = field(default_factory=Arrays)

    def __getstate__(self):
        return self.__dict__ | {"arrays": Arrays()}

    def find(self, table: str, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """Values of keys, zeros where the table lacks one."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(distinct), np.int64) for _ in columns]
        bits = self.bits[table]
        shard = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
        used, at = np.unique(shard, return_index=True)
        for s, low, high in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(shard)], strict=True):
            if s not in self.present[table]:
                continue
            held = self.arrays.load(f"{self.uri}/{table}-key-{s}.npy")
            place = np.minimum(np.searchsorted(held, distinct[low:high]), len(held) - 1)
            found = np.flatnonzero(held[place] == distinct[low:high])
            for x, c in zip(out, columns, strict=True):
                x[low + found] = self.arrays.load(f"{self.uri}/{table}-{c}-{s}.npy")[place[found]]
        return [x[back] for x in out]

    def measures(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's first token, and each token's training count and log10 chance."""
        every, tokens, at = sequences(words, first, self.order)
        if not self.tokens:
            return at, np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        own = keys_at(every, tokens, 1)
        count, follows = self.find("word", own, ("count", "follows"))
        d = np.array([0.0, *self.discounts[1]])
        chance = np.maximum(follows - d[np.minimum(follows, 3)], 0) / self.discounts["follows"] + self.left / (self.types + 1)
        for size in range(2, self.order + 1):
            [n] = self.find(f"gram{size}", keys_at(every, tokens, size), ("count",))
            total, ones, twos, more = self.find(f"context{size}", keys_at(every, tokens, size - 1, 1), _CONTEXT)
            d = np.array([0.0, *self.discounts[size]])
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = (np.maximum(n - d[np.minimum(n, 3)], 0) + (d[1] * ones + d[2] * twos + d[3] * more) * chance) / total
            chance = np.where(total > 0, mixed, chance)
        return at, count, np.log10(chance)


def _stored(model: GramModel, table: str, rows: DataFrame, key: str, columns: tuple[str, ...], shard_rows: int) -> None:
    count = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, count / shard_rows))))
    shard = F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)
    uri = model.uri

    def save(group: tuple, own: pa.Table) -> pa.Table:
        s = group[0].as_py()
        keys = own.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        save_array(f"{uri}/{table}-key-{s}.npy", keys[order])
        for c in columns:
            values = own.column(c).to_numpy()[order]
            top = int(values.max()) if len(values) else 0
            save_array(f"{uri}/{table}-{c}-{s}.npy", values.astype(np.uint8 if top < 256 else np.uint32 if top < 1 << 32 else np.int64))
        return pa.table({"shard": pa.array([s], pa.int32())})

    dealt = rows.select(shard.alias("shard"), F.col(key).alias("key"), *columns)
    model.present[table] = {r["shard"] for r in dealt.groupBy("shard").applyInArrow(save, "shard int").collect()}
    model.bits[table] = bits


def train_grams(docs: DataFrame, order: int, buffer: int = BUFFER, shard_rows: int = SHARD_ROWS) -> GramModel:
    """A model of the column text of docs. Its files lie in the shared folder."""
    from .lm import _discounts

    if order < 2:
        raise ValueError("the order must be 2 at least")
    model = GramModel(new_folder(docs.sparkSession, "grams"), order)
    names = [f"k{j}" for j in range(order, 0, -1)] + [f"x{j}" for j in range(order, 1, -1)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def send() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            _, at, n = np.unique(columns[0], return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c[at].view(np.int64)) for c in columns), pa.array(n)], [*names, "n"])

        size = 0
        for batch in batches:
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                every, tokens, _ = sequences(*kernel.word_hashes(data, offsets), order)
                # A gram of `size` words, and the context of one.
                grams = [keys_at(every, tokens, j) for j in range(order, 0, -1)]
                held.append(grams + [keys_at(every, tokens, j - 1, 1) for j in range(order, 1, -1)])
                size += len(tokens)
                if size >= buffer:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    found = docs.select("text").mapInArrow(windows, ", ".join(f"{c} long" for c in [*names, "n"]))
    level = found.groupBy(f"k{order}").agg(F.sum("n").alias("count"), *(F.min(c).alias(c) for c in names[1:]))
    level = write_table(level, "grams")
    words = level.groupBy("k1").agg(F.sum("count").alias("count"))
    model.types, model.tokens = (x or 0 for x in words.agg(F.count("*"), F.sum("count")).first())
    if not model.tokens:
        return model

    def tally(rows: DataFrame) -> list[int]:
        return list(rows.agg(*(F.sum((F.col("count") == k).cast("long")) for k in range(1, 5))).first())

    for j in range(order, 1, -1):
        model.discounts[j] = _discounts(tally(level))
        _stored(model, f"gram{j}", level, f"k{j}", ("count",), shard_rows)
        kinds = [F.sum(k.cast("long")) for k in (F.col("count") == 1, F.col("count") == 2, F.col("count") >= 3)]
        context = level.groupBy(f"x{j}").agg(F.sum("count").alias("total"), *(k.alias(c) for k, c in zip(kinds, _CONTEXT[1:], strict=True)))
        _stored(model, f"context{j}", context, f"x{j}", _CONTEXT, shard_rows)
        rest = [c for c in names if c.startswith("k") and int(c[1:]) < j - 1 or c.startswith("x") and int(c[1:]) < j]
        level = write_table(level.groupBy(f"k{j - 1}").agg(F.count("*").alias("count"), *(F.min(c).alias(c) for c in rest)), "grams")
    follows, *n = level.agg(F.sum("count"), *(F.sum((F.col("count") == k).cast("long")) for k in range(1, 5)), F.sum((F.col("count") >= 3).cast("long"))).first()
    d = model.discounts[1] = _discounts(n[:4])
    model.discounts["follows"] = follows
    model.left = (d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / follows
    both = words.join(level.withColumnRenamed("count", "follows"), "k1")
    _stored(model, "word", both, "k1", ("count", "follows"), shard_rows)
    return model
