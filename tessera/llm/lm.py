"""Interpolated modified Kneser-Ney language model: word pairs, and by grams.py any order.

Counting runs in Spark over packed arrays: a task counts the words (then the
pairs) of its texts in NumPy and sends sorted keys with their counts in a binary
value per shard; a shard merges them and writes sorted arrays to the shared
folder. Scoring maps those arrays into memory and searches them, so a worker
holds no model of its own.

* Vocabulary: the words' 64-bit hashes, sorted over all shards; a word's number
  is its place. Beside them their counts.
* Pairs: `number << 32 | number` sorted, and their counts. Shards are ranges of
  the first word; a very frequent first word is dealt by the second, so that no
  shard holds all that follows it.
* State of each word: how often it leads a pair, with how many followers seen
  once, twice, and more often, and how many distinct words it follows.

A text's tokens are its words, lower-cased in A-Z, and one end; the first token
follows a begin. p(v|u) = max(c(uv) - D, 0) / c(u) + g(u) q(v), and
q(v) = max(N(.v) - D', 0) / N(..) + g' / (V + 1), with modified discounts for one,
two, and more; V + 1 counts the unknown word. Shards follow the training text's
size, not a set number.

Defined cases: a null or empty text is one end; words never trained on get the
unknown word's share; without training texts every token has the chance 1;
repeated rows count each; a very long text takes memory in proportion to itself; ids
may have any type; other columns are ignored; null ids are trained on.
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
from .grams import GramModel, train_grams
from .storage import Arrays, new_folder, save_array, write_table

#: Bytes of training text to a shard of words, of pairs.
WORD_SHARD_BYTES = 64 << 20
PAIR_SHARD_BYTES = 24 << 20
#: Tokens that a task counts before it sends them on.
BUFFER = 3_000_000
END = np.uint64(0x00000000E0D0E0D1)

_PACKED = "shard int, keys binary, counts binary"


@dataclass
class Model:
    uri: str
    shards: int  # of words; a power of two
    pair_shards: int
    state_parts: int
    types: int
    tokens: int
    pairs: int
    starts: np.ndarray  # number of the first word of each word shard
    hot: np.ndarray  # sorted numbers of very frequent words
    discounts: tuple = (0.0, 0.0, 0.0)
    lower_discounts: tuple = (0.0, 0.0, 0.0)
    lower_left: float = 0.0  # g'
    present: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # pair shards that have pairs
    arrays: Arrays = field(default_factory=Arrays)

    def __getstate__(self):
        return self.__dict__ | {"arrays": Arrays()}

    def array(self, name: str) -> np.ndarray:
        return self.arrays.load(f"{self.uri}/{name}.npy")

    # -- words ---------------------------------------------------------------

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; `types + 1` where unknown (`types` is the begin)."""
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), self.types + 1, np.int64)
        cuts = np.searchsorted(distinct, _shard_edges(self.shards))
        cuts[-1] = len(distinct)
        for s in range(self.shards):
            own = distinct[cuts[s] : cuts[s + 1]]
            size = self.starts[s + 1] - self.starts[s]
            if len(own) and size:
                keys = self.array(f"word-{s}")
                at = np.minimum(np.searchsorted(keys, own), size - 1)
                found = keys[at] == own
                out[cuts[s] : cuts[s + 1]][found] = at[found] + self.starts[s]
        return out[back]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of word numbers; 0 for the unknown."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(distinct, self.starts)
        for s in range(self.shards):
            own = distinct[cuts[s] : cuts[s + 1]]
            if len(own):
                out[cuts[s] : cuts[s + 1]] = self.array(f"word-count-{s}")[own - self.starts[s]]
        return out[back]

    # -- pairs ---------------------------------------------------------------

    def pair_shard(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        by = np.where(_within(self.hot, first), second, first)
        return np.minimum(by * self.pair_shards // max(1, self.types + 1), self.pair_shards - 1)

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, back = np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_inverse=True)
        shard = self.pair_shard((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.pair_shards + 1))
        out = np.zeros(len(keys), np.int64)
        for s in np.intersect1d(np.flatnonzero(np.diff(cuts)), self.present).tolist():
            at = order[cuts[s] : cuts[s + 1]]
            held = self.array(f"pair-{s}")
            place = np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)
            found = held[place] == keys[at]
            out[at[found]] = self.array(f"pair-count-{s}")[place[found]]
        return out[back]

    def states(self, numbers: np.ndarray) -> list[np.ndarray]:
        """total, ones, twos, more, follows of word numbers; zeros for the unknown."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = [np.zeros(len(distinct), np.int64) for _ in _STATE]
        edges = _part_edges(self.types, self.state_parts)
        cuts = np.searchsorted(distinct, edges)
        for p in range(self.state_parts):
            own = distinct[cuts[p] : cuts[p + 1]]
            if len(own):
                for x, name in zip(out, _STATE, strict=True):
                    x[cuts[p] : cuts[p + 1]] = self.array(f"{name}-{p}")[own - edges[p]]
        return [x[back] for x in out]

    # -- scores --------------------------------------------------------------

    def log_chances(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return np.zeros(len(first))
        total, ones, twos, more, _ = self.states(first)
        follows = self.states(second)[4]
        lower = np.maximum(follows - _discount(follows, self.lower_discounts), 0) / self.pairs + self.lower_left / (self.types + 1)
        count = self.pair_counts(first, second)
        d = self.discounts
        with np.errstate(divide="ignore", invalid="ignore"):
            left = (d[0] * ones + d[1] * twos + d[2] * more) / total
            own = np.maximum(count - _discount(count, d), 0) / total
        return np.log10(np.where(total > 0, own + left * lower, lower))

    def measures(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's first token, and each token's training count and log10 chance."""
        if not self.tokens:
            before, own, at = _tokens(np.ones(len(words), np.int64), first, 0, 1)
            return at, np.zeros(len(own), np.int64), np.zeros(len(own))
        before, own, at = self.token_numbers(words, first)
        return at, self.counts(own), self.log_chances(before, own)

    def token_numbers(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Preceding and own number of every token, and each text's first token."""
        return _tokens(self.numbers(words), first, self.types, int(self.numbers(np.array([END]))[0]))


_STATE = ("total", "ones", "twos", "more", "follows")


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _discount(count: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def _discounts(n: list[int]) -> tuple:
    """Modified Kneser-Ney discounts from how many keys have counts one to four."""
    n1, n2, n3, n4 = map(float, n)
    if not n1 or not n2:
        return (0.5, 0.5, 0.5) if n1 or n2 or n3 or n4 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 4 * y)
    return tuple(min(max(x, 0.0), k - 1e-3) for k, x in enumerate(raw, 1))


def _shard_edges(shards: int) -> np.ndarray:
    edges = [min(i * (1 << 64) // shards, (1 << 64) - 1) for i in range(shards + 1)]
    return np.array(edges, np.uint64)


def _part_edges(types: int, parts: int) -> np.ndarray:
    """Numbers 0 to types, the begin included, dealt into ranges."""
    return np.array([(types + 1) * i // parts for i in range(parts + 1)], np.int64)


def _tokens(numbers: np.ndarray, first: np.ndarray, begin: int, end: int):
    texts = len(first) - 1
    at = first[:-1] + np.arange(texts)
    total = len(numbers) + texts
    own = np.full(total, end, np.int64)
    is_end = np.zeros(total, bool)
    is_end[first[1:] + np.arange(texts)] = True
    own[~is_end] = numbers
    before = np.empty(total, np.int64)
    before[1:] = own[:-1]
    before[at] = begin
    return before, own, np.append(at, total)


def _packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard that has keys, which are sorted within it."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    used, at = np.unique(shard, return_index=True)
    ends = np.append(at[1:], len(shard))
    for s, a, b in zip(used.tolist(), at.tolist(), ends.tolist(), strict=True):
        own = counts[a:b]
        own = own.astype(np.uint8 if own.max() < 256 else np.int64)
        # The first byte tells the counts' width.
        packed = bytes([own.itemsize]) + own.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([keys[a:b].tobytes()]), pa.array([packed])], ["shard", "keys", "counts"]
        )


def _unpack(keys: pa.ChunkedArray, counts: pa.ChunkedArray, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Merged keys and the sums of their counts."""
    k = [np.frombuffer(x.as_py(), dtype) for x in keys]
    c = []
    for x in counts:
        raw = x.as_py()
        c.append(np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.int64, offset=1).astype(np.int64))
    every, number = np.concatenate(k), np.concatenate(c)
    del k, c
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[at], np.add.reduceat(number, at)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _count_of_counts(x: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(x, 5), minlength=6)[1:5].tolist()


def train(
    docs: DataFrame,
    order: int = 2,
    buffer: int = BUFFER,
    word_shard_bytes: int = WORD_SHARD_BYTES,
    pair_shard_bytes: int = PAIR_SHARD_BYTES,
    most_types: int = 1 << 32,
) -> Model | GramModel:
    """A model of the column text of docs. Its files lie in the shared folder. Pairs of
    up to 2**32 distinct words are packed as this module tells; other orders and more
    words are hashed grams."""
    if order != 2:
        return train_grams(docs, order, buffer)
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, size / word_shard_bytes))))
    pair_shards = max(1, math.ceil(size / pair_shard_bytes))
    uri = new_folder(spark, "lm")
    edges = _shard_edges(shards)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, ends = [], 0, 0

        def send():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _packed(np.searchsorted(edges[1:-1], keys, "right"), keys, counts)

        for batch in batches:
            for low, high, data, offsets in kernel.chunks(batch.column(0)):
                words, _ = kernel.word_hashes(data, offsets)
                held.append(words)
                n, ends = n + len(words), ends + high - low
                if n >= buffer:
                    yield from send()
                    held, n = [], 0
        if n:
            yield from send()
        if ends:
            yield from _packed(np.searchsorted(edges[1:-1], np.array([END]), "right"), np.array([END]), np.array([ends]))

    def write_words(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _unpack(table.column("keys"), table.column("counts"))
        save_array(f"{uri}/word-{shard}.npy", keys)
        save_array(f"{uri}/word-count-{shard}.npy", _narrow(counts))
        # Words that may be among the very frequent: a share of the shard's tokens is no more than one of all.
        often = np.flatnonzero(counts > max(1000, int(counts.sum()) // (4 * pair_shards)))
        many = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
        return pa.table(
            {"shard": pa.array([shard], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())], "often": many(often), "times": many(counts[often])}
        )

    counted = texts.mapInArrow(count_words, _PACKED).groupBy("shard").applyInArrow(
        write_words, "shard int, types long, tokens long, often array<long>, times array<long>"
    )
    rows = {r["shard"]: r for r in counted.collect()}
    per_shard = [rows[s]["types"] if s in rows else 0 for s in range(shards)]
    starts = np.concatenate(([0], np.cumsum(per_shard))).astype(np.int64)
    types, tokens = int(starts[-1]), sum(r["tokens"] for r in rows.values())
    model = Model(uri, shards, pair_shards, max(1, math.ceil((types + 1) / 2_000_000)), types, tokens, 0, starts, np.zeros(0, np.int64))
    if not tokens:
        return model
    if types + 2 >= most_types:
        return train_grams(docs, order, buffer)
    # A word above a quarter of a pair shard is dealt by its followers: at most 4 * pair_shards words.
    limit = max(1000, tokens // (4 * pair_shards))
    hot = [np.array(r["often"], np.int64)[np.array(r["times"], np.int64) > limit] + starts[s] for s, r in rows.items()]
    begin_is_hot = [types] if int(model.counts(model.numbers(np.array([END])))[0]) > limit else []
    model.hot = np.sort(np.concatenate([*hot, np.array(begin_is_hot, np.int64)]).astype(np.int64))
    shared = spark.sparkContext.broadcast(model)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held, n = [], 0

        def send():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            shard = m.pair_shard((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            yield from _packed(shard, keys, counts)

        for batch in batches:
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                before, own, _ = m.token_numbers(*kernel.word_hashes(data, offsets))
                held.append((before.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64))
                n += len(own)
                if n >= buffer:
                    yield from send()
                    held, n = [], 0
        if n:
            yield from send()

    def write_pairs(key: tuple, table: pa.Table) -> pa.Table:
        m, shard = shared.value, key[0].as_py()
        keys, counts = _unpack(table.column("keys"), table.column("counts"))
        save_array(f"{uri}/pair-{shard}.npy", keys)
        save_array(f"{uri}/pair-count-{shard}.npy", _narrow(counts))
        first = (keys >> np.uint64(32)).astype(np.int64)
        second = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        part_edges = _part_edges(m.types, m.state_parts)
        at = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        leads = first[at]
        sums = [np.add.reduceat(x, at) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        follows, times = np.unique(second, return_counts=True)
        out = {"part": [], "kind": [], "ids": [], "values": []}
        for kind, ids, values in [*((i, leads, x) for i, x in enumerate(sums)), (4, follows, times)]:
            cuts = np.searchsorted(ids, part_edges)
            for p in range(m.state_parts):
                a, b = cuts[p], cuts[p + 1]
                if b > a:
                    v = values[a:b].astype(np.int64)
                    v = v.astype(np.uint8) if v.max() < 256 else v
                    out["part"].append(p)
                    out["kind"].append(kind)
                    out["ids"].append((ids[a:b] - part_edges[p]).astype(np.uint32).tobytes())
                    out["values"].append(bytes([v.itemsize]) + v.tobytes())
        n = len(out["part"])
        tally = [shard, len(keys), *_count_of_counts(counts)]
        return pa.table(
            {
                "part": pa.array([*out["part"], -1], pa.int32()),
                "kind": pa.array([*out["kind"], -1], pa.int32()),
                "ids": pa.array([*out["ids"], b""], pa.binary()),
                "values": pa.array([*out["values"], b""], pa.binary()),
                "tally": pa.array([None] * n + [tally], pa.list_(pa.int64())),
            }
        )

    partial = texts.mapInArrow(count_pairs, _PACKED).groupBy("shard").applyInArrow(
        write_pairs, "part int, kind int, ids binary, values binary, tally array<long>"
    )
    partial = write_table(partial, "lm-states")
    # Six numbers of each pair shard.
    of_shards = np.array([r["tally"] for r in partial.where("part < 0").select("tally").collect()])
    model.present, tallies = np.sort(of_shards[:, 0]), of_shards[:, 1:].sum(axis=0).tolist()
    model.pairs, model.discounts = tallies[0], _discounts(tallies[1:])
    edges_of_parts = _part_edges(types, model.state_parts)

    def write_states(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        kinds = table.column("kind").to_numpy()
        for kind, name in enumerate(_STATE):
            dense = np.zeros(edges_of_parts[p + 1] - edges_of_parts[p], np.int64)
            for i in np.flatnonzero(kinds == kind).tolist():
                raw = table.column("values")[i].as_py()
                values = np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.int64, offset=1)
                # Numbers are distinct within one packed row.
                dense[np.frombuffer(table.column("ids")[i].as_py(), np.uint32)] += values
            save_array(f"{uri}/{name}-{p}.npy", _narrow(dense))
        n = [*_count_of_counts(dense), int((dense >= 3).sum())]
        return pa.table({"tally": pa.array([n], pa.list_(pa.int64()))})

    got = partial.where("part >= 0").select("part", "kind", "ids", "values").groupBy("part").applyInArrow(write_states, "tally array<long>")
    lower = np.sum([r["tally"] for r in got.collect()], axis=0).tolist()
    d = model.lower_discounts = _discounts(lower[:4])
    model.lower_left = (d[0] * lower[0] + d[1] * lower[1] + d[2] * lower[4]) / model.pairs
    return model


def score(docs: DataFrame, model: Model | GramModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bottom = m.tokens + m.types + 1
        for batch in batches:
            tokens, known, base, logs = [], [], [], []
            for _, _, data, offsets in kernel.chunks(batch.column(1)):
                words, first = kernel.word_hashes(data, offsets)
                at, count, chances = m.measures(words, first)
                tokens.append(np.diff(at))
                known.append(np.add.reduceat((count > 0).astype(np.int64), at[:-1]))
                base.append(np.add.reduceat(np.log10((count + 1) / bottom), at[:-1]))
                logs.append(np.add.reduceat(chances, at[:-1]))
            n = batch.num_rows
            columns = [np.concatenate(x) if x else np.zeros(0) for x in (tokens, known, base, logs)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(columns[0].astype(np.int64)),
                    pa.array(columns[1].astype(np.int64)),
                    pa.array(np.full(n, m.tokens, np.int64)),
                    pa.array(columns[2].astype(float)),
                    pa.array(columns[3].astype(float)),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
