"""Streams with keyed state and first-in-first-out eviction: admission, sessions, answers.

Keys are dealt to shards, and a shard holds at most a number of keys, as each replica of a
service does; one shard caps all keys together. State lies in Spark's state store (a map of
entries, a queue of the keys by arrival, a counter), so that a restart from the checkpoint
goes on where it stopped, and what a task holds in memory is a shard's rows of one
micro-batch, which come in by time. Only the entries of keys that come up are read, and each
is read and written once a micro-batch.

The store must be RocksDB's; `rocksdb()` names it where nothing is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, PROVIDER)


class Fifo(StatefulProcessor):
    """Entries of a shard by key, in order of arrival. `seen` of an entry is the time of its
    last use; entries not used for `idle` microseconds are gone, and beyond `most` entries,
    once those are out, the first to come goes first."""

    value = ""  # fields of an entry, before `seq long, seen long`

    def __init__(self, most: int, idle: int):
        self.most, self.idle = most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", f"{self.value}, seq long, seen long")
        self.queue = handle.getMapState("queue", "seq long", "key string")
        self.ends = handle.getValueState("ends", "head long, tail long, size long, least long")

    def close(self) -> None:
        pass

    def _entry(self, key: str) -> tuple | None:
        if key not in self.near:
            self.near[key] = tuple(self.entries.getValue((key,))) if self.entries.containsKey((key,)) else None
        return self.near[key]

    def get(self, key: str, now: int) -> tuple | None:
        """The entry's fields."""
        row = self._entry(key)
        if row is None:
            return None
        if now - row[-1] > self.idle:
            self._remove(key, row[-2])
            return None
        return row

    def put(self, key: str, fields: tuple, now: int, old: tuple | None) -> None:
        """old: what get() gave."""
        if old is None:
            seq, self.tail, self.size = self.tail, self.tail + 1, self.size + 1
            self.line[seq] = key
        else:
            seq = old[-2]
        self.near[key] = (*fields, seq, now)
        self.changed.add(key)
        self.least = min(self.least, now)
        if self.size > self.most:
            self._shrink(now)

    def _remove(self, key: str, seq: int) -> None:
        self.near[key], self.line[seq] = None, None
        self.changed.add(key)
        self.size -= 1

    def _first(self) -> str | None:
        """The key at the head of the queue; none where it is gone."""
        if self.head in self.line:
            return self.line[self.head]
        return self.queue.getValue((self.head,))[0] if self.queue.containsKey((self.head,)) else None

    def _store(self) -> None:
        """Writes what changed since the last time: an entry once, however often it was used."""
        for key in self.changed:
            row = self.near[key]
            if row is not None:
                self.entries.updateValue((key,), row)
            elif self.entries.containsKey((key,)):
                self.entries.removeKey((key,))
        for seq, key in self.line.items():
            if key is not None:
                self.queue.updateValue((seq,), (key,))
            elif self.queue.containsKey((seq,)):
                self.queue.removeKey((seq,))
        self.line, self.changed = {}, set()

    def _shrink(self, now: int) -> None:
        # No entry was seen before `least`: without idle ones among them there is nothing to look for.
        if now - self.least > self.idle:
            self._store()
            rows = [(k[0], v[-2], v[-1]) for k, v in self.entries.iterator()]
            for key, seq, seen in rows:
                if now - seen > self.idle:
                    self._remove(key, seq)
            self.least = min((seen for _, _, seen in rows if now - seen <= self.idle), default=now)
        while self.size > self.most:
            key = self._first()
            if key is not None:
                self._remove(key, self.head)
            self.head += 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        self.head, self.tail, self.size, self.least = self.ends.get() if self.ends.exists() else (0, 0, 0, 1 << 62)
        # Entries by key, as read or as they will be written; keys by place in the queue; changed keys.
        self.near, self.line, self.changed = {}, {}, set()
        batch = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        out = [made for row in batch.itertuples(index=False) if (made := self.step(row)) is not None]
        self._store()
        self.near = {}
        self.ends.update((int(self.head), int(self.tail), int(self.size), int(self.least)))
        if out:
            yield pd.DataFrame(out)

    def step(self, row) -> dict | None:
        raise NotImplementedError


class _Admission(Fifo):
    value = "held array<long>"

    def __init__(self, limit: int, window: int, most: int):
        super().__init__(most, window)
        self.limit = limit

    def step(self, row) -> dict:
        now = int(row.t)
        old = self.get(row.key, now)
        held = [t for t in (old[0] if old else []) if now - t <= self.idle]
        ok = len(held) < self.limit
        self.put(row.key, ([*held, now] if ok else held,), now, old)
        return {"event_id": row.id, "key": row.key, "admitted": ok}


class _Sessions(Fifo):
    value = "turns array<struct<q:string,a:string>>"

    def __init__(self, turns: int, most: int, idle: int):
        super().__init__(most, idle)
        self.turns = turns

    def step(self, row) -> dict:
        now = int(row.t)
        old = self.get(row.key, now)
        kept = [(t[0], t[1]) for t in (old[0] if old else [])][1 - self.turns :] if self.turns > 1 else []
        kept.append((row.q, row.a))
        self.put(row.key, (kept,), now, old)
        return {"session_id": row.key, "turn": row.id, "history": "\n".join(f"User: {q}\nAssistant: {a}" for q, a in kept)}


class _Answers(Fifo):
    value = "answer string"

    def step(self, row) -> dict | None:
        now = int(row.t)
        old = self.get(row.key, now)
        if row.answer is None:
            return {"query_id": row.id, "answer": old[0] if old else None, "hit": old is not None}
        self.put(row.key, (row.answer,), now, old)
        return None


def _sharded(rows: DataFrame, shards: int, processor: StatefulProcessor, schema: str) -> DataFrame:
    rocksdb(rows.sparkSession)
    dealt = rows.where("key is not null and t is not null").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def admissions(events: DataFrame, key: str = "user_id", limit: int = 30, seconds: float = 60.0, most_keys: int = 10_000, shards: int = 64) -> DataFrame:
    """event_id, key, admitted of a stream of events (event_id, key, ts): fewer than `limit`
    admitted in the trailing time. A shard tracks up to most_keys keys: quiet ones go, then
    those that came first, and a key that was dropped starts anew."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col("event_id").cast("long").alias("id"), F.col(key).cast("string").alias("key"), _micros("ts").alias("t"))
    out = _sharded(rows, shards, _Admission(limit, int(seconds * 1e6), most_keys), "event_id long, key string, admitted boolean")
    return out.select("event_id", F.col("key").cast(kind).alias(key), "admitted")


def sessions(turns: DataFrame, turns_kept: int = 6, most: int = 200, idle_seconds: float | None = None, shards: int = 64) -> DataFrame:
    """session_id, turn, history of a stream of turns (session_id, turn, ts, q, a): what is
    remembered of the session once the turn is in, questions and answers cut to their
    limits. A shard remembers up to `most` sessions, the last created."""
    known = turns.where("session_id != ''")
    cut = [F.left(F.coalesce(c, F.lit("")), F.lit(n)).alias(c) for c, n in (("q", 500), ("a", 800))]
    rows = known.select(F.col("turn").cast("long").alias("id"), F.col("session_id").alias("key"), _micros("ts").alias("t"), *cut)
    idle = 1 << 61 if idle_seconds is None else int(idle_seconds * 1e6)
    return _sharded(rows, shards, _Sessions(turns_kept, most, idle), "session_id string, turn long, history string")


def answers(requests: DataFrame, seconds: float = 600.0, kept: int = 128, shards: int = 64) -> DataFrame:
    """query_id, answer, hit of the questions in a stream of requests (query_id, key, ts,
    answer): a row with an answer stores it, one without asks for what is stored as of its
    time and no older than `seconds`. A shard keeps `kept` keys; a stored key that is stored
    again keeps its place."""
    rows = requests.select(F.col("query_id").cast("long").alias("id"), "key", _micros("ts").alias("t"), "answer")
    return _sharded(rows, shards, _Answers(kept, int(seconds * 1e6)), "query_id long, answer string, hit boolean")


def drain(spark: SparkSession, folder: str, schema, transform, to: str, checkpoint: str, kind: str = "parquet") -> DataFrame:
    """All of a folder's rows (Parquet or another kind), as a stream, through transform into
    Parquet rows at `to`, which are read again. A later call goes on from the checkpoint
    with new files."""
    stream = spark.readStream.schema(schema).format(kind).load(folder)
    query = transform(stream).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(to)
