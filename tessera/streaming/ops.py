"""Sessions, feedback, request logs and admission: batch forms and stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import first_rows


def last_per_key(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, with `recency` 1 for the latest."""
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("recency", latest).where(F.col("recency") <= n)


def session_memory(turns: DataFrame, turns_kept: int = 6, sessions_kept: int | None = 200) -> DataFrame:
    """turns: session_id, turn, ts, q, a. The last turns of the sessions created last
    (of all, if sessions_kept is None), questions and answers cut to their limits.
    Turns without a session are left out."""
    known = turns.where("session_id is not null and session_id != ''")
    if sessions_kept is not None:
        created = known.groupBy("session_id").agg(F.min("ts").alias("created"))
        newest = first_rows(created, sessions_kept, F.col("created").desc(), F.col("session_id")).select("session_id")
        known = known.join(newest, "session_id", "left_semi")
    kept = last_per_key(known, "session_id", "turn", turns_kept)
    return kept.withColumns({"q": F.substring("q", 1, 500), "a": F.substring("a", 1, 800)})


def history_block(turns: DataFrame) -> DataFrame:
    """session_id, history of remembered turns, oldest first."""
    line = F.concat(F.lit("User: "), F.col("q"), F.lit("\nAssistant: "), F.col("a"))
    gathered = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return gathered.select("session_id", F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("history"))


def trailing_counts(events: DataFrame, key: str = "user_id", seconds: int = 60) -> DataFrame:
    """Adds in_window: the key's events in the trailing time, this one included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_t", micros).withColumn("in_window", F.count("*").over(window)).drop("_t")


def admitted(rows: Iterator[tuple[float, int]], limit: int, seconds: float, held: list[float]) -> tuple[list[tuple[int, bool]], list[float]]:
    """Sliding-log admission of (time, id) in order of time: times older than the
    window are dropped, a call is admitted if fewer than `limit` are held, and only
    admitted calls are held."""
    out = []
    for t, i in rows:
        while held and t - held[0] > seconds:
            held.pop(0)
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append((i, ok))
    return out, held


def rate_limit_batch(events: DataFrame, key: str = "user_id", limit: int = 30, seconds: float = 60.0) -> DataFrame:
    """event_id, key, admitted of every event, as one aggregate over each key's log.

    The rule is sequential within a key, so a key's events are one task's; they are
    sorted by Spark and streamed through in batches, and only the held times (at
    most `limit` for a key) stay in memory.
    """
    kind = events.schema[key].dataType.simpleString()
    seconds_of = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = events.select("event_id", key, seconds_of.alias("t")).where(F.col(key).isNotNull() & F.col("t").isNotNull())
    dealt = rows.repartition(key).sortWithinPartitions(key, "t", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted by key: only the current key's log is held, across batches.
        current, held = None, []
        for frame in frames:
            flags = []
            for k, own in frame.groupby(key, sort=False):
                if k != current:
                    current, held = k, []
                got, held = admitted(zip(own["t"], own["event_id"], strict=True), limit, seconds, held)
                flags += [ok for _, ok in got]
            yield pd.DataFrame({"event_id": frame["event_id"], key: frame[key], "admitted": flags})

    return dealt.mapInPandas(run, f"event_id long, {key} {kind}, admitted boolean")


def rate_limit_stream(events: DataFrame, key: str = "user_id", limit: int = 30, seconds: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """As rate_limit_batch on a stream: state is the held times of each key, given up
    once the stream's event time is past the key's last window. A key's rows of one
    micro-batch are sorted by time first, so the trigger bounds what is gathered; rows
    later than `late` behind the stream are dropped, as a watermark does."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    window = int(seconds * 1000)

    def run(own_key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        held = list(state.get[0]) if state.exists else []
        got, held = admitted(zip(rows["t"], rows["event_id"], strict=True), limit, seconds, held)
        state.update((held,))
        last = int(rows["t"].max() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + window + 1)
        yield pd.DataFrame({"event_id": [i for i, _ in got], key: own_key[0], "admitted": [ok for _, ok in got]})

    rows = timed.select("event_id", key, "at", (F.unix_micros("at") / 1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(
        run, f"event_id long, {key} {kind}, admitted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def vote_counts(feedback: DataFrame) -> DataFrame:
    """up, down, total of readable votes: one row."""
    return feedback.agg(
        F.coalesce(F.sum((F.col("vote") == "up").cast("long")), F.lit(0)).alias("up"),
        F.coalesce(F.sum((F.col("vote") == "down").cast("long")), F.lit(0)).alias("down"),
        F.count("vote").alias("total"),
    )


def request_counts(requests: DataFrame) -> DataFrame:
    """route (first part of the path), status, n."""
    route = F.concat(F.lit("/"), F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(2)), F.lit("")))
    return requests.groupBy(route.alias("route"), "status").agg(F.count("*").alias("n"))


def latency_summary(observations: DataFrame, route: str = "route", order: str = "ts", tie: str = "event_id", kept: int = 2000) -> DataFrame:
    """route, n, total, p50, p95 of the last observations of each route (ms).

    The percentiles are the values at places n div 2 and floor(0.95 n), from 0, of
    the sorted values; both come from row numbers, so no list is gathered.
    """
    last = F.row_number().over(Window.partitionBy(route).orderBy(F.col(order).desc(), F.col(tie).desc()))
    rows = observations.withColumn("_n", last).where(F.col("_n") <= kept)
    place = F.row_number().over(Window.partitionBy(route).orderBy("ms")) - 1
    n = F.count("*").over(Window.partitionBy(route))
    placed = rows.select(route, "ms", place.alias("place"), n.alias("n"))
    return placed.groupBy(route).agg(
        F.max("n").alias("n"),
        F.round(F.sum("ms"), 4).alias("total"),
        F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("ms"))).alias("p50"),
        F.max(F.when(F.col("place") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)), F.col("ms"))).alias("p95"),
    )


def last_values(gauges: DataFrame) -> DataFrame:
    """name, value: the latest of each gauge."""
    return gauges.groupBy("name").agg(F.max_by("value", "ts").alias("value"))


def escape_label(x: Column) -> Column:
    backslash = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(backslash, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(counters: DataFrame) -> DataFrame:
    """line of counters (name, labels map, value), sorted within labels."""
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"'))
    )
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return counters.select(F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def cached_answers(asked: DataFrame, answers: DataFrame, seconds: float = 600.0, kept: int = 128) -> DataFrame:
    """asked: query_id, key, ts; answers: key, ts, answer. The latest answer of the
    key that is young enough, among the `kept` stored last."""
    stored = answers.groupBy("key").agg(F.max(F.struct("ts", "answer")).alias("x")).select("key", F.col("x.ts").alias("stored"), "x.answer")
    stored = first_rows(stored, kept, F.col("stored").desc(), F.col("key"))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("stored").cast("timestamp"))
    joined = asked.join(stored, "key", "left")
    fresh = (age >= 0) & (age < seconds * 1e6)
    return joined.select("query_id", F.when(fresh, F.col("answer")).alias("answer"), F.coalesce(fresh, F.lit(False)).alias("hit"))


def tracked_keys(events: DataFrame, key: str = "user_id", seconds: float = 60.0, most_keys: int = 10_000) -> DataFrame:
    """key, since, last: the keys that an admission state holds at the log's end. Quiet
    keys are dropped; beyond `most_keys` those that came in first go first. A key that
    was dropped and came back counts from its return."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(key, micros.alias("t")).where(F.col(key).isNotNull() & F.col("t").isNotNull())
    own = Window.partitionBy(key).orderBy("t")
    gap = F.col("t") - F.lag("t").over(own)
    begun = rows.withColumn("begin", F.when(F.coalesce(gap > int(seconds * 1e6), F.lit(True)), F.col("t")))
    held = begun.groupBy(key).agg(F.max("begin").alias("since"), F.max("t").alias("last"))
    alive = held.crossJoin(F.broadcast(rows.agg(F.max("t").alias("now")))).where(F.col("now") - F.col("last") <= int(seconds * 1e6))
    kept = first_rows(alive, most_keys, F.col("since").desc(), F.col(key))
    return kept.select(key, F.timestamp_micros("since").alias("since"), F.timestamp_micros("last").alias("last"))


def vote_stream(feedback: DataFrame) -> DataFrame:
    """Running up, down and total of a stream of feedback, for complete output mode."""
    return vote_counts(feedback)


def feedback_log(feedback: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of feedback (id, ts, vote, ...) with each line once: a line that was sent
    again within `late` is left out, and the state of ids older than that is given up. Into
    a file sink with a checkpoint, each line is written exactly once, restarts included."""
    timed = feedback.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.where("id is not null").dropDuplicatesWithinWatermark(["id"])
