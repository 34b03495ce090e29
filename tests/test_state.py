"""Streams with state against plain simulations, across a restart from the checkpoint."""

import random

import pandas as pd
import pytest

from tessera.streaming import state

DAY = 1_700_000_000


def run(spark, tmp_path, rows, schema, transform, pieces=3):
    """Feeds rows in pieces, each a run of its own that takes up the checkpoint."""
    out, size = None, -(-len(rows) // pieces)
    for i in range(pieces):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = state.drain(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, transform, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return out.collect()


def simulate(rows, idle, most, step):
    """rows: (id, key, t, ...); entries in order of arrival: key -> [value, seen]."""
    held, out = {}, {}
    for row in rows:
        key, now = row[1], row[2]
        if key in held and now - held[key][1] > idle:
            del held[key]
        new, made = step(held[key][0] if key in held else None, row)
        if made is not None:
            out[row[0]] = made
        if new is not None:
            if key in held:
                held[key][:] = [new, now]
            else:
                held[key] = [new, now]
            if len(held) > most:
                for k in [k for k, v in held.items() if now - v[1] > idle]:
                    del held[k]
                while len(held) > most:
                    del held[next(iter(held))]
    return out


@pytest.mark.parametrize("most", [5, 1000])
def test_admission(spark, tmp_path, most):
    draw = random.Random(most)
    t, rows = DAY, []
    for i in range(400):
        t += draw.choice([0, 1, 5, 30])
        rows.append((i, f"k{draw.randint(0, 12)}", t))

    def step(held, row):
        held = [x for x in held or [] if row[2] - x <= 60]
        ok = len(held) < 2
        return (held + [row[2]] * ok), ok

    want = simulate(rows, 60, most, step)
    got = run(spark, tmp_path, rows, "event_id long, user string, s long", lambda s: state.admissions(s.selectExpr("event_id", "user", "timestamp_seconds(s) as ts"), "user", 2, 60, most, 1))
    assert {r["event_id"]: r["admitted"] for r in got} == want and not all(want.values())


@pytest.mark.parametrize("most", [3, 1000])
def test_sessions(spark, tmp_path, most):
    draw = random.Random(most)
    rows = [(i, f"s{draw.randint(0, 6)}", DAY + i, f"q{i}", f"a{i}") for i in range(120)]

    def step(turns, row):
        turns = ((turns or []) + [(row[3], row[4])])[-3:]
        return turns, "\n".join(f"User: {q}\nAssistant: {a}" for q, a in turns)

    want = simulate(rows, 1 << 60, most, step)
    got = run(spark, tmp_path, rows, "turn long, session_id string, s long, q string, a string", lambda s: state.sessions(s.selectExpr("*", "timestamp_seconds(s) as ts"), 3, most, shards=1))
    assert {r["turn"]: r["history"] for r in got} == want


@pytest.mark.parametrize("kept", [4, 1000])
def test_answers(spark, tmp_path, kept):
    draw = random.Random(kept)
    t, rows = DAY, []
    for i in range(300):
        t += draw.choice([0, 10, 100])
        rows.append((i, f"k{draw.randint(0, 9)}", t, f"answer {i}" if draw.random() < 0.4 else None))
    want = simulate(rows, 600, kept, lambda old, row: (row[3], None) if row[3] is not None else (None, old))
    # An ask without a hit is an answer, too.
    want = {i: want.get(i) for i, _, _, a in rows if a is None}
    got = run(spark, tmp_path, rows, "query_id long, key string, s long, answer string", lambda s: state.answers(s.selectExpr("*", "timestamp_seconds(s) as ts"), 600, kept, 1))
    assert {r["query_id"]: r["answer"] for r in got} == want
    assert all(r["hit"] == (r["answer"] is not None) for r in got)


class _Calls(dict):
    """A map state that counts what is asked of it."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def __getattr__(self, name):
        verbs = {"containsKey": lambda k: k in self, "getValue": lambda k: self[k], "updateValue": self.__setitem__, "removeKey": self.__delitem__, "iterator": lambda: iter(list(self.items()))}

        def call(*args):
            self.calls += 1
            return verbs[name](*args)

        return call


def test_an_entry_is_read_and_written_once_a_batch():
    class Ends:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    processor = state._Admission(2, 60_000_000, 1000)
    processor.entries, processor.queue, processor.ends = _Calls(), _Calls(), Ends()
    rows = pd.DataFrame({"id": range(5000), "key": [f"k{i % 10}" for i in range(5000)], "t": [i * 1_000_000 for i in range(5000)]})
    assert sum(len(x) for x in processor.handleInputRows((0,), iter([rows]), None)) == 5000
    # Ten keys: asked for, read, written, and in the queue.
    assert len(processor.entries) == 10 and processor.entries.calls + processor.queue.calls <= 40
