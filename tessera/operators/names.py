"""Names within texts: one automaton of all names, one pass over a text.

An Aho-Corasick automaton finds every name that a text holds in time that grows with the
text and its matches, however many names there are. Names go to the workers once their
size is known; beyond NAME_CHARS characters they are dealt by a hash of their first
characters into lots of that size, and texts pass by one lot after another. Names are
compared as they come: lower both sides first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of names that go to every worker at once.
NAME_CHARS = 1_000_000
#: First characters by which names are dealt.
HEAD = 3


def automaton(names: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, name in enumerate(names):
        machine.add_word(name, i)
    machine.make_automaton()
    return machine


def _found(shared, key_types: list[pa.DataType], keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        machine = automaton(names) if names else None
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                # Each name once a text.
                for n in sorted({n for _, n in machine.iter(text)}) if text and machine else ():
                    rows.append(i)
                    hits.append(names[n])
            at = pa.array(rows, pa.int64())
            columns = [batch.column(c).cast(t).take(at) for c, t in enumerate(key_types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.string())], [*keys, "name"])

    return run


def occurrences(texts: DataFrame, names: DataFrame, keys: list[str] | tuple[str, ...] = ("id",)) -> DataFrame:
    """keys and name of every row of texts (keys, text) and every name (column name) that
    is part of its text. Null texts and names and empty names match nothing; a name counts
    once a row."""
    keys, spark = list(keys), texts.sparkSession
    known = names.select("name").where("name is not null and name != ''").distinct()
    chars = known.agg(F.sum(F.length("name"))).first()[0] or 0
    if not chars:
        return texts.select(*keys, F.lit(None).cast("string").alias("name")).where("false")
    lots = -(-chars // NAME_CHARS)
    types = [texts.schema[k].dataType for k in keys]
    schema = ", ".join([*(f"{k} {t.simpleString()}" for k, t in zip(keys, types, strict=True)), "name string"])
    rows, out = texts.select(*keys, "text").where("text is not null"), None
    head = lambda c: F.pmod(F.xxhash64(F.left(c, F.lit(HEAD))), F.lit(lots))
    for lot in range(lots):
        held = sorted(r[0] for r in (known.where(head(F.col("name")) == lot) if lots > 1 else known).collect())
        shared = spark.sparkContext.broadcast(held)
        found = rows.mapInArrow(_found(shared, [to_arrow_type(t) for t in types], keys), schema)
        out = found if out is None else out.unionByName(found)
    return out


def outermost(found: DataFrame, keys: list[str] | tuple[str, ...] = ("id",), name: str = "name") -> DataFrame:
    """found (keys, name) without the names that lie within a longer one of the same keys."""
    keys = list(keys)
    types = [found.schema[k].dataType for k in keys]
    # What one text names, by keys: a row for each name.
    held = found.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for i, names in enumerate(batch.column(len(keys)).to_pylist()):
                machine, inner = automaton(names), set()
                for longer in names:
                    inner |= {names[n] for _, n in machine.iter(longer)} - {longer}
                for n in names:
                    if n not in inner:
                        rows.append(i)
                        hits.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(to_arrow_type(t)).take(at) for c, t in enumerate(types)), pa.array(hits, pa.string())], [*keys, name])

    schema = ", ".join([*(f"{k} {t.simpleString()}" for k, t in zip(keys, types, strict=True)), f"{name} string"])
    return held.mapInArrow(run, schema)
