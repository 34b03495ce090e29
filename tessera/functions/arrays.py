"""Array helpers in time near linear: appending to an array copies it, so running
totals are made in blocks, and the blocks' totals once more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _scan(values: Column, zero: Column, add: Callable) -> Column:
    return F.aggregate(values, F.array(zero), lambda acc, x: F.array_append(acc, add(F.element_at(acc, -1), x)))


def _blocks(values: Column, size: int, zero: Column, add: Callable) -> Column:
    """The running totals of each block by itself; each has one entry more than values."""
    count = F.ceil(F.size(values) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: _scan(F.slice(values, i * size + 1, size), zero, add))


def _lifted(blocks: Column, starts: Column, add: Callable) -> Column:
    """The blocks' totals on top of what came before each, less their last entries."""

    def lift(b: Column, i: Column) -> Column:
        start = F.get(starts, i)
        return F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: add(start, x))

    return F.flatten(F.transform(blocks, lift))


def running(values: Column, zero: Column | None = None, add: Callable = _add, block: int = BLOCK) -> Column:
    """zero, zero + v1, zero + v1 + v2 and so on: the totals before each value and, last,
    of all. `add` must be associative; zero has the values' type, long by default."""
    zero = F.lit(0).cast("long") if zero is None else zero

    def of(v: Column) -> Column:
        def whole(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.element_at(b, -1))
            return let(
                _scan(totals, zero, add), lambda s: F.concat(_lifted(blocks, s, add), F.slice(s, -1, 1))
            )

        return F.when(F.size(v) > 0, let(_blocks(v, block, zero, add), whole)).otherwise(F.array(zero))

    return let(values, of)
