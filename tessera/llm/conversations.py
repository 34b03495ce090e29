"""Conversation structure repair by a time-major tensor of state costs.

A conversation's rows, by turn, are to become one of role initials `(s?(ua)+)?` at the
least cost. A row is kept (0), given the role user or assistant (1) or deleted (2, and
blank and repeated rows must be); an empty user or assistant row may be put in anywhere
(5); a truncated row that stays costs 5 more. The form has four states: nothing yet, after
`s`, after `u`, after `a`.

Conversations are bucketed by length (powers of two) and laid side by side, time first.
Backward over time, the costs to the end of all conversations and states are updated at
once and stored; forward, the edits of all conversations are read off at once, of equally
cheap ones the first of D, I, K, R, which gives the ASCII-least audit: a letter determines
the state that follows.

A conversation of more than `limit` rows is no single task's work. Its rows are sorted by
ranges, pieces of it are reduced to the costs between their states (a matrix by minimum
and sum), the pieces' matrices meet in one row each, and every piece then traces its own
edits from the state it is entered in. Only its one result row holds it whole.

Defined cases: a null conversation id is a conversation of its own; null roles and texts
count as one space; null turns come first and don't count for gaps; rows of one turn go by
role, then text; a role without a known initial can't be kept, an initial is judged by
case; repeated rows are duplicates; a conversation without rows has zeros and an empty
audit; very long texts pass whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import write_table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows above which a conversation is worked on in pieces.
LIMIT = 50_000
#: Rows that are repaired at once, whole conversations.
LOT = 20_000
_SPACE = " \t\n\x0b\x0c\r"
_INITIALS = {"s": 0, "u": 1, "a": 2}
#: The state after a row, by state and initial; -1 where the form doesn't allow it.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state after the row (user or assistant) that the form asks for.
_ASKED = np.array([2, 2, 3, 2])
_LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
_NEVER = 1 << 40
_END = np.array([0, _NEVER, _NEVER, 0])
_D, _I, _K, _R = b"DIKR"
REPAIRED = "array<struct<role:string,text:string>>"
_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def _closed(costs: np.ndarray) -> np.ndarray:
    """The costs where rows may be put in first: two at most, as three come back to a state."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[..., _ASKED])
    return costs


class Block:
    """Conversations side by side: arrays of time x conversations."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, time: int, code: np.ndarray, must: np.ndarray, cut: np.ndarray):
        self.time, self.n = time, np.arange(len(starts))
        self.row = starts + np.arange(time)[:, None]
        self.live = np.arange(time)[:, None] < lengths
        at = np.where(self.live, self.row, 0)
        pick = (lambda a: a[at]) if len(code) else (lambda a: np.zeros(at.shape, a.dtype))
        self.code, self.must, self.cut = pick(code), pick(must), pick(cut) * TRUNCATED

    def four(self) -> Block:
        """The only conversation of the block, four times."""
        wide = Block.__new__(Block)
        wide.time, wide.n = self.time, np.arange(4)
        for name in ("row", "live", "code", "must", "cut"):
            setattr(wide, name, np.repeat(getattr(self, name), 4, axis=1))
        return wide

    def backward(self, end: np.ndarray) -> np.ndarray:
        """Costs to the end, by time, conversation and state; end: those after the last row."""
        costs = np.empty((self.time + 1, len(self.n), 4), np.int64)
        costs[-1] = _closed(end)
        for t in range(self.time - 1, -1, -1):
            after = costs[t + 1]
            stays = np.where(self.must[t], _NEVER, self.cut[t])[:, None]
            kept = _KEPT[:, self.code[t]].T
            keep = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1), _NEVER)
            best = np.minimum(after + DELETE, stays + np.minimum(keep, REROLE + after[:, _ASKED]))
            costs[t] = np.where(self.live[t][:, None], _closed(best), after)
        return costs

    def trace(self, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters and states after them (slots x conversations: two insertions and an edit
        for each time, two insertions at the end), and the last state. Rows are put in at
        the end only of those that `last` marks."""
        letters = np.zeros((3 * self.time + 2, len(self.n)), np.uint8)
        after = np.zeros(letters.shape, np.int8)

        def insert(slot: int, where: np.ndarray) -> np.ndarray:
            moved = np.where(where, _ASKED[state], state)
            letters[slot], after[slot] = np.where(where, _I, 0), moved
            return moved

        for t in range(self.time):
            live, now, then = self.live[t], costs[t], costs[t + 1]
            for k in range(2):
                here = now[self.n, state]
                drop = then[self.n, state] + DELETE == here
                state = insert(3 * t + k, live & ~drop & (INSERT + now[self.n, _ASKED[state]] == here))
            here = now[self.n, state]
            drop = then[self.n, state] + DELETE == here
            kept = _KEPT[state, self.code[t]]
            keep = (kept >= 0) & ~self.must[t] & (self.cut[t] + then[self.n, np.maximum(kept, 0)] == here)
            letters[3 * t + 2] = np.where(live, np.where(drop, _D, np.where(keep, _K, _R)), 0)
            state = np.where(~live | drop, state, np.where(keep, kept, _ASKED[state]))
            after[3 * t + 2] = state
        for k in range(2):
            state = insert(3 * self.time + k, last & (state != 0) & (state != 3))
        return letters, after, state

    def written(self, letters: np.ndarray, after: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Audits and repaired rows of the conversations."""
        slots = np.repeat(np.arange(self.time + 1), 3)[: len(letters)]
        row = np.vstack([self.row, np.full((1, len(self.n)), -1)])[slots].T
        letter, state = letters.T, after.T
        audits = _strings(letter[letter > 0], (letter > 0).sum(1))
        stays = (letter > 0) & (letter != _D)
        letter, state, row, sizes = letter[stays], state[stays], row[stays], stays.sum(1)
        source = pa.array(row, mask=letter == _I)
        given = pa.array(np.where(state == 2, "user", "assistant"), pa.string())
        role = pc.if_else(pa.array(letter == _K), roles.take(source), given)
        turns = pa.StructArray.from_arrays([role, texts.take(source).fill_null("")], fields=list(_TURN))
        return audits, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), turns)


def _strings(characters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(characters.astype(np.uint8).tobytes()))


def _initials(roles: pa.Array) -> np.ndarray:
    coded = pc.utf8_slice_codeunits(roles, 0, 1).dictionary_encode()
    names = np.array([_INITIALS.get(c, 3) for c in coded.dictionary.to_pylist()] or [3])
    return names[coded.indices.to_numpy(zero_copy_only=False)] if len(roles) else np.zeros(0, np.int64)


def _bits(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _no_repeats(table: pa.Table, conversation: np.ndarray) -> np.ndarray:
    """Rows whose role and text an earlier row of the conversation has."""
    role, text = (table[c].combine_chunks().dictionary_encode() for c in ("role", "text"))
    pair = role.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(text.dictionary) + 1) + text.indices.to_numpy(zero_copy_only=False)
    pair = np.unique(pair, return_inverse=True)[1] + conversation * (len(table) + 1)
    again = np.ones(len(table), bool)
    again[np.unique(pair, return_index=True)[1]] = False
    return again


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Rows whose value differs from that of the row before; nulls equal each other."""
    column = column.combine_chunks()
    a, b = column[1:], column[:-1]
    missing = lambda c: c.is_null().to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (missing(a) != missing(b))
    return np.r_[True, other.astype(bool)][: len(column)]


def _span(turns: list) -> tuple:
    """Least, greatest and number of distinct turns of rows in order, nulls aside."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _gaps(first, last, distinct: int) -> int:
    return 0 if first is None else min(last - first + 1 - distinct, (1 << 63) - 1)


def _repair_lot(table: pa.Table) -> pa.Table:
    """Results of whole conversations, in order. Rows without `copy` only name one."""
    begins = _changes(table["conv_id"])
    ids = table["conv_id"].combine_chunks().take(pa.array(np.flatnonzero(begins)))
    conversation = np.cumsum(begins) - 1
    real = table["copy"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    table, conversation, n = table.filter(pa.array(real)), conversation[real], len(ids)
    roles, texts = (table[c].combine_chunks() for c in ("role", "text"))
    code, blank = _initials(roles), _bits(table["blank"])
    again = _no_repeats(table, conversation) & ~blank
    must = blank | again
    cut = _bits(table["unended"]) & ~must
    follows = conversation[1:] == conversation[:-1]
    illegal = np.r_[False, follows & ~_LEGAL[code[:-1], code[1:]]][: len(code)]
    total = lambda mark: np.bincount(conversation[mark], minlength=n)
    lengths = np.bincount(conversation, minlength=n)
    starts, turns = np.cumsum(lengths) - lengths, table["turn"].to_pylist()
    gaps = [_gaps(*_span(turns[a : a + m])) for a, m in zip(starts.tolist(), lengths.tolist(), strict=True)]
    cost, order, audits, repaired = np.zeros(n, np.int64), [], [], []
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        block = Block(starts[own], lengths[own], 1 << int(b), code, must, cut)
        costs = block.backward(np.tile(_END, (len(own), 1)))
        letters, after, _ = block.trace(costs, np.zeros(len(own), np.int64), np.ones(len(own), bool))
        audit, turned = block.written(letters, after, roles, texts)
        cost[own] = costs[0, :, 0]
        order.append(own)
        audits.append(audit)
        repaired.append(turned)
    back = pa.array(np.argsort(np.concatenate(order)))
    columns = [gaps, *map(total, (blank, again, cut, illegal)), cost]
    return pa.Table.from_arrays(
        [ids, *(pa.array(c, pa.int64()) for c in columns), pa.concat_arrays(audits).take(back), pa.concat_arrays(repaired).take(back)],
        ["conv_id", *_FIELDS, "audit", "repaired"],
    )


def _repair(lot: int):
    """Batches of rows by conversation, in order, to results: whole conversations at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if len(held) < lot:
                continue
            last = int(np.flatnonzero(_changes(held["conv_id"]))[-1])
            if last:
                yield from _repair_lot(held.slice(0, last)).combine_chunks().to_batches()
                held = held.slice(last)
        if held is not None and len(held):
            yield from _repair_lot(held).combine_chunks().to_batches()

    return run


def _piece(table: pa.Table) -> tuple[pa.Table, Block, np.ndarray, np.ndarray, np.ndarray]:
    table = table.sort_by("place").combine_chunks()
    blank = _bits(table["blank"])
    again = _bits(table["again"]) & ~blank
    cut = _bits(table["unended"]) & ~blank & ~again
    code = table["code"].to_numpy().astype(np.int64)
    return table, Block(np.zeros(1, np.int64), np.array([len(table)]), len(table), code, blank | again, cut), blank, again, cut


_SUMMARY = "part int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, begins int, ends int, matrix array<long>"
_TOTALS = ", ".join(f"{c} long" for c in _FIELDS)
_BOUNDS = f"part int, after array<long>, last boolean, {_TOTALS}"
_NAMES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[dict], fields: str, table: pa.Table) -> pa.Table:
    """rows as a table of conv_id, as `table` has it, and the fields."""
    kinds = [(name, _NAMES[kind]) for name, kind in (f.split() for f in fields.split(", "))]
    return pa.Table.from_pylist(rows, pa.schema([("conv_id", table.schema.field("conv_id").type), *kinds]))


def _summary(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A piece's counts, ends, and costs from each state to each."""
    table, block, blank, again, cut = _piece(table)
    code = table["code"].to_numpy()
    low, high, turns = _span(table["turn"].to_pylist())
    # By the state at the end, then by that at the start.
    costs = block.four().backward(np.where(np.eye(4, dtype=bool), 0, _NEVER))[0]
    row = {"conv_id": key[0].as_py(), "part": key[1].as_py(), "low": low, "high": high, "turns": turns}
    row |= {"blank": int(blank.sum()), "duplicate": int(again.sum()), "truncated": int(cut.sum()), "illegal": int((~_LEGAL[code[:-1], code[1:]]).sum())}
    row |= {"begins": int(code[0]), "ends": int(code[-1]), "matrix": costs.T.reshape(-1).tolist()}
    return _table([row], _SUMMARY, table)


def _bounds(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The costs after each piece of a conversation, and the conversation's counts."""
    pieces = table.sort_by("part").to_pylist()
    after, out = _END, []
    for p in reversed(pieces):
        out.append({"conv_id": p["conv_id"], "part": p["part"], "after": after.tolist(), "last": not out})
        after = _closed((np.array(p["matrix"]).reshape(4, 4) + _closed(after)).min(1))
    known = [p for p in pieces if p["turns"]]
    shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    totals = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
    totals["illegal"] += sum(not _LEGAL[a["ends"], b["begins"]] for a, b in zip(pieces, pieces[1:], strict=False))
    totals["gaps"] = _gaps(known[0]["low"], known[-1]["high"], sum(p["turns"] for p in known) - shared) if known else 0
    totals["cost"] = int(after[0])
    return _table([p | totals for p in out], _BOUNDS, table)


def _exits(key: tuple[pa.Scalar, ...], rows: pa.Table, bounds: pa.Table) -> pa.Table:
    """The state in which a piece is left, by that in which it is entered."""
    wide = _piece(rows)[1].four()
    costs = wide.backward(np.tile(np.array(bounds["after"][0].as_py()), (4, 1)))
    *_, state = wide.trace(costs, np.arange(4), np.zeros(4, bool))
    return bounds.append_column("exits", pa.array([state.tolist()], pa.list_(pa.int64())))


def _entries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The state in which each piece of a conversation is entered."""
    table = table.sort_by("part")
    states = [0]
    for exits in table["exits"].to_pylist():
        states.append(exits[states[-1]])
    return table.drop_columns(["exits"]).append_column("entry", pa.array(states[:-1], pa.int32()))


def _edited(key: tuple[pa.Scalar, ...], rows: pa.Table, bounds: pa.Table) -> pa.Table:
    """The audit and the repaired rows of a piece."""
    rows, block, *_ = _piece(rows)
    bound = bounds.to_pylist()[0]
    costs = block.backward(np.array([bound["after"]]))
    letters, after, _ = block.trace(costs, np.array([bound["entry"]]), np.array([bound["last"]]))
    audit, repaired = block.written(letters, after, rows["role"].combine_chunks(), rows["text"].combine_chunks())
    return bounds.drop_columns(["after", "last", "entry"]).append_column("audit", audit).append_column("repaired", repaired)


def _repair_in_pieces(rows: DataFrame, kind: str) -> DataFrame:
    """conv_id, counts, audit, repaired of conversations of any length."""
    by = ("conv_id", "turn", "role")
    ordered = rows.repartitionByRange(*by, F.left("text", F.lit(32))).sortWithinPartitions(*by, "text")
    mark = F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.col("text")).cast("binary"))
    first = F.left("role", F.lit(1))
    code = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    placed = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), mark.alias("mark"), code.alias("code"))
    placed = write_table(placed, "conversation-rows")
    first = placed.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min("place").alias("first"))
    again = placed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m"))).withColumn("again", F.col("place") > F.col("first"))
    judged = write_table(again.drop("c", "m", "first", "mark", "copy"), "conversation-pieces")
    narrow = judged.drop("role", "text").groupBy("conv_id", "part")
    # One row a piece, and as many pieces as ranges at most.
    summary = narrow.applyInArrow(_summary, f"conv_id {kind}, {_SUMMARY}")
    bounds = write_table(summary.groupBy("conv_id").applyInArrow(_bounds, f"conv_id {kind}, {_BOUNDS}"), "conversation-bounds")
    exits = narrow.cogroup(bounds.groupBy("conv_id", "part")).applyInArrow(_exits, f"conv_id {kind}, {_BOUNDS}, exits array<long>")
    entries = exits.groupBy("conv_id").applyInArrow(_entries, f"conv_id {kind}, {_BOUNDS}, entry int")
    edited = judged.groupBy("conv_id", "part").cogroup(entries.groupBy("conv_id", "part")).applyInArrow(
        _edited, f"conv_id {kind}, part int, {_TOTALS}, audit string, repaired {REPAIRED}"
    )
    pieces = F.array_sort(F.collect_list(F.struct("part", "audit", "repaired")))
    whole = edited.groupBy("conv_id").agg(*(F.first(c).alias(c) for c in _FIELDS), pieces.alias("p"))
    return whole.select(
        "conv_id", *_FIELDS, F.array_join(F.transform("p", lambda p: p["audit"]), "").alias("audit"), F.flatten(F.transform("p", lambda p: p["repaired"])).alias("repaired")
    )


def repair(rows: DataFrame, limit: int = LIMIT, lot: int = LOT) -> DataFrame:
    """rows: conv_id, turn, role, text, and `copy`, null in rows that only name their
    conversation (none are without that column). A row for each conversation: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role and text of its
    rows, in order)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(" "))
    end = F.right(F.rtrim(text, F.lit(_SPACE)), F.lit(1))
    plain = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        (F.col("copy") if "copy" in rows.columns else F.lit(0)).cast("int").alias("copy"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("unended"),
    )
    large = plain.where("copy is not null").groupBy("conv_id").count().where(F.col("count") > limit).select(F.col("conv_id").alias("l"))
    large = write_table(large, "large-conversations")
    schema = f"conv_id {kind}, {_TOTALS}, audit string, repaired {REPAIRED}"
    whole = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repair(lot), schema)
    if large.isEmpty():
        return whole(plain)
    same = F.col("conv_id").eqNullSafe(F.col("l"))
    pieces = plain.where("copy is not null").join(large, same, "left_semi")
    return whole(plain.join(large, same, "left_anti")).unionByName(_repair_in_pieces(pieces, kind))


def damaged(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, damaged by a checksum of `conv_id:turn`: one in twenty
    is dropped (its conversation stays, by a row without `copy`), one emptied, one loses its
    sentence ends, one is there twice, one becomes a user's. Nulls read as one space."""
    space = F.lit(" ")
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    draw = F.crc32(named.cast("binary")) % 20
    copies = F.when(F.col("draw") == 0, F.array().cast("array<int>")).when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    read = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), draw.alias("draw"))
    return read.select(
        "conv_id",
        "turn",
        F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") <= 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode_outer(copies).alias("copy"),
    )
