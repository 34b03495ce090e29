"""Conversation repair against all cheapest edits by a plain search."""

import functools
import hashlib
import random
import sys
import zlib

import pytest

from tessera.llm import conversations, registry

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conv, turn, role, text) after damage, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else text
        text = text.translate({ord(c): None for c in ".!?"}) if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out, {r[0] for r in rows}


def brute(rows):
    """Counts, cost, audit and repaired lines of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    state_of = {"s": 1, "u": 2, "a": 3}

    @functools.cache
    def best(t, state, inserted):
        """(cost, audit, lines) to the end, least by cost, then audit."""
        found = []
        if t == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if role[0] in follow[state]:
                    rest = best(t, state_of[role[0]], inserted + 1)
                    if rest:
                        found.append((rest[0] + 5, "I" + rest[1], (f"{role}:", *rest[2])))
        if t < len(rows):
            _, _, own, text = rows[t]
            rest = best(t + 1, state, 0)
            if rest:
                found.append((rest[0] + 2, "D" + rest[1], rest[2]))
            if faults[t] not in ("blank", "duplicate"):
                for letter, price, role in (("K", 0, own), ("R", 1, "user"), ("R", 1, "assistant")):
                    if role[:1] and role[0] in follow[state]:
                        rest = best(t + 1, state_of[role[0]], 0)
                        if rest:
                            found.append((rest[0] + price + 5 * (faults[t] == "truncated"), letter + rest[1], (f"{role}:{text}", *rest[2])))
        return min(found, default=None)

    cost, audit, lines = best(0, 0, 0)
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, lines)


def expected(rows, all_ids):
    groups = {i: [] for i in all_ids}
    for r in rows:
        groups[r[0]].append(r)
    return {i: brute(g) for i, g in groups.items()}


def results(out):
    return {r["conv_id"]: (*r[1:7], r["audit"], tuple(f"{x['role']}:{x['text']}" for x in r["repaired"])) for r in out.collect()}


def drawn(seed, conversations_, most):
    draw = random.Random(seed)
    rows = []
    for c in range(conversations_):
        for t in range(draw.randint(1, most)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = draw.choice(["", " \n", "one.", "two!", "open", "open ", "why? \t", None, f"t{draw.randint(0, 3)}."])
            rows.append((c if draw.random() < 0.95 else None, draw.choice([t, t, t, t + 3, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part int, place string, mark string")


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = registry.op11_conversation_repair(spark, SF)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    wanted = {i: (*w[:-1], hashlib.sha256("\n".join(w[-1]).encode()).hexdigest()) for i, w in expected(*damage(rows)).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in out.collect()} == wanted


@pytest.mark.parametrize("options", [{}, {"lot": 7}, {"limit": 3}, {"limit": 0}])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, options):
    rows = drawn(seed, 150, 9)
    got = results(conversations.repair(conversations.damaged(frame(spark, rows)), **options))
    assert got == expected(*damage(rows))


@pytest.mark.parametrize("limit", [10, 10_000])
def test_a_long_conversation(spark, limit):
    draw = random.Random(5)
    rows = [(1, t // 2, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["a.", "open", "", f"{t}.", f"{t}"])) for t in range(400)]
    rows += [(2, 0, "user", "q?"), (2, 1, "assistant", "a."), (None, 3, "user", "q?")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = results(conversations.repair(frame(spark, rows), limit=limit))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sys.setrecursionlimit(20_000)
    assert got == expected(rows, {1, 2, None})


def test_empty_and_dropped(spark):
    assert results(conversations.repair(conversations.damaged(frame(spark, [])))) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = results(conversations.repair(conversations.damaged(frame(spark, [(gone, 0, "user", "x.")]))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", ())}


def test_long_texts_and_text_ids(spark):
    text = "long " * 400_000 + "end."
    df = spark.createDataFrame([("b", 0, "user", text), ("b", 1, "assistant", text + " " * 300_000), ("a", 0, "assistant", "x" * 500_000)], "conv_id string, turn int, role string, text string")
    out = {r["conv_id"]: r for r in conversations.repair(df).collect()}
    assert out["b"]["audit"] == "KK" and out["b"]["truncated"] == 0 and out["a"]["audit"] == "D"
    assert out["b"]["repaired"][0]["text"] == text
