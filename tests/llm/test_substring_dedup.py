"""Substring dedup against every window's words."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import kernel, substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width):
    """(id, words, removed, kept) of each row; ids without nulls come first."""
    order = lambda i: (i is None, i if i is not None else 0)
    first, per_row = {}, {}
    for at, (i, text) in enumerate(rows):
        w = words(text)
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, order(i)), order(i))
            per_row.setdefault((at, s), k)
    out = []
    for at, (i, text) in enumerate(rows):
        w = words(text)
        gone = set()
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            if first[s] < order(i) or per_row[at, s] < k:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, id string")
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(df, **options).collect()), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    passages = [" ".join(draw.choices("abcdefgh", k=draw.randint(2, 30))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.5 else " ".join(draw.choices("ABCDEF", k=draw.randint(0, 12))) for _ in range(draw.randint(0, 6))]
        texts.append(draw.choice([" ", "\n", "\t  "]).join(parts))
    return texts


@pytest.mark.parametrize("options", [{}, {"chunk_chars": 500, "range_chars": 300}])
@pytest.mark.parametrize("width", [1, 3, 20])
def test_equals_brute_force(spark, width, options):
    rows = list(enumerate(corpus(width, 120)))
    random.Random(1).shuffle(rows)
    got = run(spark, rows, width=width, **options)
    assert got == brute(rows, width)
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("options", [{}, {"chunk_chars": 40, "range_chars": 30}])
def test_awkward_rows(spark, options):
    rows = [
        (None, None), (None, "a b c d e"), (None, "a b c d e"), (1, ""), (2, " \n "), (3, "a b"), (4, "x a b c d y a b c d"),
        (4, "x a b c d y a b c d"), (4, "q a b c"), (5, "a b a b c d e"), (6, "lorem " * 3000), (7, "Straße\x0bübt\x0cdas Straße übt das"),
    ]
    assert run(spark, rows, width=3, **options) == brute(rows, 3)


def test_empty_and_long(spark):
    assert run(spark, []) == []
    text = " ".join(str(i) for i in range(300_000))
    got = run(spark, [(1, text), (2, "start " + text)], width=20)
    assert got == [(1, 300_000, 0, text), (2, 300_001, 300_000, "start")]


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "k l m n"), ("a", "k l m o")], "doc_id string, text string")
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(df, 3).collect()) == [("a", 4, 0, "k l m o"), ("b", 4, 3, "n")]


def test_a_hot_passage_is_sent_once_a_chunk():
    """However many documents share a passage, a chunk sends its hashes once."""
    passage = " ".join(f"w{i}" for i in range(40))
    table = pa.table({"id": pa.array(range(300)), "text": pa.array([f"{passage} own{i}" for i in range(300)])})
    sent = substring_dedup._sent(20, 4, pa.int64())((pa.scalar(0),), table)
    assert sum(len(substring_dedup._unpacked(b.as_py())) for b in sent["hashes"]) == 21 + 300


def test_packing():
    for numbers in (np.array([7], np.uint64), np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64)), np.array([0, 1, (1 << 64) - 1], np.uint64)):
        assert (substring_dedup._unpacked(substring_dedup._packed(numbers)) == numbers).all()


def test_rolling_hashes():
    data = np.frombuffer(b"a b c a b c d", np.uint8)
    own, _ = kernel.word_hashes(data, np.array([0, len(data)]), fold=False)
    h = kernel.rolling_hashes(own, 3)
    assert len(h) == 5 and h[0] == h[3] and len(set(h.tolist())) == 4
    assert len(kernel.rolling_hashes(own, 8)) == 0
