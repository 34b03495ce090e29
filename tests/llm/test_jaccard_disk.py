"""What the Jaccard join sends: texts stay where they are, members go packed."""

import random

import pytest

from tessera.llm import ngram_join


def _texts(seed=3):
    """Families of near copies above a block, texts that share only a passage, others."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(30)], []
    for _ in range(6):
        base = [word() for _ in range(60)]
        for _ in range(6):
            copy = list(base)
            copy[draw.randrange(60)] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(40)]) for _ in range(20)]
    rows += [" ".join(word() for _ in range(50)) for _ in range(40)] + [None, "", "two words"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def _roots(rows, width, num):
    sets = [(i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := (t or "").split()) else set()) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= num * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_texts_are_not_dealt_by_id_where_few_ids_are_sought(spark, monkeypatch, few):
    rows, plans, write = _texts(), {}, ngram_join.write_table

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(ngram_join, "write_table", kept)
    monkeypatch.setattr(ngram_join, "FEW_IDS", few)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.keep_one(docs, width=5, num=80, den=100, block_members=150)
    want = _roots(rows, 5, 80)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i in want if want[i] == i)
    assert len(set(want.values())) < len(want)
    # Members are no rows of a table.
    assert "members" not in plans
    plans["kept"] = out._jdf.queryExecution().executedPlan().toString()
    for name in ("candidates", "kept"):
        assert ("hashpartitioning" in plans[name]) == (few == 0)


def test_members_of_another_set_are_counted_whole(spark):
    """A set stays if the others of its family hold its threshold of members, and goes if not."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in _texts(4) if (w := (t or "").split())}
    family = lambda i: i % 2
    met = {i: sum(any(m in b for j, b in sets.items() if j != i and family(i) == family(j)) for m in a) for i, a in sets.items()}
    texts = spark.createDataFrame(_texts(4), "doc_id long, text string")
    large = spark.createDataFrame([(family(i), i, len(a)) for i, a in sets.items()], "family long, doc_id long, n_shingles long")
    got = {r["doc_id"] for r in ngram_join._able(large, texts, 80, 100, 5).collect()}
    assert got == {i for i, a in sets.items() if 100 * met[i] >= 80 * len(a)}
    assert 0 < len(got) < len(sets)
