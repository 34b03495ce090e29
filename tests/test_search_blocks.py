"""What a search task holds at once, whatever lies in a batch."""

import pyarrow as pa

from tessera.operators import search


def test_blocks_are_bounded_by_tokens_and_rows(monkeypatch):
    monkeypatch.setattr(search, "TOKENS", 10)
    sizes = [3, 3, 3, 3, 25, 0, 0, 4, 7, 10, 0]
    tokens = pa.array([["t"] * n for n in [9, *sizes]]).slice(1)
    blocks = list(search._blocks(tokens, 4))
    assert [at for at, _ in blocks] == [sum(n for _, n in blocks[:i]) for i in range(len(blocks))] and sum(n for _, n in blocks) == len(sizes)
    assert all(n == 1 or (n <= 4 and sum(sizes[at : at + n]) <= 10) for at, n in blocks)
    assert list(search._blocks(tokens.slice(0, 0), 4)) == []


def test_hits_do_not_depend_on_blocks(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id as chunk_id", "concat_ws(' ', 'a', id % 7, repeat('b ', id % 5), id % 11) as text").coalesce(1)
    asked = spark.createDataFrame([(1, "a b 3"), (2, "b b 10")], "query_id int, text string")
    want = sorted(map(tuple, search.bm25_topk(docs, asked, 20).collect()))
    monkeypatch.setattr(search, "TOKENS", 7)
    assert sorted(map(tuple, search.bm25_topk(docs, asked, 20).collect())) == want and len(want) == 40
