"""Sets of a large family seek links only where they can have one."""

import random

import pytest

from tessera.llm import ngram_join
from tests.llm.test_jaccard_disk import _roots


def _chains(seed):
    """One family: sets in a row of which each is linked with the next, tied by a passage."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(20)], []
    for _ in range(12):
        own = [*passage, *(word() for _ in range(40))]
        for _ in range(5):
            rows.append(" ".join(own))
            own = list(own)
            own[draw.randrange(22, 58)] = word()
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [60, 120])
def test_seekers_go_to_blocks_that_hold_their_members(spark, monkeypatch, block):
    rows, sought, real = _chains(block), [], ngram_join._sought

    def kept(seekers, known, texts, *options):
        out = real(seekers, known, texts, *options)
        pairs = seekers.join(known.select("family", "block").distinct(), "family").select("doc_id", "block").distinct().count()
        sought.append((out.select("doc_id", "block").distinct().count(), pairs))
        return out

    monkeypatch.setattr(ngram_join, "_sought", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ngram_join.jaccard_components(docs, 3, 80, 100, block)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == _roots(rows, 3, 80)
    assert len(sought) == 1 and 0 < sought[0][0] < sought[0][1]
