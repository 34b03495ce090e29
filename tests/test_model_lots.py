"""A model is asked for no more chunks than its answers ask for."""

import os
import uuid

import pytest

from tessera.operators import models


def loader(folder, every):
    """A model that gives one triple for every so many chunks, and notes what it is asked."""

    def load():
        def reply(system, prompts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(prompts))
            return ['[{"s":"a","r":"uses","o":"b"}]' if int(p.split()[1]) % every == 0 else "none" for p in prompts]

        return reply

    return load


@pytest.mark.parametrize("every", [1, 7, 10_000])
def test_lots(spark, tmp_path, every):
    chunks = spark.createDataFrame([(f"{i:05}", "d", f"vendor {i}") for i in range(1000)], "chunk_id string, doc_id string, text string")
    got = models.extract_triples(chunks, loader(tmp_path, every), most=5, lot=10)
    assert sorted(r["chunk_id"] for r in got.collect()) == [f"{i:05}" for i in range(0, 1000, every)][:5]
    asked = [line for f in os.listdir(tmp_path) for line in open(f"{tmp_path}/{f}").read().split("\n")]
    assert len(asked) == len(set(asked)) == {1: 10, 7: 30, 10_000: 1000}[every]


def test_no_chunks(spark, tmp_path):
    assert models.extract_triples(spark.createDataFrame([], "chunk_id string, doc_id string, text string"), loader(tmp_path, 1)).collect() == []
