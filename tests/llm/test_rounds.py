"""Requests of chunks to slots: moved once, and in bundles only beyond what a slot can settle."""

import pytest

from dossier.llm import chunks, lm, scratch


@pytest.mark.parametrize("direct, rounds", [(4, False), (1, True)])
def test_requests_are_moved_once(spark, monkeypatch, direct, rounds):
    rows = [(i, " ".join("abcdefg"[i * k % 7] for k in range(i % 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(10)
    want = sorted(lm.score(df).collect())
    monkeypatch.setattr(chunks, "FAN", 3)
    monkeypatch.setattr(chunks, "DIRECT", direct, raising=False)
    assert 3 < chunks.pack(df).count <= 12
    before = len(scratch.written(spark))
    assert sorted(lm.score(df).collect()) == want
    assert any("dossier-merged-" in p for p in scratch.written(spark)[before:]) == rounds
