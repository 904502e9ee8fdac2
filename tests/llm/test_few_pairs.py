"""Pairs that are few are tried at once, whatever the lists would allow."""

from __future__ import annotations

from msgsieve.llm import ngram_join as nj
from tests.llm.test_near_threshold import near_copies


def test_no_turn_for_few_pairs(spark, monkeypatch):
    tried = []
    verified = nj._verified

    def count(pairs, *more):
        tried.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(nj, "_verified", count)
    monkeypatch.setattr(nj, "CROWDED", 4)
    monkeypatch.setattr(nj, "_at_stake", lambda rows: nj.FEW + 1)
    rows = near_copies(40, 60, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = {r.doc_id: r.component_id for r in nj.ngram_groups(docs, 4, 85).collect()}
    assert len(tried) == 2 and tried[1] <= nj.FEW  # the hubs, then all that is left
    monkeypatch.setattr(nj, "FEW", -1)
    assert found == {r.doc_id: r.component_id for r in nj.ngram_groups(docs, 4, 85).collect()}
    assert len(tried) > 4
