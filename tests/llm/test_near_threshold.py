"""Near copies of which a part links: their groups are found without trying a share of all pairs."""

from __future__ import annotations

import random

from msgsieve.llm import ngram_join as nj


def near_copies(n: int, words: int, edits: int) -> list[tuple[int, str]]:
    r = random.Random(1)
    base = [f"w{r.randrange(3000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(edits):
            text[r.randrange(words)] = f"x{r.randrange(40)}"
        rows.append((i + 1, " ".join(text)))
    return rows


def test_pairs_stay_few(spark, monkeypatch):
    tried = []
    verified = nj._verified

    def count(pairs, *more):
        pairs = nj.cut_lineage(pairs)
        tried.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(nj, "_verified", count)
    monkeypatch.setattr(nj, "FEW", 0, raising=False)
    monkeypatch.setattr(nj, "TURNS", 1, raising=False)
    rows = near_copies(100, 160, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = {r.doc_id: r.component_id for r in nj.ngram_groups(docs, 4, 85).collect()}
    grams = {i: {tuple(w[k:k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a < b and 100 * len(grams[a] & grams[b]) >= 85 * len(grams[a] | grams[b]) and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {i: new if c == old else c for i, c in want.items()}
    assert found == want
    # Two hubs for each n-gram first; then at most one pair a text and turn.
    assert tried[1] <= len(rows)
