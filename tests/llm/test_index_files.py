"""The index family keeps the files of its levels and no others."""

from __future__ import annotations

import os

from msgsieve.llm import suffix_index
from msgsieve.session import checkpoint_dir


def test_only_levels_stay(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, f"text {i} " + "some words that come again and again, " * 20) for i in range(12)], "doc_id long, text string")
    family = suffix_index.build_levels(docs, 100, 4)
    new = {x for x in set(os.listdir(folder)) - before if x.startswith("suffix")}
    assert {x for x in new if not x.startswith("suffix-matches")} == {os.path.basename(path) for _, path in family.levels}
    assert [size for size, _ in family.levels] == [2, 1, 1]
    assert family.repeated().count() > 0 and family.frequent() == []
