"""The classifier counts, packs and scores a text where it lies; rows of repeated or missing ids give what joins gave."""
import random

import pytest
from pyspark.sql import functions as F

from msgsieve.models import text_model as tm


def rows(spark, seed, odd=True):
    rng = random.Random(seed)
    words = ["pay", "now", "über", "日本語", "x\U0001f600y", "no-reply", "0"] + [f"w{k}" for k in range(60)]
    data = [(k, " ".join(rng.choice(words[:rng.randint(2, 66)]) for _ in range(rng.randint(0, 30))), k % 2, float(k % 3)) for k in range(120)]
    if odd:
        data += [(3, "pay now pay w5", 0, 1.0), (3, "pay", 1, None), (None, "pay now", 0, 2.0), (500, None, 1, 0.0), (501, " ", 0, 1.0)]
    return spark.createDataFrame(data, "id long, text string, label int, s double").repartition(3)


@pytest.fixture
def small(monkeypatch):
    for name, size in (("WORD_TERMS", 40), ("CHAR_TERMS", 25), ("CELLS", 4096)):
        monkeypatch.setattr(tm, name, size)


def old_vocabulary(df):
    counts = tm.term_counts(df)
    return tm.fit_vocabulary(counts, df.count(), tm.some_counts(df))


def sums(frame):
    return {(r["id"], r["label"], tuple(r["features"].indices), tuple(round(float(v), 9) for v in r["features"].values)) for r in frame.collect()}


def test_vocabulary(spark, small):
    df = rows(spark, 1)
    got, want = ({(r.kind, r.term): (r.idx, round(r.idf, 9)) for r in v.collect()} for v in (tm.vocabulary_of(df, df.count()), old_vocabulary(df)))
    assert got == want and len(got) == 65
    few = df.where("id = 3 or id = 4")
    got, want = ({(r.kind, r.term): (r.idx, round(r.idf, 9)) for r in v.collect()} for v in (tm.vocabulary_of(few, few.count()), old_vocabulary(few)))
    assert got == want


def test_matrix(spark, small, tmp_path):
    df = rows(spark, 2)
    v = old_vocabulary(df).persist()
    want = sums(tm.feature_matrix(df, tm.tfidf_rows(tm.term_counts(df), v), ["s"]))
    assert sums(tm.encoded(df, v, ["s"])) == want
    assert sums(tm.encoded(df, v, ["s"], str(tmp_path / "kept"))) == want
    plan = tm.encoded(rows(spark, 2, odd=False).coalesce(1), v, [])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # no term is shuffled; before, all of them were, twice


def joined(model):
    """The same model with one more term that comes twice, so that joins do the work."""
    twice = model.terms.limit(0).sparkSession.createDataFrame([("w", "\x00", 7, 1.0, 0.0)] * 2, tm.MODEL_ROWS)
    return tm.replace(model, terms=model.terms.unionByName(twice))


def test_scores_terms_and_updates(spark, small):
    df = rows(spark, 3)
    v = old_vocabulary(df).withColumn("idx", F.col("idx").cast("int"))
    terms = v.withColumn("weight", F.round(F.sin(F.col("idx") * 3.0), 3)).persist()
    model = tm.TextModel(terms.select("kind", "term", "idx", "idf", "weight"), ("s",), (0.3,), -0.1)
    one, other = ([(r.id, r.text, r.margin and round(r.margin, 9)) for r in tm.margins(m, df).collect()] for m in (model, joined(model)))
    assert sorted(one, key=str) == sorted(other, key=str) and len(one) == 125
    one, other = ([(r.id, r.feature, r.weight, r.contribution, r["rank"]) for r in tm.top_terms(m, df, 3).collect()] for m in (model, joined(model)))
    assert sorted(one, key=str) == sorted(other, key=str)
    one, other = (tm.incremental_update(m, df) for m in (model, joined(model)))
    got, want = ({r.term: round(r.weight, 9) for r in m.terms.collect()} for m in (one, other))
    assert got == {k: x for k, x in want.items() if k != "\x00"}
    assert one.intercept == pytest.approx(other.intercept) and one.structural_weights == pytest.approx(other.structural_weights)
    single = rows(spark, 3, odd=False).coalesce(1)
    assert "hashpartitioning" not in tm.margins(model, single)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in tm.top_terms(model, single, 3)._jdf.queryExecution().executedPlan().toString()
