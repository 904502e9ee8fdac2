"""Term counts made where a row lies, and a vocabulary that leaves rare terms where they are."""
import random
import re
from collections import Counter

from msgsieve.models import text_model as tm


def naive(text, kinds="wc"):
    found = Counter()
    words = re.findall(r"\w{2,}", (text or "").lower())
    if "w" in kinds:
        found.update(("w", " ".join(words[i:i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    if "c" in kinds:
        found.update(("c", p[i:i + n]) for p in (f" {w} " for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w) for n in (3, 4, 5) for i in range(len(p) - n + 1))
    return found


def texts(seed, n):
    rng = random.Random(seed)
    words = ["pay", "now", "a", "über", "日本語", "x\U0001f600y", "no-reply", "ab_c", "0"] + [f"w{k}" for k in range(60)]
    return [rng.choice([" ", "\n", "  "]).join(rng.choice(words[:rng.randint(2, 69)]) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [None, "", " ", "é", "word"]


def test_counts_equal_naive(spark):
    rows = list(enumerate(texts(1, 200))) + [(3, "pay now pay now"), (3, "pay"), (None, "pay now"), (None, "now now"), (900, "long tail " * 90_000), (901, "pay now " * 80_000)]
    want = Counter()
    for k, t in rows:
        for (kind, term), n in naive(t).items():
            want[k, kind, term] += n
    got = tm.term_counts(spark.createDataFrame(rows, "id long, text string").repartition(3)).collect()
    assert len(got) == len(want) and {(r.id, r.kind, r.term): r.tf for r in got} == want


def test_terms_of_single_ids_are_not_shuffled(spark):
    rows = spark.createDataFrame(list(enumerate(texts(2, 20))), "id long, text string")
    assert "Exchange" not in tm.term_counts(rows)._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_keeps_the_first_terms_and_shuffles_few(spark, monkeypatch):
    for name, size in (("WORD_TERMS", 40), ("CHAR_TERMS", 25), ("CELLS", 4096)):
        monkeypatch.setattr(tm, name, size, raising=False)
    data = texts(3, 1500)
    df = spark.createDataFrame(list(enumerate(data)), "id long, text string")
    total, docs = Counter(), Counter()
    for t in data:
        found = naive(t)
        total.update(found)
        docs.update(found.keys())
    want = {}
    for kind, size, offset in (("w", 40, 0), ("c", 25, 40)):
        ranked = sorted((k for k in total if k[0] == kind), key=lambda k: (-total[k], k[1].encode()))[:size]
        want |= {k: (i + offset, docs[k]) for i, k in enumerate(ranked)}
    for part in (None, tm.some_counts(df), tm.term_counts(df.limit(1))):  # the last names too few terms for a bound
        v = tm.fit_vocabulary(tm.term_counts(df), len(data), part)
        got = {(r.kind, r.term): (r.idx, round((1 + len(data)) / 2.718281828459045 ** (r.idf - 1) - 1)) for r in v.collect()}
        assert got == want
