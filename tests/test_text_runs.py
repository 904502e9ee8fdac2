"""Measures of whole texts: one pass over a text, whatever characters it holds."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from msgsieve.functions import text as t

TEXTS = ["", "aaaa", "Ab1!", "Zażółć gęślą JAŹŃ ١٢ ok", "x\U0001F600y\U0001F600", "CODE: 1234", "Reply with the PIN", "a code, no digits", None]


def test_entropy_of_whole_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = df.select("text", t.text_entropy(F.col("text")).alias("one"), t.entropy(F.col("text")).alias("each")).collect()
    for r in rows:
        n = Counter(r.text or "")
        want = -sum(k / n.total() * math.log2(k / n.total()) for k in n.values())
        assert r.one == pytest.approx(want, abs=1e-9) and r.each == pytest.approx(want, abs=1e-9), r.text


def test_ratios_drop_runs(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    c = F.col("text")
    out = df.select("text", t.non_ascii_ratio(c).alias("odd"), t.digit_ratio(c).alias("digits"), t.upper_ratio(c).alias("upper"))
    for r in out.collect():
        s = r.text or ""
        letters = [x for x in s if x.isalpha()]
        assert r.odd == pytest.approx(sum(ord(x) > 127 for x in s) / max(1, len(s)))
        assert r.digits == pytest.approx(sum(x.isdecimal() for x in s) / max(1, len(s)))
        assert r.upper == pytest.approx(sum(x.isupper() for x in letters) / max(1, len(letters)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all(p in plan for p in (r"[\x00-\x7F]+", r"[^\p{Nd}]+", r"[^\p{L}]+", r"[^\p{Lu}]+"))


def test_code_tests_keep_their_answers(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    c = F.col("text")
    for fast, pattern in ((t.otp_delivery, t.OTP_DELIVERY), (t.otp_theft, t.OTP_THEFT)):
        rows = df.select(fast(c).alias("fast"), c.rlike(pattern).cast("int").alias("slow")).collect()
        assert all(r.fast == r.slow for r in rows) and any(r.fast for r in rows)
    assert "Contains" in df.select(t.otp_theft(c))._jdf.queryExecution().optimizedPlan().toString()
