"""Pattern index, look-alikes against a table and the versioned classifier, against brute force."""
import random
import re

import pytest
from pyspark.sql import functions as F

from msgsieve.models import text_model as tm
from msgsieve.operators import lookups as lk
from msgsieve.streaming import flow


def like(text, pattern):
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


def brute_safe(messages, rules):
    out = []
    for i, tenant, sender in messages:
        if sender is None or "@" not in sender:
            continue
        s, hits = sender.lower(), []
        for t, kind, p in rules:
            if t == tenant and (s == p if kind == "exact" else like(s, p) if kind == "pattern" else s.split("@")[-1] == p):
                hits.append(({"exact": 1, "pattern": 2, "domain": 3}[kind], p))
        if hits:
            out.append((i, *min(hits)))
    return sorted(out)


def test_safe_senders_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abc", k=r.randint(1, 4)))
    messages = [(i, r.choice(["t1", "t2"]), r.choice([f"{word()}@{word()}.com", f"{word().upper()}.{word()}@{word()}.org", word(), None])) for i in range(300)]
    shapes = [lambda: f"%@{word()}.com", lambda: f"{word()}%", lambda: f"%{word()}%", lambda: f"%{word()}_{word()}%", lambda: "%", lambda: f"_{word()}%", lambda: f"{word()}@{word()}.com", lambda: f"%{word()}%{word()}", lambda: f"%.{word()}@%", lambda: f"%{word()}@{word()}_%", lambda: f"%_{word()}.%", lambda: "_%@%"]
    rules = [(r.choice(["t1", "t2", "t3"]), "pattern", r.choice(shapes)()) for _ in range(60)]
    rules += [("t1", "exact", m[2].lower()) for m in messages[:20] if m[2]] + [("t2", "domain", f"{word()}.com") for _ in range(20)]
    rules += [rules[0], ("t1", "pattern", "a@a.com"), (None, "pattern", "%")]
    got = lk.match_safe_senders(spark.createDataFrame(messages, "id long, account_sub string, sender string"), spark.createDataFrame(rules, "account_sub string, match_type string, pattern string"))
    assert sorted(map(tuple, got.collect())) == brute_safe(messages, rules)


def test_ten_thousand_rules_of_two_tenants_meet_few_senders(spark):
    """The join gives about the matches, not rules times senders."""
    rules = spark.range(10_000).select((F.col("id") % 2).cast("string").alias("account_sub"), F.lit("pattern").alias("match_type"), F.format_string("%%user%05d@%%", "id").alias("pattern"))
    messages = spark.range(2_000).select("id", (F.col("id") % 2).cast("string").alias("account_sub"), F.format_string("Mr.user%05d@mail.example", F.col("id") * 7).alias("sender"))
    filed = rules.select("pattern", lk.pattern_keys(F.col("pattern")).alias("k"))
    asked = messages.select("id", F.explode(lk.text_keys(F.lower("sender"))).alias("k"))
    assert asked.join(filed, "k").count() <= 12 * 2_000
    assert lk.match_safe_senders(messages, rules).count() == 10_000 // 7 + 1
    plan = lk.match_safe_senders(messages, rules)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pattern_keys(one):
    rows = [("%@github.com",), ("alice%",), ("%mid_longpiece%x",), ("%",), ("_%",), ("a\\%b%",), ("plain",), ("%a%",)]
    got = [tuple(x["k"].values()) for x in one("p string", rows, k=lk.pattern_keys(F.col("p")))]
    assert got == [("s", "@github.com"), ("p", "alice"), ("g", "longpiec"), ("a", ""), ("a", ""), ("a", ""), ("p", "plain"), ("g", "a")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_lookalikes_equal_brute_force(spark):
    r = random.Random(6)
    names = sorted({"".join(r.choices("abcd", k=r.randint(4, 7))) for _ in range(120)})
    ranks = {n: r.randint(0, 50) for n in names}
    slugs = {"".join(r.choices("abcd", k=r.randint(3, 10))) for _ in range(400)} | {n + "ab" for n in names[:40]} | {n[1:] for n in names[:40]} | set(names[:10])
    hosts = [f"{s}.{r.choice(['com', 'org'])}" for s in sorted(slugs)]
    real = [f"{n}.com" for n in names[:30]]
    want = []
    for i, host in enumerate(hosts):
        slug = host.split(".")[0]
        if len(slug) < 4 or host in real:
            continue
        near = [(ranks[n], n) for n in names if edits(slug, n) <= 1 or (len(n) >= 5 and n in slug and len(slug) <= len(n) + 3 and edits(slug[:len(n) + 1], n) <= 1)]
        if near:
            want.append((i, host, min(near)[1]))
    senders = spark.createDataFrame([(i, f"Someone <x@{h}>") for i, h in enumerate(hosts)] + [(9000, None), (9001, "no host"), (9002, "x@localhost")], "id long, sender string")
    got = lk.lookalike_names(senders, spark.createDataFrame(list(ranks.items()), "name string, rank int"), spark.createDataFrame([(d,) for d in real], "domain string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# --- versioned classifier ----------------------------------------------------
def model(spark, weight):
    terms = spark.createDataFrame([("w", "prize", 0, 1.5, weight), ("w", "lunch", 1, 1.0, -weight)], tm.MODEL_ROWS)
    return tm.TextModel(terms, ("n",), (0.25,), -0.1, 2.0, 0.3, True)


def test_versions_round_trip(spark, tmp_path):
    path = f"{tmp_path}/models"
    assert tm.load_model(spark, path) is None
    tm.publish_model(model(spark, 1.0), path, 1)
    tm.publish_model(model(spark, 2.0), path, 10)
    (tmp_path / "models" / "version=11").mkdir()          # a writer that never finished
    new, old = tm.load_model(spark, path), tm.load_model(spark, path, 1)
    assert (new.version, old.version, new.kinds) == (10, 1, "w")
    assert (new.structural, new.structural_weights, new.intercept, new.platt_a, new.platt_b, new.calibrated) == (("n",), (0.25,), -0.1, 2.0, 0.3, True)
    df = spark.createDataFrame([(1, "prize prize", 2), (2, "lunch", 0), (3, "", 1), (4, None, 1)], "id long, text string, n int")
    a, b = ({r["id"]: r["margin"] for r in tm.margins(m, df).collect()} for m in (model(spark, 2.0), new))
    assert a == b and a[1] == pytest.approx(2.0 + 0.5 - 0.1)
    assert {r["id"]: r["pred"] for r in tm.score_messages(old, df).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_a_version_published_during_the_run_is_used_from_the_next_batch(spark, tmp_path):
    schema = "id long, body string, sender string"
    for n in (1, 2):
        spark.createDataFrame([(n, "claim the prize", "a@b.example")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    files = [str(f) for n in (1, 2) for f in (tmp_path / "in" / str(n)).glob("part*")]
    (tmp_path / "feed").mkdir()
    models, out, ckpt = (f"{tmp_path}/{x}" for x in ("models", "out", "ckpt"))
    plain = model(spark, 3.0)
    for version, (sign, file) in enumerate(zip((1.0, -1.0), files), 1):
        flipped = tm.TextModel(plain.terms.withColumn("weight", F.col("weight") * sign), (), (), 0.0, 1.0, 0.0, True)
        tm.publish_model(flipped, models, version)
        (tmp_path / "feed" / f"{version}.parquet").write_bytes(open(file, "rb").read())
        stream = flow.file_stream(spark, f"{tmp_path}/feed", schema)
        flow.score_available(stream, "smishing", models, out, ckpt, keep=["id", "pred", "model_version"])
    got = spark.read.schema("id long, pred int, model_version int").parquet(out).select("id", "pred", "model_version").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 0, 2)]
