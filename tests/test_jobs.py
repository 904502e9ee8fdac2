"""Joins, snapshots, order statistics, folds, sources, models on small fixtures against brute force."""
import json
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsieve.models import audio, novelty as nv, text_model as tm
from msgsieve.operators import dedup, evaluation as ev, filters as f, keyed as k, lookups as lk, ordered as od, quantiles as qt, rollups as ro
from msgsieve.plans.training import batch_retrain
from msgsieve.sources import mail, readers as rd, sinks as sk
from msgsieve.streaming import deadletter as dl


def ts(df, col="t"):
    return df.withColumn("ts", F.timestamp_micros(col))


# --- tenants -----------------------------------------------------------------
@pytest.mark.parametrize("bad", ["", None, " ", "Public", "*", "x" * 201, "a\x00b"])
def test_bad_tenants_raise_before_any_scan(spark, bad):
    with pytest.raises(f.TenantError):
        f.tenant_scope(spark.range(1).withColumn("account_sub", F.lit("a")), bad)


def test_scope_never_leaks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "account_sub string, id int")
    assert [r.id for r in f.tenant_scope(df, "a").collect()] == [1]
    assert f.tenant_scope(df, None, bypass=True).count() == 3


# --- order statistics --------------------------------------------------------
def test_exact_quantiles_with_hot_value(spark):
    rng = random.Random(1)
    rows = [("a", 5.0 if rng.random() < 0.4 else rng.gauss(0, 10)) for _ in range(3000)] + [("b", 1.0)] + [("c", None)]
    got = {r.g: r for r in qt.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p1": 0.01, "p50": 0.5, "p90": 0.9}).collect()}
    a = np.array([v for g, v in rows if g == "a"])
    for name, p in (("p1", 1), ("p50", 50), ("p90", 90)):
        assert math.isclose(got["a"][name], np.percentile(a, p), abs_tol=1e-9)
    assert got["b"].p50 == 1.0 and "c" not in got


def test_psi_identity_and_shift(spark):
    a = spark.createDataFrame([("x", float(i % 100)) for i in range(2000)] + [("k", 3.0)] * 50, "feature string, value double")
    b = a.withColumn("value", F.col("value") + F.when(F.col("feature") == "x", 60).otherwise(0))
    same = {r.feature: r.psi for r in ev.psi(a, a).collect()}
    moved = {r.feature: r.psi for r in ev.psi(a, b).collect()}
    assert abs(same["x"]) < 1e-9 and same["k"] == 0 and moved["x"] > 0.25 and moved["k"] == 0


def test_wilson_bounds(one):
    rows = one("k int, n int", [(19, 19), (0, 0), (1, 21)], w=ev.wilson(F.col("k"), F.col("n")))
    assert round(rows[0]["w"]["lo"], 3) == 0.832 and rows[1]["w"] == {"lo": 0.0, "hi": 0.0} and round(rows[2]["w"]["hi"], 3) == 0.227


def test_eval_sums_and_invalid(spark):
    p = spark.createDataFrame([("c", 1, 1), ("c", 1, None), ("c", 0, 0), ("c", 0, 1), ("c", None, 1)], "channel string, label int, pred int")
    r = ev.binary_eval(p, ["channel"]).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.n, r.evaluation_valid) == (1, 1, 1, 1, 4, False)


def test_gate_needs_evidence_and_force_cannot_bypass(spark):
    rows = [("smishing", 1, 1)] * 8 + [("smishing", 0, 0)] * 8
    g = ev.release_gate(ev.binary_eval(spark.createDataFrame(rows, "channel string, label int, pred int"), ["channel"]), ev.gate_table(spark))
    r = g.first()
    assert r.gate_pass and not r.evidence_sufficient and not r.release_ready
    bad = g.withColumn("gate_pass", F.lit(False))
    assert not ev.decide_promotion(bad, g.limit(0), force=True).first().promoted
    assert ev.decide_promotion(g, g).first().promoted


# --- trailing windows and folds ---------------------------------------------
def log(spark, n=400, keys=3, seed=2, span=20_000_000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(range(keys)) if rng.random() > 0.4 else 0, rng.randrange(span) // 1000 * 1000) for i in range(n)]
    return rows, ts(spark.createDataFrame(rows, "id long, key int, t long"))


def test_trailing_count_brute_force(spark):
    rows, df = log(spark)
    got = {r.id: r.n for r in od.trailing_count(df, ["key"], "ts", "id", 1_000_000).collect()}
    for i, key, t in rows:
        want = sum(1 for j, kk, u in rows if kk == key and t - u < 1_000_000 and (u, j) <= (t, i))
        assert got[i] == want


def test_request_rate_refused_do_not_count(spark):
    rows, df = log(spark)
    got = {r.id: r.allowed for r in od.request_rate(df, limit=3, window_us=500_000).collect()}
    taken = {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        recent = [u for u in taken.get(key, []) if t - u < 500_000]
        ok = len(recent) < 3
        taken[key] = recent + [t] if ok else recent
        assert got[i] == ok


def test_token_bucket(spark):
    rows, df = log(spark)
    got = {r.id: r.allowed for r in od.token_bucket_flags(df, 3.0, 5.0).collect()}
    level = {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        have, last = level.get(key, (3.0, t))
        have = min(3.0, have + (t - last) / 1e6 * 5.0)
        ok = have >= 1
        level[key] = (have - 1 if ok else have, t)
        assert got[i] == ok


def test_audit_chain_finds_tampering(spark):
    rows = [(i, f"s{i % 2}", "pay", '{"a":1}', str(i), 86_400_000_000 * (i // 3) + i) for i in range(20)]
    df = ts(spark.createDataFrame(rows, "id long, stream_id string, event_type string, payload string, hashed_at string, t long"))
    chain = od.append_audit_chain(df)
    assert all(r.link_ok and r.hash_ok for r in od.verify_audit_chain(chain).collect())
    cut = od.verify_audit_chain(chain.filter("id <> 6")).filter("not link_ok").collect()
    assert [r.id for r in cut] == [8]


def test_profiles_match_the_fold(spark):
    rows = [(i, "a@x.ru" if i % 3 else "b@y.com", "", "urgent verify" if i % 4 == 0 else "hi", i * 40_000_000_000) for i in range(60)]
    df = ts(spark.createDataFrame(rows, "id long, sender string, subject string, body string, t long"))
    got = {r.email: r for r in ro.sender_profiles(df).collect()}
    for who in ("a@x.ru", "b@y.com"):
        score = None
        for i, s, _, b, _t in rows:
            if s == who:
                x = min(0.3, 0.1 * sum(w in b for w in ro.PROFILE_WORDS)) + (0.2 if s.endswith(".ru") else 0)
                score = x if score is None else score * 0.8 + x * 0.2
        assert math.isclose(got[who].threat_score, score, abs_tol=1e-9)


# --- neighbours --------------------------------------------------------------
def test_exact_neighbours_with_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(lk, "CELL_ROWS", 16)
    rng = np.random.default_rng(0)
    vecs = [(i, [0.5] * 4 if i % 3 == 0 else rng.normal(size=4).round(3).tolist()) for i in range(240)]
    df = spark.createDataFrame(vecs, "vec_id long, vec array<float>")
    got = {}
    for r in lk.similar_messages(df, df, 4, pivots=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.match_id))
    x = np.array([v for _, v in vecs], dtype="float32").astype("float64")
    for q in range(240):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted(range(240), key=lambda j: (d[j], j))[:4]
        assert [m for _, m in sorted(got[q])] == want


def test_ip_ranges_over_block_edges(spark):
    ips = spark.createDataFrame([("1.2.255.255",), ("1.3.0.1",), ("10.0.0.1",), ("9.9.9.9",), (None,)], "ip string")
    lo, hi = 0x0102FFF0, 0x0103000F
    ranges = spark.createDataFrame([(lo, hi, "FR", "Cloud One")], "lo long, hi long, country_code string, isp string")
    got = {r.ip: (r.private, r.risk_level) for r in lk.ip_geo(ips, ranges).collect()}
    assert got == {"1.2.255.255": (False, "MEDIUM"), "1.3.0.1": (False, "MEDIUM"), "10.0.0.1": (True, None), "9.9.9.9": (False, None)}


# --- snapshots ---------------------------------------------------------------
def mailbox(spark):
    rows = [(1, "t", 1, "gmail", "u1", "v", "INBOX", "<a>", "f1"), (2, "t", 1, None, None, None, None, "<b>", "f2"), (3, "t", 2, "gmail", "u1", "v", "INBOX", "<c>", "f3")]
    return spark.createDataFrame(rows, "id long, account_sub string, mailbox_id int, provider string, provider_uid string, uidvalidity string, folder string, rfc_message_id string, ingest_fp string")


def test_ingest_dedup_is_idempotent_and_mailbox_bound(spark):
    old = mailbox(spark)
    batch = old.withColumn("id", F.col("id") + 100).withColumn("mailbox_id", F.lit(1))
    fresh = dedup.new_messages(batch, old)
    assert [r.id for r in fresh.collect()] == []           # 103 has the uid of 1 in mailbox 1
    other = batch.withColumn("account_sub", F.lit("u"))
    assert dedup.new_messages(other, old).count() == 3
    once = k.append_messages(old, other)
    assert k.append_messages(once, other).count() == once.count() == 6


def test_upserts_twice_equal_once(spark):
    old = spark.createDataFrame([("+1", 0.1), ("+2", 0.2)], "e164 string, risk double")
    new = spark.createDataFrame([("+2", 0.9, 1), ("+2", 0.5, 2), ("+3", 0.3, 1)], "e164 string, risk double, seq int")
    once = k.upsert_numbers(old, new).select("e164", "risk")
    twice = k.upsert_numbers(once, new).select("e164", "risk")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("+1", 0.1), ("+2", 0.5), ("+3", 0.3)]


def test_grades_in_time_order(spark):
    m = spark.createDataFrame([(i, "t", "s", None if i != 9 else 1, 1, 0.6) for i in range(1, 10)] + [(20, "u", "s", None, 1, 0.6)],
                              "id long, account_sub string, sender string, label int, is_threat int, confidence double")
    day = 86_400_000_000
    g = ts(spark.createDataFrame([(1, "t", "unsure", 5), (2, "t", "safe", 10), (3, "t", "block", 2 * day), (4, "t", "unsure", day), (5, "t", "unsure", 9 * day)],
                                 "message_id long, account_sub string, verdict string, t long")).withColumnRenamed("ts", "graded_at")
    got = {r.id: (r.label, r.is_threat, r.confidence, r.cascaded) for r in k.apply_grades(m, g).collect()}
    assert got[1] == (0, 0, 0.0, True)        # unsure, then cleared by message 2
    assert got[2] == (0, 0, 0.0, False)
    assert got[3] == (1, 1, 0.0, False)       # cleared by 2 first, then blocked: confidence stays cleared
    assert got[4] == (1, 1, 0.0, True)        # cleared, made unsure, then blocked by 3
    assert got[5] == (None, 0, 0.0, False)    # cleared, then unsure with nothing after
    assert got[6] == (0, 0, 0.0, True) and got[9] == (1, 1, 0.6, False) and got[20] == (None, 1, 0.6, False)


def test_metadata_patch_keeps_types(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":[1,2]},"d":"x"}',), (None,)], "metadata string")
    a, b = [json.loads(r.metadata) for r in k.metadata_patch(df, F.lit('{"d":true,"e":null}')).collect()]
    assert a["a"] == 1 and a["b"] == {"c": [1, 2]} and a["d"] is True and b["d"] is True


def test_encryption_round_trip(spark):
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    df = spark.createDataFrame([("secret",), ("",), (None,)], "body string")
    sealed = k.encrypt_columns(df, ["body"], key)
    again = k.encrypt_columns(sealed, ["body"], key)
    assert [r.body for r in k.decrypt_columns(again, ["body"], key).collect()] == ["secret", "", None]
    assert k.decrypt_columns(sealed, ["body"], other).first().body is None


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (0, "y"), (0, "y")], "label int, text string")
    b = spark.createDataFrame([(0, "y"), (1, "x"), (0, "y")], "label int, text string")
    c = spark.createDataFrame([(0, "y"), (1, "x"), (1, "y")], "label int, text string")
    x, y, z = (ro.dataset_fingerprint(d).first().fingerprint for d in (a, b, c))
    assert x == y != z


# --- sources -----------------------------------------------------------------
def test_ingest_batches_newest_files(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"b{n}.json").write_text(json.dumps([{"id": f"m{n}", "subject": "s"}]))
    got = rd.read_ingest_batches(spark, str(tmp_path), newest=2)
    assert sorted(r.id for r in got.collect()) == ["m2", "m3"]


def test_packs_with_both_label_forms(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"campaign_id": "c1", "block": ["8665550137"], "label": ["8005551001", {"number": "8005551002", "label": "Robo"}]}))
    got = {(r.number, r.action, r.label) for r in rd.read_campaign_packs(spark, str(tmp_path)).collect()}
    assert got == {("8665550137", "block", ""), ("8005551001", "label", "Suspicious caller"), ("8005551002", "label", "Robo")}


def test_challenge_contract(spark, tmp_path):
    row = {"id": "1", "group_id": "g", "taxonomy": "legit", "expected_action": "allow"}
    good = {"purpose": "action_challenge", "training_eligible": False, "release_evidence": False, "rows": [row]}
    ok, bad = tmp_path / "ok.json", tmp_path / "bad.json"
    ok.write_text(json.dumps(good))
    bad.write_text(json.dumps({**good, "rows": [{**row, "label": 1}]}))
    assert rd.read_action_challenge(spark, str(ok)).count() == 1
    with pytest.raises(rd.ChallengeError):
        rd.read_action_challenge(spark, str(bad))


def test_seed_threat_list_and_audit(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"body":"x","label":"1"}\n\n{"body":"y","label":"z"}\nbroken\n{"transcript":"","text":"t","label":0}\n')
    assert sorted((r.body, r.label) for r in rd.read_seed_dropins(spark, str(tmp_path), "vishing").collect()) == [("t", 0), ("x", 1)]
    (tmp_path / "t.json").write_text(json.dumps([{"type": "url", "identifier": "u"}, {"identifier": "n"}]))
    assert [r.body for r in rd.read_threat_list(spark, str(tmp_path / "t.json"), "t1").collect()] == ["u"]
    (tmp_path / "log.txt").write_text('2024 - INFO - {"event_type":"a","user_id":"u"}\n2024 - {bad\n2024 - {"event_type":"b"}\n')
    assert [r.event_type for r in rd.read_audit_log(spark, str(tmp_path / "log.txt"), user="u").collect()] == ["a"]


def test_mail_files(spark, tmp_path):
    (tmp_path / "h.eml").write_bytes(b"From: A <a@x.example>\nSubject: =?utf-8?q?caf=C3=A9?=\nContent-Type: text/html\n\n<style>p{}</style><p>Hi&nbsp;there</p>")
    (tmp_path / "m.eml").write_bytes(b'From: b@x.example\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=z\n\n--z\nContent-Type: text/plain\n\nbody\n--z\nContent-Type: text/plain\nContent-Disposition: attachment; filename=x.txt\n\nATTACHED\n--z--\n')
    got = {r.sender: (r.subject, r.body) for r in mail.ingest_eml_files(spark, str(tmp_path)).collect()}
    assert got == {"A <a@x.example>": ("café", "Hi there"), "b@x.example": ("", "body")}


def test_dead_letters_refuse_tenantless_and_replay_stops(spark, tmp_path):
    rows = spark.createDataFrame([("threat", i, "" if i == 3 else "t", "{}", "x", 0) for i in range(6)], "kind string, id long, account_sub string, payload string, error string, retries int")
    rows = rows.withColumn("failed_at", F.timestamp_seconds("id"))
    assert sk.dead_letter_rows(rows).count() == 5
    done, kept = dl.replay_dead_letters(rows, F.col("id") != 4, "threat")
    assert sorted(r.id for r in done.collect()) == [0, 1, 2] and sorted(r.id for r in kept.collect()) == [3, 4, 5]
    calls = []
    assert not dl.with_retry(lambda: calls.append(1) or 1 / 0, retries=2, backoff=0) and len(calls) == 3


# --- models ------------------------------------------------------------------
def test_text_model_learns_and_updates(spark):
    rows = [(i, f"win a prize now {i % 7}" if i % 2 else f"lunch meeting notes {i % 5}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    golden = spark.createDataFrame([(1, "claim your prize now", 1), (2, "meeting notes attached", 0), (3, "", 0)], "id long, text string, label int")
    model, row = batch_retrain("smishing", df, golden, dry_run=True)
    got = {r.id: (r.pred, r.conf) for r in tm.score_messages(model, golden).collect()}
    assert got[1][0] == 1 and got[2][0] == 0 and got[3] == (0, 0.0)
    assert row.first().version == "(dry-run)" and row.first().n_train == 60
    assert tm.top_terms(model, golden, 3).filter("id = 1").count() == 3
    after = tm.incremental_update(model, golden.filter("id = 1"))
    assert tm.weight_deltas(model.terms.filter("kind='w'"), after.terms.filter("kind='w'"), 3).count() == 3


def test_novelty_ranks_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [("c", i, rng.normal(size=4).tolist()) for i in range(120)] + [("c", 999, [9.0] * 4)]
    df = spark.createDataFrame(rows, "channel string, id long, vec array<double>")
    got = {r.id: r for r in nv.novelty(df, df.filter("id < 999"), trees=30).collect()}
    assert got[999].level == "EXTREME" and got[999].novelty == 1.0


def test_audio_tone_silence_and_garbage(spark, tmp_path):
    for name, rate, fn in (("tone", 8000, lambda n: 12000 * math.sin(n / 4)), ("quiet", 16000, lambda n: 0)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setparams((1, 2, rate, 0, "NONE", ""))
            w.writeframes(b"".join(struct.pack("<h", int(fn(n))) for n in range(rate)))
    (tmp_path / "junk.wav").write_bytes(b"x" * 100)
    got = {r.path.rsplit("/", 1)[-1]: r for r in audio.voice_risk(audio.read_audio(spark, str(tmp_path))).collect()}
    assert got["tone.wav"].ok and abs(got["tone.wav"].seconds - 1) < 0.01 and abs(got["tone.wav"].centroid - 8000 / (8 * math.pi)) < 30
    assert "VOICE_SILENCE_PAD" in got["quiet.wav"].codes and not got["junk.wav"].ok and got["junk.wav"].risk == 0
