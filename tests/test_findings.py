"""Findings, reasons, calls, fusion, directory."""
import re

from pyspark.sql import functions as F

from msgsieve.functions import findings as fi, verdict as ve
from msgsieve.operators import directory as di

COLS = "id int, message_type string, subject string, body string, sender string, auth_results string, reply_to string, attachments string, confidence double"


def analysed(spark, *rows):
    return fi.analyse_findings(spark.createDataFrame(rows, COLS))


def test_codes_and_evidence(spark):
    df = analysed(spark, (1, "phishing", "Hi", "Your account is suspended, send password http://evil.ru/a", "PayPal Team <x@paypa1.com>", "spf=fail", "y@other.example", "a.docm", 0.9),
                  (2, "phishing", "Lunch", "See you on Friday", "bob@corp.example", "spf=pass", None, None, 0.1), (3, "phishing", None, None, None, None, None, None, 0.9))
    by = {r.id: {f.code: f.evidence for f in r.findings} for r in df.collect()}
    assert list(by[1]) == ["URGENCY_FEAR", "SENSITIVE_ASK", "BAD_URL", "DOMAIN_MISMATCH", "DISPLAY_NAME_SPOOF", "ATTACHMENT_RISK", "LOOKALIKE_DOMAIN", "SPF_FAIL", "REPLY_TO_MISMATCH", "IMPERSONATION", "SOCIAL_ENGINEERING"]
    assert by[1]["URGENCY_FEAR"].startswith("Found “") and "suspended" in by[1]["URGENCY_FEAR"]
    assert by[1]["LOOKALIKE_DOMAIN"] == "From host “paypa1.com” looks like paypal (typosquat)"
    assert by[1]["BAD_URL"] == "Link host “evil.ru” uses an abused TLD"
    assert list(by[2]) == ["AUTH_PASS"] and by[3] == {}
    reasons = {r.id: r.primary_code for r in fi.reason_codes(df).collect()}
    assert reasons == {1: "URGENCY_FEAR", 2: "AUTH_PASS", 3: "ANOMALY"}


def test_homograph_evidence_names_the_letter(spark):
    r = analysed(spark, (1, "smishing", "", "pаypal alert", "x", None, None, None, 0.2)).first()
    assert r.findings[0].code == "HOMOGRAPH" and "U+0430" in r.findings[0].evidence and "paypal" in r.findings[0].evidence


def test_explanation_and_pills(spark):
    df = fi.reason_codes(analysed(spark, (1, "smishing", "", "urgent: verify now bit http://bit.ly/x", "+1", None, None, None, 0.9)))
    r = fi.explain_rows(fi.display_pills(df)).first()
    assert r.why_text.endswith(".") and "Flags: Urgency / fear" in r.why_text and "90/100" not in r.why_text
    assert r.why_connect.startswith("Pressure language") and "90/100" in r.why_connect
    assert "FEAR_URGENCY" not in r.pill_tags and len(r.pill_tags) <= 4


def test_fusion_rules(spark):
    rows = [("+1", "a", 0.5, ["scam"], 2), ("+1", "b", 0.45, [], 1), ("+2", "a", 0.2, [], 0), ("+3", "a", 0.9, [], 0), ("+3", "b", 0.9, [], 0)]
    got = {r.number: r for r in ve.fuse_reputation(spark.createDataFrame(rows, "number string, source string, risk double, categories array<string>, report_count int")).collect()}
    assert (got["+1"].risk, got["+1"].verdict, got["+1"].report_count, got["+1"].confidence) == (0.55, "fraud", 3, 0.8)
    assert got["+2"].verdict == "neutral" and got["+3"].risk == 0.95


def test_call_screen(spark):
    cols = ("id int, rep_risk double, rep_verdict string, rep_categories array<string>, rep_sources array<string>, rep_reports int, has_transcript boolean, content_risk double, "
            "content_threat boolean, content_reasons array<string>, voice_ok boolean, voice_risk double, voice_codes array<string>, carrier_verified boolean, contact_known boolean")
    rows = [(1, 0.8, "fraud", ["irs_scam"], ["f"], 3, True, 0.7, True, ["x"], False, None, None, False, False),
            (2, 0.8, "fraud", ["spam"], ["f"], 0, False, None, None, None, False, None, None, None, True),
            (3, None, None, None, None, None, False, None, None, None, True, 0.9, ["SYNTHETIC_VOICE_SUSPECTED"], None, False),
            (4, None, None, None, None, None, False, None, None, None, False, None, None, True, False)]
    got = {r.id: r for r in ve.screen_calls(spark.createDataFrame(rows, cols)).collect()}
    assert (got[1].action, round(got[1].risk, 2), got[1].label) == ("block", 0.93, "Likely IRS scam")
    assert got[2].action == "label" and got[2].reasons[-1].startswith("Number is in your contacts")
    assert got[3].action == "silence" and got[3].risk == 0.65        # voice alone never blocks
    assert got[4].action == "allow" and got[4].paths == [] and got[4].label == ""


def test_directory_block_beats_label(spark):
    m = spark.createDataFrame([(1, "t1", "vishing", 1, "+15550001111", '{"label_source":"human_grade"}', 1), (2, "t1", "vishing", 1, "5550002222", '{"action":"label","verdict":"spam_likely"}', None),
                               (3, "t2", "vishing", 1, "+15550003333", '{"label_source":"human_grade"}', 1)],
                              "id long, account_sub string, message_type string, is_threat int, sender string, metadata string, label int").withColumn("ts", F.timestamp_seconds("id"))
    numbers = spark.createDataFrame([("+15550002222", 0.9, "x"), ("+15550004444", 0.5, "spam_likely")], "e164 string, risk double, verdict string")
    packs = spark.createDataFrame([("5550004444", "block", "", 1), ("5550005555", "label", "Pack", 1)], "number string, action string, label string, ord int")
    got = {r.number: (r.action, r.label) for r in di.directory(m, numbers, spark.createDataFrame([], "number string"), packs, "t1").collect()}
    assert got == {"+15550001111": ("block", ""), "+15550002222": ("block", ""), "+15550004444": ("block", ""), "+15550005555": ("label", "Pack")}


def test_risk_matrix(spark):
    rows = [(1, 1, 0.9, "EXTREME", 1.0), (2, 1, 0.6, "EXTREME", 0.5), (3, 0, 0.6, "CRITICAL", 0.9), (4, 0, 0.95, "EXTREME", 1.0), (5, 1, 0.72, None, None)]
    df = spark.createDataFrame(rows, "id int, pred int, conf double, anomaly_level string, novelty double").withColumns({"sender_risk": F.lit(0.0), "link_risk": F.lit(0.0)})
    got = {r.id: (r.action, r.risk_score) for r in ve.risk_verdict(df).collect()}
    assert got == {1: ("quarantine", 0.9), 2: ("triage_novel", 0.6), 3: ("triage_novel", 0.54), 4: ("pass", 0.0), 5: ("review", 0.72)}


def test_one_pass_over_the_text(spark, tmp_path):
    """No phrase has a search of its own, and texts are not shuffled to meet events."""
    from msgsieve import catalog
    from msgsieve.catalog.registry import Inputs
    from msgsieve.catalog.verdict_queries import with_findings
    catalog.load()
    docs = [(i, "Verify your account, act now " + "é" * (i % 2), "en", "web", 30) for i in range(26)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i % 20, "2024-01-01 00:00:00", i, "view", 1.0) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double").selectExpr(
        "event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    found = with_findings(Inputs(spark, str(tmp_path)))
    assert found.count() == 26 + 10 and found.where("exists(findings, f -> f.code = 'URGENCY_FEAR')").count() >= 1
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("Contains(") < 100 < len(fi.PHRASES.phrases) and not re.search(r"\bts#", plan)


def test_phrases_as_contains(one):
    """One pass says what a search for each phrase says, folded and swapped letters included."""
    p = fi.t.Phrases(["act now", "paypal", "é ok", ".exe"], ["paypal", "apple"])
    texts = ["act now", "ACT NOW", "p4yp41 payp@1 and @pple", "paypal é ok", "x.exe", "", "ａct now", "раypal"]
    rows = one("s string", [(x,) for x in texts], hits=p.found(F.col("s")), folded=fi.t.fold_confusables(F.col("s")),
               odd=fi.t.folding(F.col("s"))["beyond"], hosts=fi.t.link_hosts(F.col("s")))
    assert [r["hits"] for r in rows] == [[k for k, x in enumerate(p.phrases) if x in v] + [4 + k for k, x in enumerate(p.swapped) if x in v.translate(str.maketrans("01345$@", "oleassa"))] for v in texts]
    assert [r["folded"] for r in rows][-2:] == ["act now", "paypal"] and [r["odd"] for r in rows] == [False] * 6 + [True, True]
    hosts = one("s string", [("HTTPS://A.b/c http://x:1 ahttp://y.z",), ("none",), (None,)], h=fi.t.link_hosts(F.col("s")))
    assert [r["h"] for r in hosts] == [["A.b", "x", "y.z"], [], None]
