"""Literal rows: a hit, a miss and a null for the text, link, number and header columns."""
from pyspark.sql import functions as F

from msgsieve.functions import auth, features as fe, phones, policy as po, text as t, urls as u
from msgsieve.operators import lookups as lk

C = F.col


def test_numbers(one):
    rows = one("s string", [("(408) 555-0112",), ("1 800 555 0112",), ("+447700900103",), ("irs",), ("",), (None,)], n=phones.e164(C("s")))
    assert [r["n"] for r in rows] == ["+14085550112", "+18005550112", "+447700900103", "IRS", "", ""]


def test_phones_in_text(one):
    rows = one("b string, s string", [("call 866-555-0137 or (866) 555-0137 or 1.800.555.1001", "8005551001"), ("no 12345678901234 here", ""), (None, None)],
               p=phones.extract_phones(C("b"), C("s")))
    assert [r["p"] for r in rows] == [["+18665550137"], [], []]


def test_url_risk_points(spark):
    links = ["http://bit.ly/x", "https://paypa1.com/login", "http://1.2.3.4:8081/a?u=a@b", "https://example.com/", "http://a.b.c.evil.ru/verify"]
    df = lk.url_risk(spark.createDataFrame([(x,) for x in links], "url string"))
    got = {r.url: (r.risk_score, r.threat_level) for r in df.collect()}
    assert got[links[0]] == (30, "LOW")
    assert got[links[1]] == (55, "MEDIUM")
    assert got[links[2]] == (90, "HIGH")           # port 20, labels 20, at-sign 50; with a port the address test does not hold
    assert got[links[3]] == (0, "LOW")
    assert got[links[4]] == (50, "MEDIUM")         # ending 25, labels 20, path word 5


def test_redirects_are_optional(spark):
    df = spark.createDataFrame([("https://example.com/", 5), ("https://example.com/", 1)], "url string, hops int")
    assert sorted(r.risk_score for r in lk.url_risk(df, "hops").collect()) == [0, 30]


def test_url_extraction_order_and_lookbehind(one):
    text = "see https://a.example/x www.b.example bit.ly/q and evil.ru/p; xbit.ly/no"
    urls = one("b string", [(text,), ("plain",), (None,)], x=u.extract_urls(C("b")))
    assert urls[0]["x"][:3] == ["https://a.example/x", "www.b.example", "bit.ly/q"] and "evil.ru/p" in urls[0]["x"]
    assert urls[1]["x"] == [] and urls[2]["x"] == []


def test_url_union(one):
    html = '<a href="https://x.example/%41"></a><img src="/rel.png"><a href="www.y.example/p">'
    got = one("t string, h string", [("go http://z.example/q", html)], x=u.url_union(C("t"), C("h")))[0]["x"]
    assert got == ["http://www.y.example/p", "http://z.example/q", "https://x.example/%41", "https://x.example/A"]


def test_lookalikes(one):
    rows = one("s string", [("a@paypa1.com",), ("a@arnazon.com",), ("x@paypal.com",), ("x@irs.co",), ("x@mail.chase.com",), ("x@amaz0n.net",), (None,)], b=lk.lookalike_brand(C("s")))
    assert [r["b"] for r in rows] == ["paypal", None, None, None, None, "amazon", None]


def test_known_good_and_disposable(one):
    rows = one("s string", [("A <x@mail.github.com>",), ("x@notgithub.com",), ("y@sub.mailinator.com",), ("z@privaterelay.appleid.com",), (None,)],
               k=lk.known_good_match(C("s")), d=lk.disposable_sender(C("s")))
    assert [r["k"] for r in rows] == ["github.com", None, None, None, None]
    assert [bool(r["d"]) for r in rows] == [False, False, True, False, False]


def test_auth_last_stamp_wins(spark):
    cols = "sender string, auth_results string, received_spf string, dkim_signature string, return_path string"
    df = spark.createDataFrame([
        ("a@x.com", "spf=fail spf=pass dkim=pass header.d=mail.x.com", None, None, None),
        ("a@x.com", None, "SoftFail", None, "<b@y.com>"), ("a@x.com", None, None, None, None)], cols)
    a, b, c = auth.with_auth_columns(df).collect()
    assert (a.spf_pass, a.dkim_aligned, a.auth_pass, a.auth_fail) == (1, 1, 1, 0)
    assert (b.auth_present, b.rp_mismatch, b.auth_fail) == (1, 1, 1)
    assert sum(c[f] for f in auth.AUTH_FLAGS) == 0


def test_time_and_ids(one):
    as_of = F.lit("2024-01-01").cast("timestamp")
    rows = one("d string, m string", [("Tue, 2 Jan 2024 10:00:00 +0200 (EET)", " <A@B> "), ("2024-01-02T08:00:00Z", "a@b"), ("nonsense", ""), (None, None)],
               t=F.unix_seconds(t.message_time(C("d"), as_of)), i=t.message_id(C("m")))
    assert [r["t"] for r in rows] == [1704182400, 1704182400, 1704067200, 1704067200]
    assert [r["i"] for r in rows] == ["<a@b>", "<a@b>", "", ""]


def test_fold_and_mixed_scripts(one):
    rows = one("s string", [("pаypal ﬁne",), ("plain",), ("пример",), (None,)], f=t.fold_confusables(C("s")), m=t.mixed_script_tokens(C("s")))
    assert rows[0]["f"] == "paypal fine" and rows[0]["m"] == ["pаypal"]
    assert rows[1]["f"] == "plain" and rows[2]["m"] == [] and rows[3]["f"] is None


def test_otp_bec_preview(one):
    rows = one("s string", [("your verification code is 558213",), ("please purchase a gift card, quick favor, keep this confidential",), ("<b>a</b>&nbsp;b",), (None,)],
               d=t.otp_delivery(C("s")), b=fe.bec_score(F.lower("s")), p=t.preview(C("s")))
    assert [r["d"] for r in rows] == [1, 0, 0, None]
    assert rows[1]["b"] == 3 and rows[2]["p"] == "a b" and rows[3]["p"] == ""


def test_message_tags_order_and_cut(spark):
    body = "Congratulations you won a prize, urgent, verify your paypal account locked, honey, blackmail, unsubscribe, wire transfer, ssn, processing fee, invoice"
    df = spark.createDataFrame([("s", body, "x@gmail.com"), ("hi", "see you", "a@b.c"), (None, None, None)], "subject string, body string, sender string")
    a, b, c = [r.tags for r in po.message_tags(df).collect()]
    assert a == ["HAPPY_LURE", "FEAR_URGENCY", "IMPERSONATION", "RELATIONSHIP_NSFW", "BLACKMAIL", "SOCIAL_ENG", "MALICE_MONEY", "ADVANCE_FEE", "MALICE_PII", "THREAT_MALICE"]
    assert b == ["SENT_UNK"] and c == ["SENT_UNK"]


def test_override_order(spark):
    cols = "id int, subject string, body string, sender string, auth_results string, list_unsubscribe string, fleet_hit boolean, fleet_confidence double"
    good = "dmarc=pass"
    rows = [(1, "", "wire transfer now", "a@x.com", None, None, False, None), (2, "", "gift card, call me at 408 555 0112 99", "a@x.com", good, None, False, None),
            (3, "", "hello", "a@x.com", None, None, True, 0.9), (4, "", "hi", "a@github.com", good, None, True, 0.9),
            (5, "", "your credit score", "a@bank.example", good, None, False, None), (6, "", "newsletter unsubscribe", "a@n.example", good, None, False, None),
            (7, "", "hi", "a@x.com", None, None, False, None), (8, None, None, None, None, None, None, None),
            (9, "", "hello all, you applied, send your resume", "x@gmail.com", good, None, False, None)]
    df = spark.createDataFrame(rows, cols).withColumns({c: F.lit(None).cast("string") for c in ("received_spf", "dkim_signature", "return_path")})
    got = {r.id: (r.policy_pred, r.policy_confidence) for r in po.policy_verdict(po.policy_signals(df)).collect()}
    assert got == {1: (1, 0.91), 2: (1, 0.92), 3: (1, 0.75), 4: (0, 0.02), 5: (0, 0.15), 6: (0, 0.12), 7: (None, None), 8: (None, None), 9: (1, 0.94)}


def test_injection_screen(spark):
    df = spark.createDataFrame([("<script>x</script>",), ("a; rm -rf /",), ("1 union select 2",), ("fine text",), (None,)], "body string")
    got = [(r.xss_hit, r.command_hit, r.sql_hit, r.quarantined) for r in fe.screen_injection(df).collect()]
    # A closing tag also fits the redirect pattern of the command family.
    assert got == [(True, True, False, True), (False, True, False, False), (False, False, True, False), (False, False, False, False), (False, False, False, False)]


def test_image_only_cap(one):
    rows = one("s string", [("<img src=x> hi",), ("long text " * 20,)], c=fe.image_only_cap(F.lit(0.99), C("s")))
    assert [r["c"] for r in rows] == [0.72, 0.99]
