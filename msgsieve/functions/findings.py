"""Findings per message: code, label and the evidence found in this message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve import lexicons as lx
from msgsieve.functions import phones
from msgsieve.functions import text as t
from msgsieve.functions import urls as u
from msgsieve.functions.policy import message_tags
from msgsieve.operators import lookups as lk

EVIDENCE = 160
ADDRESS = r"([\w.+-]{1,64}@[\w.-]{1,253}\.[A-Za-z]{2,24})"
DISPLAY = r"^\s*\"?([^\"<>]{0,200})\"?\s*<([^>]{1,320})>"
PHONE_PUSH = r"(\+?\d[\d\-.\s()]{7,}\d)"
IMAGE_REF = r"(?i)<img\b|cid:|\[image:"
ATTACHMENT = rf"(?i)(\.(?:{'|'.join(lx.RISKY_ATTACHMENT_EXT)})\b)"

ORDER = [
    "HOMOGRAPH", "PUNYCODE_IDN", "HTML_OBFUSCATION", "URGENCY_FEAR", "HAPPY_LURE", "CREDIT_LURE", "SENSITIVE_ASK",
    "RELATIONSHIP_LURE", "BLACKMAIL", "BAD_URL", "SHORT_LINK", "DOMAIN_MISMATCH", "SUSPICIOUS_RELAY",
    "DISPLAY_NAME_SPOOF", "CALLBACK_PRESSURE", "TOLL_FREE_CALLBACK", "NEIGHBOR_SPOOF", "ADVANCE_FEE", "IMAGE_ONLY",
    "ATTACHMENT_RISK", "LOOKALIKE_DOMAIN", "SPF_FAIL", "DKIM_FAIL", "DMARC_FAIL", "AUTH_PASS", "REPLY_TO_MISMATCH",
    "CAMPAIGN_MATCH", "IMPERSONATION", "SOCIAL_ENGINEERING",
]
SPOOF_CONTEXT = ["SPF_FAIL", "DKIM_FAIL", "DMARC_FAIL", "BAD_URL", "SHORT_LINK", "DOMAIN_MISMATCH", "DISPLAY_NAME_SPOOF",
                 "HOMOGRAPH", "PUNYCODE_IDN", "SENSITIVE_ASK", "URGENCY_FEAR", "LOOKALIKE_DOMAIN", "REPLY_TO_MISMATCH",
                 "ADVANCE_FEE", "ATTACHMENT_RISK"]
NEWSLETTER_CONTEXT = ["SPF_FAIL", "DKIM_FAIL", "DMARC_FAIL", "BAD_URL", "SHORT_LINK", "HOMOGRAPH", "PUNYCODE_IDN",
                      "SENSITIVE_ASK", "LOOKALIKE_DOMAIN", "REPLY_TO_MISMATCH"]
LURES = ["URGENCY_FEAR", "IMPERSONATION", "SENSITIVE_ASK", "CREDIT_LURE", "HAPPY_LURE", "DISPLAY_NAME_SPOOF", "HOMOGRAPH",
         "PUNYCODE_IDN", "ADVANCE_FEE", "LOOKALIKE_DOMAIN", "REPLY_TO_MISMATCH"]


PAD = 28

KINDS = {"urgent": lx.URGENT + lx.FEAR, "happy": lx.HAPPY, "credit": lx.CREDIT_LURE, "relation": lx.RELATIONSHIP,
         "blackmail": lx.BLACKMAIL, "advance": lx.ADVANCE_FEE}
IMAGE_HINTS = ["<img", "cid:", "[image:", "<html", "multipart"]
LETTER_HINTS = ["unsubscribe", "newsletter", "view in browser", "tldrnewsletter"]
TOLL_FREE_AREAS = ["800", "888", "877", "866", "855", "844", "833"]
RISKY_ENDINGS = [f".{x}" for x in lx.RISKY_ATTACHMENT_EXT]
PHRASES = t.Phrases([*[p for v in KINDS.values() for p in v], *lx.SENSITIVE_WORDS, *lx.RELAY_HINTS, *lx.IMPERSONATE, *IMAGE_HINTS,
                     *LETTER_HINTS, *TOLL_FREE_AREAS, *RISKY_ENDINGS, "http", "xn--"], lx.IMPERSONATE)


def snippet(text: Column, needle: Column, at: Column) -> Column:
    """Up to 120 characters around place ``at`` of ``needle``, with ellipses where cut; null without a needle."""
    start = F.greatest(F.lit(1), at - PAD)
    size = at + F.length(needle) + PAD - start
    part = F.trim(F.replace(F.substring(text, start, size), F.lit("\n"), F.lit(" ")))
    cut = F.concat(F.when(at > PAD + 1, "…").otherwise(""), part, F.when(start + size - 1 < F.length(text), "…").otherwise(""))
    return F.when(needle.isNotNull(), F.substring(F.when(at > 0, cut).otherwise(needle), 1, 120))


def _any_code(codes: list[str]) -> Column:
    out = F.lit(False)
    for c in codes:
        out = out | F.col(f"_e_{c}").isNotNull()
    return out


def analyse_findings(df: DataFrame, subject: str = "subject", body: str = "body", sender: str = "sender",
                     channel: str = "message_type", campaign: str | None = None, user_area: str | None = None) -> DataFrame:
    """Add ``findings``: ordered array of (code, label, evidence).

    Header columns are read when present: auth_results, received_spf,
    reply_to, attachments, headers_present.  ``fleet_hit``/``fleet_confidence``
    and ``campaign`` (campaign id of a matched pack) come from the look-up jobs.
    """
    have = set(df.columns)

    def opt(name: str) -> Column:
        return t.text_or_empty(F.col(name)) if name in have else F.lit("")

    content = F.concat(t.text_or_empty(F.col(subject)), F.lit("\n"), t.text_or_empty(F.col(body)))
    who = t.text_or_empty(F.col(sender))
    out = df.withColumns({"_content": content, "_who": who})
    out = out.withColumn("_blob", F.concat("_who", F.lit("\n"), "_content"))
    out = out.withColumn("_fold", t.folding(F.col("_blob")))
    out = out.withColumn("_folded", F.coalesce("_fold.folded", "_blob"))
    out = out.withColumns({
        "_low": F.lower("_folded"), "_dom": u.sender_domain(F.col("_who")),
        "_name": F.trim(F.regexp_extract("_who", DISPLAY, 1)), "_addr": F.trim(F.regexp_extract("_who", DISPLAY, 2)),
    })
    none = F.array().cast("array<string>")
    # One pass over the text finds all phrases; folding and lower-casing keep ASCII, so it also tells which patterns are worth a try.
    out = out.withColumn("_hits", PHRASES.found(F.col("_low")))
    hits = F.col("_hits")
    out = out.withColumn("_mixed", F.when(F.col("_fold.beyond"), t.mixed_script_tokens(F.col("_blob"))).otherwise(none))
    out = out.withColumn("_puny", F.when(PHRASES.has(hits, "xn--"), t.punycode_labels(F.col("_blob"))).otherwise(none))
    hosts = F.transform(t.link_hosts(F.when(PHRASES.has(hits, "http"), F.col("_content"))), lambda d: F.lower(d))
    out = out.withColumn("_links", F.coalesce(hosts, none))
    c, low, folded, content, who = F.col, F.col("_low"), F.col("_folded"), F.col("_content"), F.col("_who")
    foreign = F.filter("_links", lambda d: ~u.is_esp_host(d) & ~u.aligned_with_sender(d, c("_dom")))
    out = out.withColumn("_foreign", foreign)
    bad = F.get(F.filter("_foreign", lambda d: u.ends_with_any(d, ["." + x for x in lx.SUSPICIOUS_TLDS])), 0)
    short = F.get(F.filter("_links", u.is_shortener_host), 0)
    apart = ~F.exists("_foreign", lambda d: F.contains(d, c("_dom")) | F.contains(c("_dom"), d))
    first_foreign = F.get("_foreign", 0)

    def found(name: str) -> Column:
        return F.concat(F.lit("Found “"), around(name), F.lit("”"))

    def around(name: str) -> Column:
        return snippet(folded, c(f"_w_{name}"), c(f"_p_{name}"))

    def quoted(head: str, value: Column, tail: str = "”") -> Column:
        return F.concat(F.lit(head), value, F.lit(tail))

    sensitive = F.coalesce(*[F.when(PHRASES.has_bounded(hits, low, w) if w in lx.SENSITIVE_BOUNDED else PHRASES.has(hits, w), F.lit(w)) for w in lx.SENSITIVE_WORDS])
    relay = F.coalesce(*[F.when(c("_dom").contains(h) | PHRASES.has(hits, h), F.lit(h)) for h in lx.RELAY_HINTS])
    name_key = F.regexp_replace(F.lower(F.translate("_name", lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO)), "[^a-z0-9]", "")
    addr_low = F.lower(F.translate("_addr", lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO))
    name_words = F.regexp_extract_all(F.lower(F.translate("_name", lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO)), F.lit(r"([a-z]{4,})"), F.lit(1))
    spoofed = ((c("_addr") != "") & lk.known_good_match(c("_addr")).isNull() & (F.length(name_key) >= 4)
               & ~F.exists(name_words, lambda w: F.contains(addr_low, w)) & ~F.contains(addr_low, name_key))
    is_phone_channel = F.col(channel).isin("smishing", "vishing")
    is_call = F.col(channel) == "vishing"
    push = F.when(is_phone_channel, F.regexp_extract("_content", PHONE_PUSH, 1)).otherwise("")
    toll = F.when(is_phone_channel & PHRASES.has_any(hits, TOLL_FREE_AREAS), F.regexp_extract("_content", phones.TOLL_FREE, 1)).otherwise("")
    # Stripping the body is costly and matters only for texts with image or markup traces.
    imageish = PHRASES.has_any(hits, IMAGE_HINTS)
    plain = F.trim(F.regexp_replace(F.regexp_replace("_content", r"<[^>]{0,500}>", " "), r"[ \t\r\n\f]{1,64}", " "))
    refs = F.when(c("_plain").isNotNull(), F.regexp_count("_content", F.lit(IMAGE_REF))).otherwise(0)
    in_text = F.when(PHRASES.has_any(hits, RISKY_ENDINGS), F.nullif(F.regexp_extract("_content", ATTACHMENT, 1), F.lit("")))
    risky = F.coalesce(in_text, F.regexp_extract(opt("attachments"), ATTACHMENT, 1))
    brand_like = lk.lookalike_brand(who)
    stamps = F.lower(F.concat_ws(" ", opt("received_spf"), opt("auth_results")))
    r_addr, s_addr = F.lower(F.regexp_extract(opt("reply_to"), ADDRESS, 1)), F.lower(F.regexp_extract("_who", ADDRESS, 1))
    fleet = F.coalesce(F.col("fleet_hit"), F.lit(False)) if "fleet_hit" in have else F.lit(False)
    fleet_note = (F.format_string("Sender key on fleet threat list (conf≤%.2f)", F.coalesce("fleet_confidence", F.lit(0.75)))
                  if "fleet_hit" in have else F.lit(""))
    pack = F.col(campaign) if campaign else F.lit(None).cast("string")
    area = F.col(user_area) if user_area else F.lit(None).cast("string")
    caller = phones.last_ten(who)

    odd_token = F.get("_mixed", 0)
    odd = F.regexp_extract(odd_token, r"([\p{IsGreek}\p{IsCyrillic}])", 1)

    # The leading phrase of each kind and its place are columns of their own, so each is searched for once.
    words = {k: PHRASES.first(hits, v) for k, v in KINDS.items()} | {"sensitive": sensitive}
    out = out.withColumns({f"_w_{k}": v for k, v in words.items()} | {
        "_relay": relay, "_brand_like": brand_like, "_swap": F.coalesce(*[F.when(PHRASES.only_swapped(hits, b), F.lit(b)) for b in lx.IMPERSONATE]), "_plain": F.when(imageish, plain), "_push": push, "_toll": toll,
        "_bad": bad, "_short": short, "_far": first_foreign, "_risky": risky, "_stamps": stamps, "_ra": r_addr, "_sa": s_addr})
    out = out.withColumns({f"_p_{k}": F.position(c(f"_w_{k}"), low) for k in words})
    relay, brand_like, plain, push, toll, bad, short, first_foreign, risky, stamps, r_addr, s_addr = (
        c(x) for x in ("_relay", "_brand_like", "_plain", "_push", "_toll", "_bad", "_short", "_far", "_risky", "_stamps", "_ra", "_sa"))
    bare = (F.length(plain) < 12) & (F.length("_content") > 80) & PHRASES.has_any(hits, ["<html", "multipart"])
    reply_off = ((r_addr != "") & (s_addr != "") & (r_addr != s_addr)
                 & (F.split_part(r_addr, F.lit("@"), F.lit(-1)) != F.split_part(s_addr, F.lit("@"), F.lit(-1))))

    evidence: dict[str, Column] = {
        "HOMOGRAPH": F.when(F.size("_mixed") > 0, F.concat(
            F.lit("“"), F.substring(odd_token, 1, 40), F.lit("” mixes Latin with "),
            F.when(odd.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("greek"), F.lit(" "), odd,
            F.format_string(" (U+%04X) — looks like “", F.ascii(odd)),
            F.substring(F.translate(odd_token, lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO), 1, 40), F.lit("”"))),
        "PUNYCODE_IDN": F.when(F.size("_puny") > 0, quoted("IDN/punycode host label “", F.get("_puny", 0), "” (often hides non-Latin letters)")),
        "HTML_OBFUSCATION": quoted("Brand “", c("_swap"), "” appears with digit/symbol swaps in the text"),
        "URGENCY_FEAR": found("urgent"), "HAPPY_LURE": found("happy"),
        "CREDIT_LURE": quoted("Credit/score lure: “", around("credit")),
        "SENSITIVE_ASK": quoted("Asks about “", around("sensitive")),
        "RELATIONSHIP_LURE": found("relation"), "BLACKMAIL": found("blackmail"),
        "BAD_URL": quoted("Link host “", bad, "” uses an abused TLD"),
        "SHORT_LINK": quoted("Shortener hides the real site: “", short),
        "DOMAIN_MISMATCH": F.when((c("_dom") != "") & first_foreign.isNotNull() & apart,
                                  F.concat(F.lit("From “"), "_dom", F.lit("” but links go to “"), first_foreign, F.lit("”"))),
        "SUSPICIOUS_RELAY": quoted("Sender/path looks relay-like (“", relay, "”)"),
        "DISPLAY_NAME_SPOOF": F.when(spoofed, F.concat(F.lit("Display name “"), "_name", F.lit("” does not match mailbox “"), "_addr", F.lit("”"))),
        "CALLBACK_PRESSURE": F.when(is_phone_channel & (push != ""), quoted("Message pushes a phone number: “", F.trim(push))),
        "TOLL_FREE_CALLBACK": F.when(is_phone_channel & (toll != ""), quoted("Toll-free callback: “", F.trim(toll))),
        "NEIGHBOR_SPOOF": F.when(is_call & area.rlike(r"^\d{3}$") & (F.length(caller) == 10) & (F.substring(caller, 1, 3) == area),
                                 quoted("Caller ID area ", area, " matches your local prefix")),
        "ADVANCE_FEE": quoted("Advance-fee language: “", around("advance")),
        "IMAGE_ONLY": F.when((refs >= 1) & (F.length(plain) < 48),
                             F.format_string("Body is mostly image (%d img ref, %d text chars)", refs, F.length(plain)))
        .when(bare, "HTML/multipart body with almost no extractable text"),
        "ATTACHMENT_RISK": F.when(risky != "", quoted("Risky attachment pattern: “", risky)),
        "LOOKALIKE_DOMAIN": F.concat(F.lit("From host “"), lk.lookalike_host(who), F.lit("” looks like "), brand_like, F.lit(" (typosquat)")),
        "SPF_FAIL": F.when(stamps.contains("spf=fail") | stamps.contains("spf fail"), "SPF check failed on this message"),
        "DKIM_FAIL": F.when(stamps.contains("dkim=fail"), "DKIM check failed on this message"),
        "DMARC_FAIL": F.when(stamps.contains("dmarc=fail"), "DMARC check failed on this message"),
        "AUTH_PASS": F.when(t.has_any(stamps, ["spf=pass", "dkim=pass", "dmarc=pass"])
                            & ~t.has_any(stamps, ["spf=fail", "spf fail", "dkim=fail", "dmarc=fail"]),
                            "SPF/DKIM/DMARC signals look passing"),
        "REPLY_TO_MISMATCH": F.when(reply_off, F.concat(F.lit("From “"), s_addr, F.lit("” but Reply-To “"), r_addr, F.lit("”"))),
        "CAMPAIGN_MATCH": F.when(fleet, fleet_note).when(
            is_call & pack.isNotNull(), quoted("Matched campaign pack “", pack, "” (directory / TFN seed)")),
    }
    out = out.withColumns({f"_e_{k}": F.substring(v, 1, EVIDENCE) for k, v in evidence.items()})
    brand = F.coalesce(*[F.when(PHRASES.has_bounded(hits, low, b), F.lit(b)) for b in lx.IMPERSONATE])
    letterish = PHRASES.has_any(hits, LETTER_HINTS)
    context = F.when(c("_e_AUTH_PASS").isNotNull() & letterish, _any_code(NEWSLETTER_CONTEXT)).otherwise(_any_code(SPOOF_CONTEXT))
    out = out.withColumn("_e_IMPERSONATION", F.when(
        context & lk.known_good_match(who).isNull(),
        quoted("Brand “", brand, "” plus spoof/pressure signals — verify the real sender")))
    lures = sum((c(f"_e_{k}").isNotNull().cast("int") for k in LURES), F.lit(0))
    out = out.withColumn("_e_SOCIAL_ENGINEERING", F.when(lures >= 2, "Several lure signals stack on this one message"))
    rows = [F.when(c(f"_e_{k}").isNotNull(), F.struct(F.lit(k).alias("code"), F.lit(lx.FINDING_LABELS[k]).alias("label"),
                                                       c(f"_e_{k}").alias("evidence"))) for k in ORDER]
    out = out.withColumn("findings", F.array_compact(F.array(*rows)))
    return out.drop(*[x for x in out.columns if x[:3] in ("_e_", "_w_", "_p_")], "_relay", "_brand_like", "_swap", "_plain", "_push",
                    "_toll", "_bad", "_short", "_far", "_risky", "_stamps", "_ra", "_sa", "_content", "_who", "_blob", "_folded", "_low",
                    "_dom", "_hits", "_fold", "_links", "_name", "_addr", "_mixed", "_puny", "_foreign")


def finding_rows(df: DataFrame) -> DataFrame:
    """Table form: one row per message and code."""
    # The outer form: the inner one would make Spark add a filter that computes the whole array again.
    rows = df.select("id", F.posexplode_outer("findings").alias("pos", "f")).filter(F.col("pos").isNotNull())
    return rows.select("id", "pos", "f.code", "f.label", "f.evidence")


def _reason(code: str, label: Column, evidence: Column) -> Column:
    return F.array(F.struct(F.lit(code).alias("code"), label.alias("label"), evidence.alias("evidence")))


def reason_codes(df: DataFrame, confidence: str = "confidence", known_good: str | None = None) -> DataFrame:
    """Add ``reasons``: known-good alone, else the findings, else one anomaly row from .5 confidence up."""
    conf = F.coalesce(F.col(confidence), F.lit(0.0))
    anomaly = _reason("ANOMALY", F.lit("Model flagged without a clear keyword pattern"), F.concat(
        F.lit("Score "), F.floor(conf * 100).cast("string"),
        F.lit("/100 with no matching keyword/URL rule — likely weight on word/char n-grams. Grade it so we learn.")))
    good = _reason("KNOWN_GOOD", F.lit(lx.FINDING_LABELS["KNOWN_GOOD"]), F.lit("Sender matched known-good allowlist"))
    chosen = F.when((F.size("findings") == 0) & (conf >= 0.5), anomaly).otherwise(F.col("findings"))
    if known_good:
        chosen = F.when(F.col(known_good), good).otherwise(chosen)
    return df.withColumn("reasons", chosen).withColumn(
        "primary_code", F.when(F.size("reasons") > 0, F.get("reasons", 0)["code"]).otherwise("ANOMALY"))


def display_pills(df: DataFrame, max_tags: int = 4, max_reasons: int = 6, body: str = "body") -> DataFrame:
    """Add ``pill_reasons`` (<= 6), ``pill_tags`` (<= 4, not repeating a reason), ``preview`` and ``severities``."""
    out = message_tags(reason_codes(df) if "reasons" not in df.columns else df)
    out = out.withColumn("pill_reasons", F.slice(F.transform("reasons", lambda r: r["code"]), 1, max_reasons))
    rivals = F.create_map(*[x for k, v in lx.PILL_ALIASES.items() for x in (F.lit(k), t.literal_array(v))])
    fresh = F.filter("tags", lambda g: ~F.arrays_overlap(F.coalesce(F.try_element_at(rivals, g), F.array(g)), F.col("pill_reasons"))
                     & ~F.array_contains("pill_reasons", g))
    severity = F.create_map(*[F.lit(x) for kv in lx.FINDING_SEVERITY.items() for x in kv])
    return out.withColumns({
        "pill_tags": F.slice(fresh, 1, max_tags), "preview": t.preview(F.col(body)),
        "severities": F.transform("pill_reasons", lambda r: F.coalesce(F.try_element_at(severity, r), F.lit("warn")))})


# --- explanation -------------------------------------------------------------
# Fixed sentences per leading code; %s is the score of 0-100.
CONNECT = {
    "HOMOGRAPH": "Look-alike letters from another alphabet showed up (e.g. Cyrillic vs Latin). Score %s/100. That is a hold signal — not a final verdict until you grade.",
    "PUNYCODE_IDN": "An xn-- / IDN host can hide non-Latin letters. Score %s/100 → review.",
    "CREDIT_LURE": "Credit/score language is a common lure pattern. Model score %s/100 put this in review; Mark safe if it is a real product you use.",
    "DISPLAY_NAME_SPOOF": "Display name and mailbox do not line up. Score %s/100. Could be marketing or spoof — your grade teaches which.",
    "SUSPICIOUS_RELAY": "From-path looks relay-like or brand-adjacent. Score %s/100 → held for you.",
    "IMPERSONATION": "A brand name appears, which is not proof of the real brand. Score %s/100. Grade Block or Safe so the weights learn.",
    "URGENCY_FEAR": "Pressure language showed up. Together with score %s/100 this stayed in quarantine.",
    "BAD_URL": "A high-risk link ending appeared. Score %s/100.",
    "SHORT_LINK": "A shortener hides the real destination. Score %s/100.",
    "DOMAIN_MISMATCH": "Sender domain and link domain disagree. Score %s/100.",
    "SENSITIVE_ASK": "Asks for secrets or payment-like info. Score %s/100.",
    "ANOMALY": "No loud keyword rule — n-gram weights drove score %s/100. Your grade is the ground truth for the next retrain.",
}


def explain_rows(df: DataFrame, subject: str = "subject", body: str = "body", sender: str = "sender",
                 confidence: str = "confidence", channel: str = "message_type", feature_line: str | None = None) -> DataFrame:
    """Add the explanation columns ``why_text``, ``feature_line`` and ``why_connect``; needs ``reasons``."""
    content = F.concat(t.text_or_empty(F.col(subject)), F.lit("\n"), t.text_or_empty(F.col(body)))
    who = t.text_or_empty(F.col(sender))
    seed = F.concat(who, F.lit("|"), F.substring(content, 1, 80), F.lit("|"), F.col("primary_code"))
    pick = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long") % len(lx.EXPLAIN_OPENERS)
    opener = F.get(t.literal_array(lx.EXPLAIN_OPENERS), pick.cast("int"))
    bullets = F.array_join(F.transform(F.slice("reasons", 1, 4), lambda r: F.concat(
        r["label"], F.when(r["evidence"] != "", F.concat(F.lit(" — "), r["evidence"])).otherwise(""))), "; ")
    lead = F.concat(opener, F.lit(": "), F.when(who != "", who).otherwise("an unknown sender"), F.lit(" ("), F.col(channel), F.lit("). "))
    text = F.when(F.size("reasons") > 0, F.concat(lead, F.lit("Flags: "), bullets, F.lit("."))).otherwise(F.concat(
        lead, F.lit("No strong keyword/URL rule fired; the model score alone placed it in the review queue.")))
    line = F.coalesce(F.nullif(F.col(feature_line), F.lit("")), F.lit(None)) if feature_line else F.lit(None).cast("string")
    pct = F.bround(F.col(confidence) * 100, 0).cast("int").cast("string")
    fixed = F.create_map(*[F.lit(x) for kv in CONNECT.items() for x in kv])
    names = F.array_join(F.transform(F.slice("reasons", 1, 3), lambda r: r["label"]), ", ")
    other = F.concat(F.lit("Signals ("), F.when(names != "", names).otherwise("model n-grams"), F.lit(") plus logistic score ≈ "), pct,
                     F.lit("/100 earned a review hold. That is not a courtroom verdict — Block / Needs review / Mark safe decides."),
                     F.coalesce(F.concat(F.lit(" Top pulls: "), line, F.lit(".")), F.lit("")))
    known = F.concat(F.replace(F.try_element_at(fixed, F.col("primary_code")), F.lit("%s"), pct),
                     F.coalesce(F.concat(F.lit(" Top word pulls: "), line, F.lit(".")), F.lit("")))
    return df.withColumns({
        "why_text": text, "feature_line": F.coalesce(line, F.lit("n-gram weights (no top tokens extracted)")),
        "why_connect": F.coalesce(known, other)})
