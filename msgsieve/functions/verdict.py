"""Verdict columns: message risk, call screening, directory action, feed payloads, report codes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgsieve import lexicons as lx
from msgsieve.functions.text import literal_array, text_or_empty
from msgsieve.operators.filters import json_field

QUARANTINE_AT, REVIEW_AT, CONFIDENT_SAFE = 0.85, 0.70, 0.92


def _pct(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


def risk_verdict(df: DataFrame, pred: str = "pred", conf: str = "conf", level: str = "anomaly_level", novelty: str = "novelty",
                 sender_risk: str = "sender_risk", link_risk: str = "link_risk") -> DataFrame:
    """Decision matrix: add ``action``, ``verdict_threat``, ``risk_score`` and ``reasons``.

    Novelty counts only between the confident verdicts; it can ask for review
    but never quarantines by itself.
    """
    p, q = F.col(pred), F.col(conf)
    gray = ~(((p == 1) & (q >= QUARANTINE_AT)) | ((p == 0) & (q >= CONFIDENT_SAFE)))
    lvl = F.when(gray, F.coalesce(F.col(level), F.lit("NORMAL"))).otherwise("NORMAL")
    nov = F.when(gray, F.coalesce(F.col(novelty), F.lit(0.0))).otherwise(0.0)
    s, u = F.coalesce(F.col(sender_risk), F.lit(0.0)), F.coalesce(F.col(link_risk), F.lit(0.0))
    bump = F.greatest(F.when(s >= 0.45, s * 0.25).otherwise(0.0), F.when(u >= 0.5, u * 0.3).otherwise(0.0))
    sure = (p == 1) & (q >= QUARANTINE_AT)
    action = (F.when(sure, "quarantine").when(lvl == "EXTREME", "triage_novel").when(p == 1, "review")
              .when(lvl == "CRITICAL", "triage_novel").otherwise("pass"))
    why = (F.when(sure, F.concat(F.lit("classifier PHISH @ "), _pct(q), F.lit(" ≥ 85%")))
           .when(lvl == "EXTREME", "unusual pattern — human review required")
           .when((p == 1) & (q >= REVIEW_AT), F.concat(F.lit("classifier PHISH @ "), _pct(q), F.lit(" (review band)")))
           .when((p == 0) & (lvl == "CRITICAL"), "classifier says SAFE but pattern is novel — human triage")
           .when(p == 1, F.concat(F.lit("classifier PHISH @ "), _pct(q))).otherwise("no threat signal"))
    return df.withColumns({
        "action": action, "verdict_threat": sure | ((p == 1) & (lvl != "EXTREME")), "level_used": lvl,
        "risk_score": F.round(F.greatest(F.when(p == 1, q).otherwise(0.0), nov * 0.6, bump), 4),
        "reasons": F.array_compact(F.array(
            F.when(s >= 0.45, "sender email flagged"), F.when(u >= 0.5, "link flagged"),
            F.when(lvl.isin("CRITICAL", "EXTREME"), F.concat(lvl, F.lit(": pattern is far from known-good traffic"))), why)),
    })


# --- calls -------------------------------------------------------------------
BLOCK_AT, SILENCE_AT, LABEL_AT = 0.85, 0.60, 0.40
VOICE_NOTES = {
    "SYNTHETIC_VOICE_SUSPECTED": "Voicemail audio looks synthetic (cloned / TTS cues).",
    "VOICE_SILENCE_PAD": "Voicemail is mostly silence — possible pad/evasion.",
    "VOICE_FLAT_SPECTRUM": "Voicemail spectrum is unusually flat for a phone recording.",
}


def screen_calls(df: DataFrame) -> DataFrame:
    """Fuse reputation, content and voice into a call action.

    Input columns: rep_risk, rep_verdict, rep_categories, rep_sources,
    rep_reports; has_transcript, content_risk, content_threat,
    content_reasons; voice_ok, voice_risk, voice_codes; carrier_verified
    (three-valued) and contact_known.
    """
    c = F.col
    rep = F.coalesce(c("rep_risk"), F.lit(0.0))
    content = F.when(c("has_transcript"), F.coalesce(c("content_risk"), F.lit(0.0))).otherwise(0.0)
    heard = F.coalesce(c("voice_ok"), F.lit(False))
    voice = F.when(heard, F.least(F.coalesce(c("voice_risk"), F.lit(0.0)), F.lit(SILENCE_AT + 0.05))).otherwise(0.0)
    out = df.withColumns({"_rep": rep, "_content": content, "_voice": voice, "_known": F.coalesce(c("contact_known"), F.lit(False)),
                          "_codes": F.when(heard, F.coalesce(c("voice_codes"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
                          "_cats": F.coalesce(c("rep_categories"), F.array().cast("array<string>")),
                          "_srcs": F.coalesce(c("rep_sources"), F.array().cast("array<string>"))})
    risk = F.greatest("_rep", "_content", "_voice")
    risk = F.when((c("_rep") >= LABEL_AT) & (c("_content") >= LABEL_AT), F.least(F.lit(1.0), risk + 0.08)).otherwise(risk)
    risk = F.when((c("_voice") >= LABEL_AT) & ((c("_rep") >= LABEL_AT) | (c("_content") >= LABEL_AT)), F.least(F.lit(1.0), risk + 0.05)).otherwise(risk)
    risk = (F.when(c("carrier_verified"), F.greatest(F.lit(0.0), risk - 0.05))
            .when(~c("carrier_verified"), F.least(F.lit(1.0), risk + 0.05)).otherwise(risk))
    out = out.withColumn("risk", F.round(risk, 4))
    r = c("risk")
    action = (F.when(c("_known"), F.when(r >= SILENCE_AT, "label").otherwise("allow"))
              .when(r >= BLOCK_AT, "block").when(r >= SILENCE_AT, "silence").when(r >= LABEL_AT, "label").otherwise("allow"))
    verdict = F.when(F.coalesce(c("rep_verdict"), F.lit("unknown")) != "unknown", c("rep_verdict")).otherwise(
        F.when(r >= BLOCK_AT, "fraud").when(r >= LABEL_AT, "spam").otherwise("unknown"))
    out = out.withColumns({"action": action, "verdict": verdict})
    out = out.withColumn("is_threat", c("action").isin("block", "silence"))
    pretty = F.create_map(*[F.lit(x) for kv in lx.CALL_LABELS.items() for x in kv])
    first = F.get(F.filter("_cats", lambda k: k != "prior_offender"), 0)
    label = F.coalesce(F.try_element_at(pretty, first),
                       F.when(c("verdict") == "fraud", "Likely fraud").when(c("verdict") == "spam", "Spam likely").otherwise("Suspicious caller"))
    label = F.when(c("is_threat") | (c("action") == "label"), label).otherwise("")
    cloned = F.array_contains("_codes", "SYNTHETIC_VOICE_SUSPECTED")
    flagged = F.when((F.size("_srcs") > 0) & (c("_rep") >= LABEL_AT), F.concat(
        F.lit("Number flagged as "), F.replace(F.coalesce(F.get("_cats", 0), F.lit("spam")), F.lit("_"), F.lit(" ")),
        F.when(c("rep_reports") > 0, F.concat(F.lit(" by "), c("rep_reports").cast("string"), F.lit(" reports"))).otherwise(""),
        F.lit(" (sources: "), F.array_join("_srcs", ", "), F.lit(").")))
    none = F.array().cast("array<string>")
    spoken = F.when(c("has_transcript") & c("content_threat"), F.slice(F.coalesce(c("content_reasons"), none), 1, 3)).otherwise(none)
    notes = F.create_map(*[F.lit(x) for kv in VOICE_NOTES.items() for x in kv])
    heard_notes = F.array_compact(F.transform("_codes", lambda k: F.try_element_at(notes, k)))
    paths = F.array_compact(F.array(F.when(F.size("_srcs") > 0, "reputation"), F.when(c("has_transcript"), "transcription"), F.when(heard, "voice")))
    found = F.concat(F.array_compact(F.array(flagged)), spoken, heard_notes)
    quiet = F.when(F.size(paths) == 0, "No reputation hits and no transcript to analyze — caller is unknown but not flagged.").otherwise(
        "Caller is known to feeds but below the risk threshold.")
    reasons = F.when(F.size(found) > 0, found).otherwise(F.array(quiet))
    contact = F.when(c("_known") & (c("action") != "block"), F.array(F.lit("Number is in your contacts — not blocked."))).otherwise(none)
    return out.withColumns({
        "label": F.when((label == "") & cloned, "Possible cloned voice").otherwise(label), "paths": paths,
        "reasons": F.slice(F.concat(reasons, contact), 1, 6)}).drop("_rep", "_content", "_voice", "_known", "_codes", "_cats", "_srcs")


def directory_action(metadata: Column, label: Column) -> Column:
    """Directory entry of one observation: struct(action, label).

    A model score may label a number; blocking needs verified provenance.
    """
    source = F.lower(F.trim(text_or_empty(json_field(metadata, "label_source"))))
    requested = F.lower(F.trim(text_or_empty(json_field(metadata, "action"))))
    stated = json_field(metadata, "risk_score").try_cast("double")
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(stated, F.lit(0.0))))
    graded = F.coalesce(label == 1, F.lit(False))
    block = ((graded & source.isin("human_grade", "analyst_verified")) | ((source == "personal_block") & (requested == "block"))
             | (source.isin("analyst_verified", "vendor_verified") & ((requested == "block") | (risk >= 0.85))))
    warn = (requested.isin("block", "label", "silence") | (risk >= 0.4)
            | text_or_empty(json_field(metadata, "is_threat")).isin("true", "1") | graded)
    raw = F.coalesce(F.nullif(json_field(metadata, "display_label"), F.lit("")), F.nullif(json_field(metadata, "verdict"), F.lit("")), F.lit("Suspicious caller"))
    raw = F.when(raw.rlike(r"^-?[0-9.]+$"), "Suspicious caller").otherwise(raw)
    return F.struct(F.when(block, "block").when(warn, "label").otherwise("none").alias("action"),
                    F.when(~block & warn, F.initcap(F.replace(raw, F.lit("_"), F.lit(" ")))).otherwise("").alias("label"))


# --- feeds -------------------------------------------------------------------
PAYLOAD = T.StructType([T.StructField(n, t) for n, t in [
    *[(n, T.DoubleType()) for n in ("complaint_count", "count", "score", "reputationScore", "spamScore", "spam_score", "spamReports",
                                    "reports", "fraud_score", "risk_score")],
    *[(n, T.StringType()) for n in ("topic", "subject", "category", "reputation", "line_type")],
    *[(n, T.BooleanType()) for n in ("blocked", "is_robocall", "is_scam", "is_spam", "spammer", "risky", "VOIP", "prepaid",
                                     "recent_abuse", "disposable", "phishing", "malware")],
    ("tags", T.ArrayType(T.StringType())),
]])


@dataclass(frozen=True)
class FeedSpec:
    """A feed: its name and how a payload becomes (risk, categories, report_count)."""

    name: str
    parse: Callable[[Column], tuple[Column, Column, Column]]


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _compact(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def _complaints(p: Column):
    n = F.coalesce(p["complaint_count"], p["count"], F.lit(0.0))
    topic = F.lower(F.coalesce(F.nullif(p["topic"], F.lit("")), F.nullif(p["subject"], F.lit("")), F.lit("robocall")))
    return F.when(n > 0, F.least(F.lit(0.9), n * 0.05 + 0.3)).otherwise(0.0), F.array(topic, F.lit("ftc_complaint")), n


def _blocklist(p: Column):
    return (F.coalesce(p["score"], F.when(_yes(p["blocked"]) | _yes(p["is_robocall"]), 0.85).otherwise(0.0)),
            F.array(F.lit("robocall")), F.lit(0.0))


def _category(p: Column):
    cat = F.lower(F.coalesce(p["category"], p["reputation"], F.lit("neutral")))
    return (F.coalesce(p["reputationScore"], p["score"], F.when(cat == "fraud", 0.9).when(cat == "spam", 0.6).otherwise(0.0)),
            F.array(cat), F.lit(0.0))


def _hundred(p: Column):
    n = F.coalesce(p["spamReports"], p["reports"], F.lit(0.0))
    tags = F.transform(F.coalesce(p["tags"], F.array().cast("array<string>")), lambda x: F.lower(x))
    return (F.coalesce(F.coalesce(p["spamScore"], p["spam_score"]) / 100, F.least(F.lit(0.9), n * 0.1)),
            F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("spam"))), n)


def _scam(p: Column):
    cat = F.lower(text_or_empty(p["category"]))
    scam = _yes(p["is_scam"]) | cat.isin("scam", "fraud")
    name = F.when(cat != "", cat).when(scam, "scam").otherwise("spam")
    return F.when(scam, 0.92).when(_yes(p["is_spam"]), 0.6).otherwise(0.0), F.array(name), F.lit(0.0)


def _fraud(p: Column):
    r = F.coalesce(p["fraud_score"] / 100, F.lit(0.0))
    r = F.when(_yes(p["spammer"]), F.greatest(r, F.lit(0.75))).otherwise(r)
    r = F.when(_yes(p["risky"]), F.greatest(r, F.lit(0.55))).otherwise(r)
    r = F.when(_yes(p["VOIP"]) & (r < 0.4), F.greatest(r, F.lit(0.35))).otherwise(r)
    cats = _compact(F.when(_yes(p["spammer"]), "spammer"), F.when(_yes(p["VOIP"]), "voip"), F.when(_yes(p["prepaid"]), "prepaid"),
                    F.nullif(F.lower(p["line_type"]), F.lit("")))
    return r, F.when(F.size(cats) > 0, cats).otherwise(F.array(F.lit("phone_intel"))), F.lit(0.0)


def _mail(p: Column):
    r = F.coalesce(p["fraud_score"] / 100, F.lit(0.0))
    r = F.when(_yes(p["recent_abuse"]), F.greatest(r, F.lit(0.7))).otherwise(r)
    return F.when(_yes(p["disposable"]), F.greatest(r, F.lit(0.55))).otherwise(r), F.array().cast("array<string>"), F.lit(0.0)


def _link(p: Column):
    r = F.coalesce(F.coalesce(p["risk_score"], p["fraud_score"]) / 100, F.lit(0.0))
    r = F.when(_yes(p["phishing"]), F.greatest(r, F.lit(0.8))).otherwise(r)
    return F.when(_yes(p["malware"]), F.greatest(r, F.lit(0.85))).otherwise(r), F.array().cast("array<string>"), F.lit(0.0)


FEEDS = [FeedSpec("complaints", _complaints), FeedSpec("blocklist", _blocklist), FeedSpec("category", _category),
         FeedSpec("hundred", _hundred), FeedSpec("scam", _scam), FeedSpec("fraud", _fraud), FeedSpec("mail", _mail),
         FeedSpec("link", _link)]


def feed_score(df: DataFrame, source: str = "source", payload: str = "payload", feeds: list[FeedSpec] = FEEDS) -> DataFrame:
    """Add risk, categories and report_count from a JSON payload; rows without risk are dropped."""
    out = df.withColumn("_p", F.from_json(payload, PAYLOAD))
    risk, cats, n = F.lit(0.0), F.array().cast("array<string>"), F.lit(0.0)
    for spec in feeds:
        r, k, m = spec.parse(F.col("_p"))
        on = F.col(source) == spec.name
        risk, cats, n = F.when(on, r).otherwise(risk), F.when(on, k).otherwise(cats), F.when(on, m).otherwise(n)
    return (out.withColumns({"risk": F.least(risk, F.lit(1.0)), "categories": cats, "report_count": n.cast("bigint")})
            .filter(F.col("risk") > 0).drop("_p"))


def fuse_reputation(feed: DataFrame) -> DataFrame:
    """One row per number from its feed rows (number, source, risk, categories, report_count).

    The greatest risk leads; agreement of several flagging rows adds up to .15.
    """
    flagged = F.count_if(F.col("risk") >= 0.4)
    agg = feed.groupBy("number").agg(
        F.max("risk").alias("_base"), flagged.alias("_flagged"), F.sum("report_count").alias("report_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.array_sort(F.collect_set("source")).alias("sources"))
    boost = F.least(F.lit(0.15), F.greatest(F.lit(0), F.col("_flagged") - 1) * 0.05)
    risk = F.least(F.lit(1.0), F.col("_base") + F.when(F.col("_base") >= 0.4, boost).otherwise(0.0))
    out = agg.withColumn("risk", F.round(risk, 4))
    fraud = F.arrays_overlap(F.transform("categories", lambda c: F.lower(c)), literal_array(lx.FRAUD_CATEGORIES))
    r = F.col("risk")
    return out.withColumns({
        "confidence": F.round(F.least(F.lit(1.0), F.size("sources") * 0.2 + 0.4), 4),
        "verdict": F.when((r >= 0.75) | (fraud & (r >= 0.5)), "fraud").when(r >= 0.4, "spam").when(r > 0, "neutral").otherwise("unknown"),
    }).drop("_base", "_flagged")


# --- reports -----------------------------------------------------------------
REPORT_CODES = {"unsolicited": "UNSOLICITED", "credential": "CREDENTIAL_PHISH", "impersonation": "IMPERSONATION",
                "pressure": "URGENCY_PRESSURE", "seen_before": "SEEN_BEFORE", "other": "OTHER"}
CHANNEL_NAMES = {"email": "email", "sms": "sms", "call": "call", "phishing": "email", "smishing": "sms", "vishing": "call"}


def report_codes(df: DataFrame) -> DataFrame:
    """Add ``codes``, ``channel_name`` and ``error``; ``reasons`` is an array of plain words."""
    words = F.filter(F.transform("reasons", lambda r: F.lower(F.trim(r))), lambda r: r != "")
    known = F.create_map(*[F.lit(x) for kv in REPORT_CODES.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in CHANNEL_NAMES.items() for x in kv])
    out = df.withColumn("codes", F.transform(words, lambda r: F.coalesce(F.try_element_at(known, r), F.upper(r))))
    empty = (F.size("codes") == 0) & F.col("expected").isNull() & (F.trim(text_or_empty(F.col("detail"))) == "")
    return out.withColumns({"channel_name": F.coalesce(F.try_element_at(names, F.lower("channel")), F.lit("email")),
                            "error": F.when(empty, "empty_report")})
