"""Policy signals and the ordered verdict override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve import lexicons as lx
from msgsieve.functions import text as t
from msgsieve.functions import urls as u
from msgsieve.functions.auth import with_auth_columns

CALLBACK = r"(please call me at|call me at|reach me at)\s*\+?\d[\d\s\-().]{8,}"
FREE_MAIL = rf"(?i)@({'|'.join(lx.FREE_MAIL)})\.com\b"

SIGNALS = ["hard_malice", "recruit_scam", "domain_mismatch", "callback_pressure", "known_good", "marketing", "auth_financial"]


def _payment_spoof(low: Column, hosts: Column) -> Column:
    """A payment brand is asked for while neither sender nor links belong to it."""
    ask = t.has_any(low, lx.PAYMENT_ASK) | low.contains("locked out")
    spoof = F.lit(False)
    for brand, real in lx.PAYMENT_BRANDS:
        wants = ask | t.has_any(low, [f"pay with {brand}", f"pay via {brand}", f"{brand} payment", f"send {brand}"])
        spoof = spoof | (low.contains(brand) & wants & ~F.exists(hosts, lambda h: u.in_domains(h, real)))
    return spoof


def policy_signals(df: DataFrame, subject: str = "subject", body: str = "body", sender: str = "sender",
                   list_unsubscribe: str = "list_unsubscribe", **auth: str) -> DataFrame:
    """Add the policy flags, the auth flags they rest on and ``sender_domain``."""
    low = F.lower(F.concat_ws(" ", t.text_or_empty(F.col(subject)), t.text_or_empty(F.col(body))))
    links = F.transform(F.regexp_extract_all(F.col("_low"), F.lit(r"https?://([^/\s\"'<>]+)"), F.lit(1)),
                        lambda h: F.regexp_replace(F.split_part(h, F.lit(":"), F.lit(1)), r"^www\.", ""))
    c = F.col
    out = with_auth_columns(df, sender=sender, bare_hosts=False, **auth)
    out = out.withColumns({"_low": low, "sender_domain": u.sender_domain(F.col(sender))})
    out = out.withColumn("_hosts", F.concat(links, F.array("sender_domain")))
    passed, failed, domain, lowc = c("auth_pass") == 1, c("auth_fail") == 1, c("sender_domain"), c("_low")
    hits = t.hit_count(lowc, lx.RECRUIT)
    blast = lowc.contains("hello all") & lowc.contains("applied")
    merge = t.has_any(lowc, lx.MERGE_TAGS)
    out = out.withColumns({
        "hard_malice": t.has_any(lowc, lx.HARD_MALICE) | _payment_spoof(lowc, c("_hosts")),
        "_merge": merge, "_many": (hits >= 2) | blast,
        "_job": (hits >= 2) | blast | (merge & t.has_any(lowc, lx.JOB_CONTEXT)),
        "callback_pressure": lowc.rlike(CALLBACK), "_free": t.text_or_empty(F.col(sender)).rlike(FREE_MAIL),
    })
    sites = F.regexp_extract_all(lowc, F.lit(r"(?:www\.)?([a-z0-9\-]+\.(?:com|net|org))"), F.lit(1))
    off = F.exists(sites, lambda s: ~F.contains(domain, s) & ~F.contains(s, domain) & t.has_any(s, lx.RECRUIT_SITE_HINTS))
    mismatch = c("_job") & c("callback_pressure") & (domain != "") & t.has_any(domain, lx.RECRUIT_SENDER_HINTS) & off
    out = out.withColumn("domain_mismatch", mismatch)
    out = out.withColumn("recruit_scam", (c("_merge") & c("_job")) | (c("_free") & c("_many")) | c("domain_mismatch"))
    clean = ~c("hard_malice") & ~c("recruit_scam")
    listed = F.length(t.text_or_empty(F.col(list_unsubscribe))) > 0
    unsub = t.has_any(lowc, lx.UNSUBSCRIBE)
    letter = lowc.contains("newsletter")
    known_sender = u.in_domains(domain, lx.NEWSLETTER_DOMAINS)
    parents = u.parent_domains(u.mailbox_domain(F.col(sender)))
    allow = F.coalesce(F.exists(parents, lambda p: p.isin(lx.KNOWN_GOOD_DOMAINS)), F.lit(False))
    return out.withColumns({
        "marketing": passed & clean & ((known_sender & (listed | unsub | letter | lowc.contains("tldr")))
                                       | (listed & unsub) | (unsub & letter)),
        "known_good": allow & passed & ~failed & clean,
        "auth_financial": passed & clean & t.has_any(lowc, lx.FINANCIAL_NOTICE),
    }).drop("_low", "_hosts", "_merge", "_many", "_job", "_free")


def policy_verdict(df: DataFrame, fleet_hit: str = "fleet_hit", fleet_confidence: str = "fleet_confidence") -> DataFrame:
    """Add ``policy_pred`` and ``policy_confidence``; null means the classifier decides.

    Needs the policy signals and the shared-list columns.
    """
    c = F.col
    passed = c("auth_pass") == 1
    fleet = F.coalesce(c(fleet_hit), F.lit(False)) & (c("sender_domain") != "") & ~c("known_good")
    confidence = (F.when(c("recruit_scam"), 0.94)
                  .when(c("hard_malice") & ~passed, 0.91)
                  .when(c("hard_malice") & c("callback_pressure"), 0.92)
                  .when(c("hard_malice"), 0.91)
                  .when(fleet, F.least(F.lit(0.75), F.coalesce(c(fleet_confidence), F.lit(0.75))))
                  .when(c("known_good"), 0.02).when(c("auth_financial"), 0.15).when(c("marketing"), 0.12))
    threat = c("recruit_scam") | c("hard_malice") | fleet
    safe = c("known_good") | c("auth_financial") | c("marketing")
    return df.withColumns({"policy_pred": F.when(threat, 1).when(safe, 0), "policy_confidence": confidence})


# --- tags --------------------------------------------------------------------
TAG_FREE_MAIL = r"@(gmail|yahoo|hotmail|outlook|icloud)\.com\b"
MOOD_TAGS = ["HAPPY_LURE", "FEAR_URGENCY", "IMPERSONATION", "RELATIONSHIP_NSFW", "BLACKMAIL"]
NEGATIVE_TAGS = ["FEAR_URGENCY", "BLACKMAIL", "RELATIONSHIP_NSFW", "RECRUIT_GMAIL", "JOB_SCAM", "MALICE_MONEY", "MALICE_PII"]
TAG_ORDER = list(lx.TAG_LABELS)


def message_tags(df: DataFrame, subject: str = "subject", body: str = "body", sender: str = "sender", limit: int = 10) -> DataFrame:
    """Add ``tags``: codes in fixed order, at most ten.

    Later tags depend on earlier ones, so the tests are staged as columns.
    """
    low = F.lower(F.concat(t.text_or_empty(F.col(subject)), F.lit("\n"), t.text_or_empty(F.col(body))))
    out = df.withColumn("_low", low)
    lowc = F.col("_low")
    recruit = t.has_any(lowc, lx.TAG_RECRUIT)
    out = out.withColumns({
        "_t_RECRUIT_GMAIL": F.lower(t.text_or_empty(F.col(sender))).rlike(TAG_FREE_MAIL) & recruit,
        "_t_JOB_SCAM": t.has_any(lowc, lx.TAG_MERGE_FRAUD) & recruit,
        "_t_BLAST": t.has_any(lowc, ["bcc", "hello all"]),
        "_t_HAPPY_LURE": t.has_any(lowc, lx.HAPPY), "_t_FEAR_URGENCY": t.has_any(lowc, lx.URGENT + lx.FEAR),
        "_t_IMPERSONATION": t.has_any(lowc, lx.IMPERSONATE) & t.has_any(lowc, lx.TAG_VERIFY),
        "_t_RELATIONSHIP_NSFW": t.has_any(lowc, lx.RELATIONSHIP), "_t_BLACKMAIL": t.has_any(lowc, lx.BLACKMAIL),
        "_spam": t.has_any(lowc, lx.TAG_SPAM), "_t_MALICE_MONEY": t.has_any(lowc, lx.TAG_MONEY),
        "_t_ADVANCE_FEE": t.has_any(lowc, lx.ADVANCE_FEE), "_t_MALICE_PII": t.has_any(lowc, lx.TAG_PII),
        "_t_SECURITY": t.has_any(lowc, lx.TAG_SECURITY), "_t_TXN": t.has_any(lowc, lx.TAG_TXN),
        "_t_REJECTION": t.has_any(lowc, lx.TAG_REJECTION),
        "_pos": t.hit_count(lowc, lx.TAG_POSITIVE), "_neg": t.hit_count(lowc, lx.TAG_NEGATIVE),
    })

    def tag(code: str) -> Column:
        return F.col(f"_t_{code}")

    moods = sum((tag(m).cast("int") for m in MOOD_TAGS), F.lit(0))
    malice = tag("MALICE_MONEY") | tag("MALICE_PII") | tag("JOB_SCAM") | tag("ADVANCE_FEE")
    spam = F.col("_spam")
    out = out.withColumns({
        "_t_SOCIAL_ENG": t.has_any(lowc, lx.SOCIAL_ENG) | (moods >= 2),
        "_t_SPAM_LIST": spam & ~tag("MALICE_MONEY") & ~tag("MALICE_PII") & ~tag("JOB_SCAM"),
        "_t_THREAT_MALICE": malice, "_t_THREAT_SPAM": spam & ~malice,
        "_t_MARKETING": spam | t.has_any(lowc, lx.TAG_MARKETING),
    })
    plain = [c for c in TAG_ORDER if not c.startswith("SENT_")]
    out = out.withColumn("_found", F.array_compact(F.array(*[F.when(tag(c), F.lit(c)) for c in plain])))
    negative = F.lit(False)
    for c in NEGATIVE_TAGS:
        negative = negative | tag(c)
    mood = (F.when(negative, "SENT_NEG").when((F.col("_pos") > F.col("_neg")) & (F.col("_pos") > 0), "SENT_POS")
            .when(F.size("_found") == 0, "SENT_UNK").otherwise("SENT_NEUT"))
    out = out.withColumn("tags", F.slice(F.concat("_found", F.array(mood)), 1, limit))
    return out.drop("_low", "_spam", "_pos", "_neg", "_found", *[f"_t_{c}" for c in plain])
