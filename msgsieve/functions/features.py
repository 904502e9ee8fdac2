"""Structural feature columns for the three channels and the weak seed label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve import lexicons as lx
from msgsieve.functions import text as t
from msgsieve.functions import urls as u
from msgsieve.functions.auth import AUTH_FLAGS, with_auth_columns


@dataclass(frozen=True)
class ChannelSpec:
    """Which record keys feed a channel, in priority order."""

    name: str
    text_keys: tuple[str, ...]
    sender_keys: tuple[str, ...]


CHANNELS = {
    "phishing": ChannelSpec("phishing", ("body", "snippet", "message", "text"), ("from", "sender")),
    "smishing": ChannelSpec("smishing", ("body", "message", "text"), ("from", "sender")),
    "vishing": ChannelSpec("vishing", ("transcript", "body", "text"), ("caller_id", "from", "sender")),
}


def normalise_records(df: DataFrame, channel: str) -> DataFrame:
    """First non-empty text and sender per channel, under every name later jobs read."""
    spec = CHANNELS[channel]

    def first(keys: tuple[str, ...]) -> Column:
        present = [F.nullif(F.col(f"`{k}`"), F.lit("")) for k in keys if k in df.columns]
        return F.coalesce(*present, F.lit(""))

    body, sender = first(spec.text_keys), first(spec.sender_keys)
    subject = F.coalesce(F.col("subject"), F.lit("")) if "subject" in df.columns else F.lit("")
    return df.withColumns({"subject": subject, "body": body, "transcript": body, "from": sender, "caller_id": sender})


def flatten_text(channel: str, subject: Column, body: Column, sender: Column) -> Column:
    """The one text a channel's classifier reads."""
    s, b, who = t.text_or_empty(subject), t.text_or_empty(body), t.text_or_empty(sender)
    if channel == "phishing":
        return F.trim(F.concat(s, F.lit(" "), b, F.lit(" "), who, F.lit(" "), F.array_join(u.scheme_urls(b), " ")))
    return F.trim(F.concat(who, F.lit(" "), b))


def bec_score(low: Column) -> Column:
    """0-3: money instrument together with a request counts two, opener and secrecy one each."""
    ask = t.has_any(low, lx.BEC_INSTRUMENT) & t.has_any(low, lx.BEC_REQUEST)
    points = (F.when(ask, 2).otherwise(0) + t.has_any(low, lx.BEC_OPENER).cast("int")
              + t.has_any(low, lx.BEC_SECRECY).cast("int"))
    return F.least(points, F.lit(3))


EMAIL_FEATURES = [
    "url_count", "has_http", "has_ip", "shortener", "punycode", "at_in_url", "suspicious_tld", "max_entropy",
    "max_depth", "max_homoglyph", "max_length", "urgency", "credential", "exclamation", "safe_signal",
    *AUTH_FLAGS, "bec_signal",
]


def _links(text: Column) -> Column:
    """Per link: the tests and measures the e-mail vector needs."""
    def one(link: Column) -> Column:
        low = F.lower(link)
        host = u.loose_host(low)
        parts = F.split(host, r"\.")
        return F.struct(
            low.contains("http://").alias("http"),
            low.rlike(r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}").alias("ip"),
            t.has_any(low, lx.URL_SHORTENERS).alias("short"),
            low.contains("xn--").alias("puny"), link.contains("@").alias("at"),
            F.element_at(parts, -1).isin(lx.SUSPICIOUS_TLDS).alias("tld"),
            t.entropy(host).alias("entropy"), (F.size(parts) - 2).alias("depth"),
            F.when(F.length(host) > 0, F.length(F.regexp_replace(host, "[^01234]", "")) / F.length(host)).otherwise(0.0).alias("glyph"),
            F.length(link).alias("len"))
    return F.transform(u.extract_urls(text), one)


def email_features(df: DataFrame, text: str = "flat_text", **auth: str) -> DataFrame:
    """Add the 27 ordered e-mail features; ``text`` is the flattened message."""
    raw = t.text_or_empty(F.col(text))
    staged = (with_auth_columns(df, **auth).withColumn("_links", _links(raw)).withColumn("_low", F.lower(raw))
              .withColumn("_words", F.array_distinct(F.regexp_extract_all(F.col("_low"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))))
    links = F.col("_links")

    def any_link(field: str) -> Column:
        return F.exists(links, lambda x: x[field]).cast("int")

    def top(field: str) -> Column:
        return F.coalesce(F.array_max(F.transform(links, lambda x: x[field])), F.lit(0)).cast("double")

    risky = F.greatest("suspicious_tld", "shortener", "has_ip", "punycode", "at_in_url") == 1
    out = staged.withColumns({
        "url_count": F.least(F.size(links), F.lit(10)), "has_http": any_link("http"), "has_ip": any_link("ip"),
        "shortener": any_link("short"), "punycode": any_link("puny"), "at_in_url": any_link("at"),
        "suspicious_tld": any_link("tld"),
        "max_entropy": F.least(top("entropy"), F.lit(5.0)),
        "max_depth": F.least(F.greatest(top("depth"), F.lit(0.0)), F.lit(5.0)), "max_homoglyph": top("glyph"),
        "max_length": F.least(top("len") / 100, F.lit(5.0)),
        "urgency": F.least(t.distinct_lexicon_count(F.col("_words"), lx.URGENCY_WORDS), F.lit(10)),
        "credential": F.least(t.distinct_lexicon_count(F.col("_words"), lx.CREDENTIAL_WORDS), F.lit(5)),
        "exclamation": F.least(t.exclamations(raw), F.lit(10)),
        "bec_signal": bec_score(F.col("_low")),
    })
    safe = t.has_any(F.col("_low"), lx.SAFE_PHRASES) & ~risky & (F.col("auth_fail") == 0)
    return out.withColumn("safe_signal", safe.cast("int")).drop("_links", "_low", "_words")


SMS_FEATURES = [
    "url_count", "shortener_count", "tld_count", "urgency", "credential", "money", "authority", "has_phone",
    "segments", "non_ascii", "digits", "upper", "exclamation", "is_shortcode", "is_alpha", "is_long_number",
    "otp_delivery", "otp_theft",
]


def _scheme_host(link: Column) -> Column:
    return F.split_part(F.regexp_replace(F.lower(link), r"^https?://", ""), F.lit("/"), F.lit(1))


def sms_features(df: DataFrame, body: str = "body", sender: str = "sender") -> DataFrame:
    """Add the 18 ordered SMS features."""
    b, who = t.text_or_empty(F.col(body)), F.col(sender)
    staged = df.withColumns({"_links": u.scheme_urls(b), "_tok": t.tokens(b)})
    links, tok = F.col("_links"), F.col("_tok")
    cols = {
        "url_count": F.size(links),
        "shortener_count": F.size(F.filter(links, lambda x: t.has_any(F.lower(x), lx.URL_SHORTENERS))),
        "tld_count": F.size(F.filter(links, lambda x: _scheme_host(x).contains(".")
                                     & F.element_at(F.split(_scheme_host(x), r"\."), -1).isin(lx.SUSPICIOUS_TLDS))),
        "urgency": t.lexicon_count(tok, lx.URGENCY_WORDS), "credential": t.lexicon_count(tok, lx.CREDENTIAL_WORDS),
        "money": t.lexicon_count(tok, lx.MONEY_WORDS), "authority": t.lexicon_count(tok, lx.AUTHORITY_WORDS),
        "has_phone": t.has_phone(b), "segments": F.least(F.length(b) / 160.0, F.lit(4.0)),
        "non_ascii": t.non_ascii_ratio(b), "digits": t.digit_ratio(b), "upper": t.upper_ratio(b),
        "exclamation": t.exclamations(b), "is_shortcode": t.sender_is_shortcode(who),
        "is_alpha": t.sender_is_alpha(who), "is_long_number": t.sender_is_long_number(who),
        "otp_delivery": t.otp_delivery(b), "otp_theft": t.otp_theft(b),
    }
    return staged.withColumns({k: v.cast("double") for k, v in cols.items()}).drop("_links", "_tok")


VOICE_FEATURES = [
    "urgency", "credential", "money", "authority", "press", "automated", "callback", "gift_card", "has_phone",
    "length", "digits", "words", "is_alpha", "is_long_number",
]
PRESS = r"(?i)press\s+([0-9]|one|two|three|four|five|six|seven|eight|nine|zero)"
AUTOMATED = (r"(?i)\b(automated|pre-?recorded|this is a recorded|robot|do not hang up|stay on the line|"
             r"this call may be recorded)\b")
CALLBACK = r"(?i)\b(call (us |this number |back )|press \d to speak|to speak (to|with) (an )?agent)\b"
GIFT_CARD = (r"(?i)\b(gift ?card|google play|app ?store card|itunes|steam card|bitcoin|wire transfer|"
             r"western union|prepaid card)\b")


def voice_features(df: DataFrame, transcript: str = "body", caller: str = "sender") -> DataFrame:
    """Add the 14 ordered call-transcript features."""
    b, who = t.text_or_empty(F.col(transcript)), F.col(caller)
    staged = df.withColumn("_tok", t.tokens(b))
    tok = F.col("_tok")
    cols = {
        "urgency": t.lexicon_count(tok, lx.URGENCY_WORDS), "credential": t.lexicon_count(tok, lx.CREDENTIAL_WORDS),
        "money": t.lexicon_count(tok, lx.MONEY_WORDS), "authority": t.lexicon_count(tok, lx.AUTHORITY_WORDS),
        "press": F.regexp_count(b, F.lit(PRESS)), "automated": b.rlike(AUTOMATED), "callback": b.rlike(CALLBACK),
        "gift_card": b.rlike(GIFT_CARD), "has_phone": t.has_phone(b),
        "length": F.least(F.length(b) / 200.0, F.lit(5.0)), "digits": t.digit_ratio(b),
        "words": F.least(F.size(tok) / 50.0, F.lit(5.0)), "is_alpha": t.sender_is_alpha(who),
        "is_long_number": t.sender_is_long_number(who),
    }
    return staged.withColumns({k: v.cast("double") for k, v in cols.items()}).drop("_tok")


def image_only(blob: Column) -> Column:
    """Message body that is little more than an image."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(blob, r"<[^>]+>", " "), r"\s+", " "))
    low = F.lower(blob)
    refs = low.rlike(r"<img\b|cid:|\[image:")
    return (refs & (F.length(plain) < 48)) | (
        (F.length(plain) < 12) & (F.length(blob) > 80) & (low.contains("<html") | low.contains("multipart")))


def image_only_cap(confidence: Column, blob: Column, cap: float = 0.72) -> Column:
    return F.when(image_only(blob), F.least(confidence, F.lit(cap))).otherwise(confidence)


# --- weak seed labels --------------------------------------------------------
_TLDS = "|".join(lx.SUSPICIOUS_TLDS)
_SHORT = "|".join(s.replace(".", r"\.") for s in lx.URL_SHORTENERS)
SEED_BAD_TLD = rf"(?i)(?:https?://|www\.|\b)[\w\-]*\.(?:{_TLDS})(?:[/\s?#]|$)"
SEED_SHORTENER = rf"(?i)(?:https?://)?(?:{_SHORT})/"
SEED_SAFE = (r"(?i)(?:https?://)?(?:[\w\-]+\.)*(?:google|apple|microsoft|github|okta|slack|amazon|linkedin|dropbox|"
             r"paypal|twitter|instagram|facebook)\.com")


def seed_weak_labels(df: DataFrame, **auth: str) -> DataFrame:
    """Bootstrap label from link structure and auth stamps, with the training text."""
    full = F.concat_ws(" ", *[t.text_or_empty(F.col(c)) for c in ("subject", "body", "sender")])
    staged = with_auth_columns(df, **auth).withColumn("seed_text", full)
    text = F.col("seed_text")
    bad = (text.rlike(SEED_BAD_TLD) | text.rlike(SEED_SHORTENER)) & ~text.rlike(SEED_SAFE)
    label = F.when(F.col("auth_pass") == 1, 0).when(bad | (F.col("auth_fail") == 1), 1).otherwise(0)
    return staged.withColumn("seed_label", label)


# --- injection screen --------------------------------------------------------
# Fixed patterns, joined per family.
SQL_PATTERNS = [
    r"'\s*(or|and)\s*'", r"like\s+['\"]%", r"--\s*$", r"/\*.*\*/", r";\s*drop\s+table", r";\s*delete\s+from",
    r"insert\s+into", r"update\s+.+\s+set", r"union\s+select", r"union\s+all\s+select", r"cast\s*\([^)]+\s+as",
    r"waitfor\s+delay", r"sleep\s*\(", r"benchmark\s*\(", r"pg_sleep\s*\(", r"version\s*\(", r"@@version",
    r"information_schema", r"exec\s*\(", r"xp_cmdshell", r";\s*exec\s+", r"concat\s*\(", r"char\s*\(", r"0x[0-9a-f]+",
]
XSS_PATTERNS = [
    r"<script", r"</script>", r"javascript:", r"onerror\s*=", r"onload\s*=", r"onclick\s*=", r"onmouseover\s*=",
    r"eval\s*\(", r"expression\s*\(", r"vbscript:", r"data:text/html",
]
PIPE_PATTERNS = [r"\|\s*\w+", r"\|\|\s*\w+"]
SEMICOLON_PATTERNS = [r";\s*\w+"]
COMMAND_PATTERNS = [r"\$\(\w+\)", r"`\w+`", r"&&\s*\w+", r">\s*/\w+", r"<\s*/\w+"]
SHELL_WORDS = ["rm ", "sudo", "chmod", "wget", "curl"]
TRAVERSAL_PATTERNS = [r"\.\./", r"\.\.\\", r"%2e%2e/", r"%2e%2e\\", r"\.\.%2f", r"\.\.%5c"]
XXE_PATTERNS = [r"<!ENTITY", r"<!DOCTYPE", r"SYSTEM\s+[\"']", r"\[CDATA\["]
MAX_BODY = 1_000_000


def joined(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def screen_injection(df: DataFrame, body: str = "body", max_body: int = MAX_BODY) -> DataFrame:
    """Add one flag per pattern family, ``quarantined`` and the escaped text.

    XSS and XML-entity hits quarantine a row; the other families are recorded.
    A pipe counts only beside shell names and a semicolon only beside commands.
    """
    b = t.text_or_empty(F.col(body))
    low = F.lower(b)
    looks_xml = b.contains("<") & b.contains(">") & (low.contains("<?xml") | (b.contains("<!ENTITY") & b.contains("SYSTEM")))
    command = (b.rlike(joined(COMMAND_PATTERNS)) | (b.rlike(joined(PIPE_PATTERNS)) & low.contains("sh"))
               | (b.rlike(joined(SEMICOLON_PATTERNS)) & t.has_any(low, SHELL_WORDS)))
    escaped = b
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    flagged = df.withColumns({
        "sql_hit": b.rlike(joined(SQL_PATTERNS)), "xss_hit": b.rlike(joined(XSS_PATTERNS)), "command_hit": command,
        "path_hit": b.rlike(joined(TRAVERSAL_PATTERNS)), "xxe_hit": looks_xml & b.rlike(joined(XXE_PATTERNS)),
        "too_long": F.length(b) > max_body, "escaped": F.trim(escaped),
    })
    return flagged.withColumn("quarantined", F.col("xss_hit") | F.col("xxe_hit"))


# --- header addresses, SMS phrases ------------------------------------------
PRIVATE_HEADER_IP = r"^(127\.|10\.|192\.168\.|172\.16\.|172\.31\.)"


def header_ips(received: Column) -> Column:
    """Distinct public IPv4 addresses of the trace headers, sorted."""
    found = F.regexp_extract_all(t.text_or_empty(received), F.lit(r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"), F.lit(1))
    ok = F.filter(found, lambda ip: F.forall(F.split(ip, r"\."), lambda o: o.cast("int") <= 255) & ~ip.rlike(PRIVATE_HEADER_IP))
    return F.array_sort(F.array_distinct(ok))


SMS_PHRASES = [
    ("verify your account", "Account verification request"), ("click here", "Suspicious link"),
    ("urgent action required", "Urgency in message"),
    ("your account has been suspended", "Account suspension threat"),
    ("unusual activity detected", "Suspicious activity claim"),
    ("confirm your identity", "Identity verification request"),
    ("your payment has failed", "Payment failure claim"), ("you have won", "Prize/winning claim"),
    ("your package is delayed", "Package delivery claim"),
    ("your subscription is expiring", "Subscription expiration claim"),
]


def sms_pattern_reasons(body: Column, sender: Column) -> Column:
    low, who = F.lower(t.text_or_empty(body)), t.text_or_empty(sender)
    return F.array_compact(F.array(
        *[F.when(low.contains(p), F.lit(r)) for p, r in SMS_PHRASES],
        F.when(who.startswith("+") & ~who.startswith("+1"), F.lit("International number"))))
