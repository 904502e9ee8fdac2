"""Text columns: phrase tests, lexicon counts, character mix, clean-up, keys."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgsieve import lexicons as lx


SWAP_FROM, SWAP_TO = "01345$@", "oleassa"    # digits and symbols that stand for letters


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in cols])


def has_any(low: Column, phrases: list[str]) -> Column:
    """True if the (already lower-cased) text contains any phrase."""
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def first_hit(low: Column, phrases: list[str]) -> Column:
    """First phrase, in list order, that the text contains; null if none."""
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in phrases])


def hit_count(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [low.contains(p).cast("int") for p in phrases])


def bounded(word: str) -> str:
    """Pattern for ``word`` not touching ASCII letters or digits."""
    return rf"(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)"


@lru_cache(maxsize=8)
def _phrase_scan(phrases: tuple[str, ...], swapped: tuple[str, ...]):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def scan(s: pd.Series) -> pd.Series:
        def hits(v: str | None) -> list[int] | None:
            if v is None:
                return None
            found = [k for k, p in enumerate(phrases) if p in v]
            for swap, letter in zip(SWAP_FROM, SWAP_TO):
                v = v.replace(swap, letter)
            return found + [k for k, p in enumerate(swapped, len(phrases)) if p in v]

        return s.map(hits)

    return scan


class Phrases:
    """Which phrases a lower-cased text contains, found in one pass for all of them.

    ``found`` is an array column of their places in the list, which the other
    methods read.  ``swapped`` phrases are looked for after undoing digit and
    symbol swaps.
    """

    def __init__(self, phrases: list[str], swapped: list[str]):
        self.phrases, self.swapped = tuple(dict.fromkeys(phrases)), tuple(dict.fromkeys(swapped))

    def found(self, low: Column) -> Column:
        return _phrase_scan(self.phrases, self.swapped)(low)

    def has(self, hits: Column, phrase: str) -> Column:
        return F.array_contains(hits, F.lit(self.phrases.index(phrase)))

    def has_any(self, hits: Column, phrases: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [self.has(hits, p) for p in phrases])

    def first(self, hits: Column, phrases: list[str]) -> Column:
        """First phrase, in list order, that the text contains; null if none."""
        return F.coalesce(*[F.when(self.has(hits, p), F.lit(p)) for p in phrases])

    def has_bounded(self, hits: Column, low: Column, word: str) -> Column:
        return self.has(hits, word) & low.rlike(bounded(word))

    def only_swapped(self, hits: Column, phrase: str) -> Column:
        """The phrase appears only after undoing swaps."""
        return ~self.has(hits, phrase) & F.array_contains(hits, F.lit(len(self.phrases) + self.swapped.index(phrase)))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_bounded(low: Column, word: str) -> Column:
    """The word stands alone; the plain substring test comes first because it is far cheaper."""
    return low.contains(word) & low.rlike(bounded(word))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z']+)"), F.lit(1))


def lexicon_count(toks: Column, lexicon: list[str]) -> Column:
    words = literal_array(lexicon)
    return F.size(F.filter(toks, lambda t: F.array_contains(words, t)))


def distinct_lexicon_count(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.array_intersect(words, literal_array(lexicon)))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    n = F.length(text)

    def part(ch: Column) -> Column:
        p = (n - F.length(F.replace(text, ch, F.lit("")))) / n
        return p * F.log2(p)

    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    total = F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, b: a + b)
    return F.when(n > 0, -total).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def text_entropy(s: pd.Series) -> pd.Series:
    """``entropy`` of whole texts: one pass over the code points, not one for each distinct character."""
    def bits(v: str | None) -> float:
        if not v:
            return 0.0
        _, n = np.unique(np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        p = n / n.sum()
        return float(-(p * np.log2(p)).sum())

    return s.map(bits)


def share(text: Column, drop_pattern: str) -> Column:
    """Share of characters left after removing ``drop_pattern`` matches."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, drop_pattern, "")) / n).otherwise(0.0)


# The patterns drop whole runs: a match for each character costs many times as much.
def non_ascii_ratio(text: Column) -> Column:
    return share(text, r"[\x00-\x7F]+")


def digit_ratio(text: Column) -> Column:
    return share(text, r"[^\p{Nd}]+")


def upper_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / letters).otherwise(0.0)


def exclamations(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def has_phone(text: Column) -> Column:
    return text.rlike(r"\+?\d[\d\-()\s]{8,}\d").cast("int")


# --- sender shape ------------------------------------------------------------
def sender_digits(sender: Column) -> Column:
    return F.regexp_replace(text_or_empty(sender), r"\D", "")


def sender_is_shortcode(sender: Column) -> Column:
    return F.length(sender_digits(sender)).between(3, 6).cast("int")


def sender_is_alpha(sender: Column) -> Column:
    s = text_or_empty(sender)
    return (s.rlike(r"\p{L}") & (F.length(sender_digits(s)) == 0)).cast("int")


def sender_is_long_number(sender: Column) -> Column:
    return (F.length(sender_digits(sender)) >= 10).cast("int")


# --- one-time codes ----------------------------------------------------------
OTP_DELIVERY = (
    r"(?i)(?:verification|authentication|security|confirm(?:ation)?)\s+code\s+is\s+\d{4,8}"
    r"|\d{4,8}\s+is\s+your\s+(?:verification|authentication|otp|one[- ]time)\s+code"
    r"|(?:code|otp)\s*:\s*\d{4,8}"
    r"|your\s+(?:verification|authentication)\s+code\s*:\s*\d{4,8}"
)
OTP_THEFT = r"(?i)(?:reply|send|text back|provide|read back|tell us|confirm).{0,40}(?:code|otp|pin|digit)"


OTP_NOUNS = ["code", "otp", "pin", "digit"]
OTP_VERBS = ["reply", "send", "text back", "provide", "read back", "tell us", "confirm"]


def otp_delivery(text: Column) -> Column:
    """The words that every form needs come first: they are far cheaper to find."""
    return (has_any(F.lower(text), OTP_NOUNS[:2]) & text.rlike(OTP_DELIVERY)).cast("int")


def otp_theft(text: Column) -> Column:
    low = F.lower(text)
    return (has_any(low, OTP_NOUNS) & has_any(low, OTP_VERBS) & text.rlike(OTP_THEFT)).cast("int")


# --- clean-up ----------------------------------------------------------------
def preview(text: Column, limit: int = 220) -> Column:
    """Plain-text card snippet: tags and entities out, blanks folded, cut with an ellipsis."""
    s = F.regexp_replace(text_or_empty(text), r"<[^>]+>", " ")
    s = F.regexp_replace(s, r"&#?\w+;", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 1), F.lit("…"))).otherwise(s)


def strip_html(html: Column) -> Column:
    """HTML body to text: scripts, styles and tags out, blanks folded."""
    s = F.regexp_replace(text_or_empty(html), r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", " ")
    s = F.regexp_replace(s, r"(?is)<[^>]+>", " ")
    s = F.replace(s, F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# --- look-alike letters ------------------------------------------------------
_MIN_STABLE_RUN = 5       # shorter runs are not worth a range in the pattern
_STABLE_BELOW = 0x2100    # scripts of Latin, Greek, Cyrillic and general punctuation


@lru_cache(maxsize=1)
def nfkc_candidate() -> str:
    """Pattern that finds a character NFKC could change.

    Derived from the Unicode tables: the pattern negates long runs of
    characters that are stable on their own and cannot combine.  It may also
    find stable characters (they are only normalised in vain), never miss one.
    """
    runs: list[list[int]] = []
    for cp in range(_STABLE_BELOW):
        ch = chr(cp)
        if unicodedata.normalize("NFKC", ch) == ch and unicodedata.category(ch)[0] != "M":
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    kept = [(a, b) for a, b in runs if b - a + 1 >= _MIN_STABLE_RUN and (a < 0x500 or a >= 0x2000)]
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in kept) + r"\x{4E00}-\x{9FFF}]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def has_non_ascii(text: Column) -> Column:
    """Cheap byte-count test; most texts stop here."""
    return F.octet_length(text) != F.length(text)


# Beyond Latin letters with stable forms; three ranges only, so it is fast to test first.
BEYOND_LATIN = r"[^\x00-\x{9F}\x{A1}-\x{A7}\x{BF}-\x{131}]"


GREEK = 0x370    # first code unit of the Greek block; Cyrillic and all scripts of look-alikes follow


@F.pandas_udf(T.StructType([T.StructField("folded", T.StringType()), T.StructField("beyond", T.BooleanType())]))
def _folded(s: pd.Series) -> pd.DataFrame:
    def fold(v: str | None) -> tuple[str | None, bool]:
        if v is None:
            return None, False
        mapped = v
        for odd, plain in zip(lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO):
            if odd in mapped:
                mapped = mapped.replace(odd, plain)
        mapped = unicodedata.normalize("NFKC", mapped)
        return None if mapped == v else mapped, bool((np.frombuffer(v.encode("utf-16-le", "surrogatepass"), np.uint16) >= GREEK).any())

    return pd.DataFrame([fold(v) for v in s], columns=["folded", "beyond"])


def folding(text: Column) -> Column:
    """``folded``: the text with look-alike letters mapped to Latin, then NFKC, null if that changes nothing; ``beyond``: it has letters from Greek on.

    Spark has no normaliser, and a character class costs the JVM more a letter than the whole fold costs Python.  ASCII texts pass as null.
    """
    return _folded(F.when(has_non_ascii(text), text))


def fold_confusables(text: Column) -> Column:
    """Map look-alike letters to Latin, then NFKC."""
    return F.coalesce(folding(text)["folded"], text)


_HOST = re.compile(r"(?i)https?://([^/\s:]+)", re.ASCII)


@F.pandas_udf(T.ArrayType(T.StringType()))
def link_hosts(s: pd.Series) -> pd.Series:
    """The hosts of all links of a text, as written."""
    def hosts(v: str | None) -> list[str] | None:
        if v is None:
            return None
        # Every link has this mark; most texts have it a few times at their end.
        at = v.find("://")
        return _HOST.findall(v, max(0, at - 5)) if at >= 0 else []

    return s.map(hosts)


MIXED_TOKEN = r"([A-Za-z\x{370}-\x{3FF}\x{400}-\x{4FF}][A-Za-z0-9\x{370}-\x{3FF}\x{400}-\x{4FF}._\-]{1,})"


def mixed_script_tokens(text: Column) -> Column:
    """Tokens that mix Latin letters with Greek or Cyrillic ones."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(MIXED_TOKEN), F.lit(1))
    mixed = F.filter(found, lambda t: t.rlike(r"\p{IsLatin}") & t.rlike(r"[\p{IsGreek}\p{IsCyrillic}]"))
    # Most texts have no such letter at all; only the others are tokenised.
    return F.when(has_non_ascii(text) & text.rlike(r"[\p{IsGreek}\p{IsCyrillic}]"), mixed).otherwise(F.array().cast("array<string>"))


def punycode_labels(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"\b(xn--[a-z0-9-]+)"), F.lit(1))


def digit_swapped_brand(text: Column) -> Column:
    """First brand that appears only after undoing digit and symbol swaps."""
    low = F.lower(text)
    plain = F.translate(low, SWAP_FROM, SWAP_TO)
    return F.coalesce(*[F.when(~low.contains(b) & plain.contains(b), F.lit(b)) for b in lx.IMPERSONATE])


# --- identity ----------------------------------------------------------------
_DATE_FORMATS = [
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd",
]


def message_time(raw: Column, as_of: Column) -> Column:
    """Date header or ISO text as an instant; ``as_of`` when it cannot be parsed."""
    s = F.trim(F.regexp_replace(raw, r"\s*\([^)]*\)\s*$", ""))
    s = F.regexp_replace(s, r"\s(?:GMT|UTC|UT)$", " +0000")
    s = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")   # the day name is redundant and may be wrong
    s = F.regexp_replace(s, r"Z$", "+00:00")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in _DATE_FORMATS], as_of)


def local_time(ts: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Wall-clock text in the reader's zone; a dash when there is no time."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), pattern), F.lit("—"))


def message_id(raw: Column) -> Column:
    """``<id>`` in lower case; empty when missing."""
    core = F.lower(F.trim(text_or_empty(raw)))
    core = F.regexp_replace(core, r"^<+|>+$", "")
    return F.when(core == "", F.lit("")).otherwise(F.concat(F.lit("<"), core, F.lit(">")))


def fingerprint(mid: Column, sender: Column, subject: Column, body: Column, ts: Column) -> Column:
    """Stable content hash: the Message-ID when present, else the lower-cased parts."""
    parts = F.concat_ws(
        "|",
        *[F.lower(F.trim(text_or_empty(part))) for part in (sender, subject, body)],
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
    )
    return F.sha2(F.when(mid != "", F.concat(F.lit("mid:"), mid)).otherwise(parts), 256)


def campaign_id(sender: Column) -> Column:
    s = F.lower(F.trim(text_or_empty(sender)))
    domain = F.regexp_replace(F.element_at(F.split(s, "@"), -1), r"^>+|>+$", "")
    return F.substring(F.sha2(F.when(s.contains("@"), domain).otherwise(s), 256), 1, 16)


def entity_keys(sender: Column, body: Column) -> Column:
    """All phone, domain and alpha-sender keys of a record, in this order, repeats included."""
    s = text_or_empty(sender)
    blob = F.concat_ws(" ", s, text_or_empty(body))
    phones = F.transform(
        F.filter(
            F.transform(F.regexp_extract_all(blob, F.lit(r"(\+?\d[\d\-.\s()]{7,}\d)"), F.lit(1)),
                        lambda m: F.regexp_replace(m, r"\D", "")),
            lambda d: F.length(d) >= 10),
        lambda d: F.concat(F.lit("phone:"), F.right(d, F.lit(10))))
    domains = F.transform(F.regexp_extract_all(s, F.lit(r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1)),
                          lambda d: F.concat(F.lit("domain:"), F.lower(d)))
    alpha = F.when(F.trim(s).rlike(r"^[A-Za-z]{3,15}$"),
                   F.array(F.concat(F.lit("alpha:"), F.upper(F.trim(s))))).otherwise(F.array().cast("array<string>"))
    return F.concat(phones, domains, alpha)


def redact_sender(sender: Column) -> Column:
    """Hide the mailbox but keep its domain; hide all but the last four digits of a number."""
    s = F.lower(F.trim(text_or_empty(sender)))
    domain = F.regexp_extract(s, r"^[^@\s]+@([^@\s]+)$", 1)
    stars = F.repeat(F.lit("*"), F.greatest(F.length(s) - 5, F.lit(0)).cast("int"))
    return (F.when(domain != "", F.concat(F.lit("redacted@"), domain))
            .when(s.rlike(r"^\+\d+$"), F.concat(F.lit("+"), stars, F.right(s, F.lit(4))))
            .otherwise(F.lit("redacted")))
