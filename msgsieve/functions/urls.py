"""URL columns: extraction, host parts, risk points, suspicion, egress rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgsieve import lexicons as lx
from msgsieve.functions.text import has_any, literal_array, text_or_empty


def _alt(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


SCHEME_URL = r"(?iU)(https?://[^\s<>\"']+)"
WWW_URL = r"(?iU)(www\.[^\s<>\"']+)"
BARE_SHORTENER = rf"(?iU)(?<![/\w])((?:{_alt(lx.URL_SHORTENERS)})[/\w\-?=&%+#.]*)"
BARE_BAD_TLD = rf"(?iU)\b([\w\-]+\.(?:{_alt(lx.SUSPICIOUS_TLDS)})(?:[/\w\-?=&%+#.]*)?)\b"
STRICT_URL = r"(?i)((?:(?:https?://)|(?:www\.))(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^\s]*)?)"
CENTRAL_URL = r"(http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(pattern), F.lit(1))


def scheme_urls(text: Column) -> Column:
    return _all(text, SCHEME_URL)


def central_urls(text: Column) -> Column:
    """The narrower ``http(s)`` form used by the link look-ups."""
    # One character class: the alternatives of the pattern only add members.
    return _all(text, r"(https?://(?:[a-zA-Z0-9$-_@.&+!*\\(),]|%[0-9a-fA-F][0-9a-fA-F])+)")


def strict_urls(text: Column) -> Column:
    """``http(s)://`` or ``www.`` followed by a dotted host."""
    return _all(text, STRICT_URL)


def extract_urls(text: Column) -> Column:
    """Scheme, ``www.``, bare-shortener and bare bad-TLD matches, in that order, repeats kept."""
    return F.concat(_all(text, SCHEME_URL), _all(text, WWW_URL), _all(text, BARE_SHORTENER), _all(text, BARE_BAD_TLD))


def url_union(text: Column, html: Column) -> Column:
    """Links of text, ``href`` and ``src`` plus their decoded forms; only absolute ones, distinct and sorted."""
    found = F.array_distinct(F.concat(
        strict_urls(text), _all(html, r"(?i)href=[\"']([^\"']+)[\"']"), _all(html, r"(?i)src=[\"']([^\"']+)[\"']")))
    decoded = F.transform(found, lambda u: F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u))
    both = F.transform(F.array_union(found, decoded), lambda u: F.trim(u))
    full = F.transform(both, lambda u: F.when(u.startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u))
    return F.array_sort(F.array_distinct(F.filter(full, lambda u: u.startswith("http://") | u.startswith("https://"))))


# --- host parts --------------------------------------------------------------
def netloc(url: Column) -> Column:
    """Lower-case authority part, with user info and port."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def hostname(url: Column) -> Column:
    """Authority without user info and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def loose_host(url: Column) -> Column:
    """Host of a link that may lack a scheme; port and user info stay."""
    return F.regexp_extract(F.lower(url), r"(?:https?://)?([^/\s?#]+)", 1)


def last_two_labels(host: Column) -> Column:
    parts = F.filter(F.split(host, r"\."), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(host)


def registrable(host: Column) -> Column:
    """Last two labels of a host, without port or path."""
    h = F.regexp_replace(F.lower(F.trim(text_or_empty(host))), r"^\.+|\.+$", "")
    return last_two_labels(F.split_part(F.split_part(h, F.lit(":"), F.lit(1)), F.lit("/"), F.lit(1)))


def registrable_no_www(host: Column) -> Column:
    h = F.regexp_replace(F.lower(F.trim(text_or_empty(host))), r"^\.+|\.+$", "")
    h = F.split_part(F.split_part(h, F.lit(":"), F.lit(1)), F.lit("/"), F.lit(1))
    return last_two_labels(F.regexp_replace(h, r"^www\.", ""))


def sender_domain(sender: Column) -> Column:
    """Host after the first ``@`` of a From value; empty if none."""
    return F.regexp_replace(F.lower(F.regexp_extract(text_or_empty(sender), r"@([A-Za-z0-9.\-]{1,253})", 1)), r"\.+$", "")


def mailbox_domain(sender: Column) -> Column:
    """Domain of the first well-formed address; null if none."""
    d = F.regexp_extract(F.lower(text_or_empty(sender)), r"[\w.+-]{1,64}@([\w.-]{1,253}\.[a-z]{2,24})", 1)
    return F.when(d != "", F.regexp_replace(d, r"\.+$", ""))


def parent_domains(domain: Column) -> Column:
    """The domain and every parent with at least two labels, longest first."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    return F.when(n >= 2, F.transform(
        F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def ends_with_any(host: Column, suffixes: list[str]) -> Column:
    return F.exists(literal_array(suffixes), lambda s: F.endswith(host, s))


def in_domains(host: Column, domains: list[str]) -> Column:
    """Host equals a listed domain or is below one."""
    return F.exists(literal_array(domains), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def is_esp_host(host: Column) -> Column:
    """Mail-service click wrapper: never judged by its own TLD."""
    h = F.regexp_replace(F.lower(text_or_empty(host)), r"\.+$", "")
    return (h != "") & (
        h.isin(lx.ESP_HOSTS) | ends_with_any(h, lx.ESP_SUFFIXES)
        | h.startswith("click.") | h.startswith("click-") | h.contains(".click-")
        | (h.contains("notification.") & has_any(h, lx.ESP_BANKS)))


def aligned_with_sender(host: Column, domain: Column) -> Column:
    h = F.regexp_replace(F.lower(text_or_empty(host)), r"\.+$", "")
    s = F.regexp_replace(F.lower(text_or_empty(domain)), r"\.+$", "")
    return (h != "") & (s != "") & (
        (last_two_labels(h) == last_two_labels(s))
        | F.endswith(h, F.concat(F.lit("."), s)) | F.endswith(s, F.concat(F.lit("."), h)))


def is_shortener_host(host: Column) -> Column:
    return in_domains(F.regexp_replace(F.lower(text_or_empty(host)), r"\.+$", ""), lx.URL_SHORTENERS)


# --- risk --------------------------------------------------------------------
def typosquat_target(domain: Column) -> Column:
    """First listed domain the host imitates: one edit away, contained, or with a swapped TLD."""
    d = F.replace(domain, F.lit("www."), F.lit(""))
    base = F.regexp_replace(d, r"\.?[^.]*$", "")

    def imitates(t: Column) -> Column:
        return (F.levenshtein(d, t, 1) == 1) | ((d != t) & (
            d.contains(t) | (base == F.regexp_replace(t, r"\.[^.]*$", ""))))

    return F.get(F.filter(literal_array(lx.VERDICT_TARGETS), imitates), 0)


def url_flags(url: Column, redirects: Column | None = None) -> Column:
    """Ordered flag texts, each worth fixed points (see ``flag_points``)."""
    domain, route = netloc(url), F.lower(path(url))
    tld = F.when(domain.contains("."), F.concat(F.lit("."), F.element_at(F.split(domain, r"\."), -1))).otherwise("")
    port = F.get(F.split(domain, ":"), 1)
    labels = F.size(F.split(domain, r"\."))
    target = typosquat_target(domain)
    checks = [
        F.when(has_any(domain, lx.VERDICT_SHORTENERS), F.lit("URL_SHORTENER")),
        F.when(target.isNotNull(), F.concat(F.lit("TYPOSQUATTING:"), target)),
        F.when(tld.isin(lx.VERDICT_TLDS), F.concat(F.lit("SUSPICIOUS_TLD:"), tld)),
        F.when(F.replace(domain, F.lit("www."), F.lit("")).rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.lit("IP_ADDRESS_URL")),
        F.when(domain.contains(":") & ~port.isin("80", "443"), F.concat(F.lit("UNUSUAL_PORT:"), port)),
        F.when(F.length(url) > 150, F.concat(F.lit("LONG_URL:"), F.length(url).cast("string"), F.lit("chars"))),
        *[F.when(route.contains(w), F.lit(f"SUSPICIOUS_PATH:{w}")) for w in lx.VERDICT_PATH_WORDS],
        F.when(labels > 3, F.concat(F.lit("MANY_SUBDOMAINS:"), labels.cast("string"))),
        F.when(url.contains("@"), F.lit("URL_INJECTION:@")),
    ]
    if redirects is not None:
        checks.append(F.when(redirects > 3, F.concat(F.lit("REDIRECT_LOOP:"), redirects.cast("string"))))
    return F.array_compact(F.array(*checks))


# flag kind -> points
FLAG_POINTS = {
    "URL_SHORTENER": 30, "TYPOSQUATTING": 50, "SUSPICIOUS_TLD": 25, "IP_ADDRESS_URL": 40, "UNUSUAL_PORT": 20,
    "LONG_URL": 15, "SUSPICIOUS_PATH": 5, "MANY_SUBDOMAINS": 20, "URL_INJECTION": 50, "REDIRECT_LOOP": 30,
}


def flag_points(flags: Column) -> Column:
    points = F.create_map(*[F.lit(x) for kv in FLAG_POINTS.items() for x in kv])
    total = F.aggregate(flags, F.lit(0), lambda acc, f: acc + F.element_at(points, F.split_part(f, F.lit(":"), F.lit(1))))
    return F.least(total, F.lit(100))


def threat_level(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def suspicion_reason(url: Column) -> Column:
    """First reason a link looks suspicious; null if none."""
    d = netloc(url)
    return (F.when(ends_with_any(d, ["." + t for t in lx.SUSPICIOUS_TLDS]), F.concat(F.lit("Suspicious TLD: "), d))
            .when(d.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), F.concat(F.lit("IP address domain: "), d))
            .when(has_any(d, lx.URL_SHORTENERS), F.concat(F.lit("URL shortener: "), d))
            .when(F.lower(url).startswith("http://"), F.lit("Unencrypted HTTP (not HTTPS)")))


BLOCKED_HOSTS = ["localhost", "0.0.0.0", "metadata.google.internal", "169.254.169.254"]
PRIVATE_PREFIX = r"^(127\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.)"


def egress_allowed(url: Column) -> Column:
    """False for links to nowhere, to metadata hosts or into private networks."""
    h = hostname(url)
    return (h != "") & ~h.isin(BLOCKED_HOSTS) & ~h.rlike(PRIVATE_PREFIX)
