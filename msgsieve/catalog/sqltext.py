"""Small builders for the comparison SQL."""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def first_of(col: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {lit(w)}) THEN {lit(w)}" for w in words) + " END"


def arr(words: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def lex_count(toks: str, words: list[str]) -> str:
    return f"len(list_filter({toks}, lambda t: list_contains({arr(words)}, t)))"


def alt(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def rx_all(col: str, pattern: str) -> str:
    return f"regexp_extract_all({col}, {lit(pattern)}, 1)"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(pattern)})"


def entropy(col: str) -> str:
    ch = f"list_filter(list_distinct(string_split({col}, '')), lambda c: c <> '')"
    p = f"((length({col}) - length(replace({col}, c, '')))::DOUBLE / length({col}))"
    return f"CASE WHEN length({col}) > 0 THEN -list_sum(list_transform({ch}, lambda c: {p} * log2({p}))) ELSE 0.0 END"


def share(col: str, drop: str) -> str:
    return f"CASE WHEN length({col}) > 0 THEN length(regexp_replace({col}, {lit(drop)}, '', 'g'))::DOUBLE / length({col}) ELSE 0.0 END"


def last_two(host: str) -> str:
    p = f"list_filter(string_split({host}, '.'), lambda q: q <> '')"
    return f"CASE WHEN len({p}) >= 2 THEN array_to_string(list_slice({p}, -2, -1), '.') ELSE {host} END"


def registrable(host: str) -> str:
    h = f"split_part(split_part(regexp_replace(lower(trim(coalesce({host}, ''))), '^\\.+|\\.+$', '', 'g'), ':', 1), '/', 1)"
    return last_two(h)


WS = r"\s\x0B\x1c-\x1f\x{85}\p{Z}"


def extract_urls(col: str, shorteners: list[str], tlds: list[str]) -> str:
    return ("list_concat(list_concat(list_concat("
            + rx_all(col, rf"(?i)(https?://[^{WS}<>\"']+)") + ", " + rx_all(col, rf"(?i)(www\.[^{WS}<>\"']+)") + "), "
            + rx_all(col, rf"(?i)(?:^|[^/\p{{L}}\p{{N}}_])((?:{alt(shorteners)})[/\p{{L}}\p{{N}}_\-?=&%+#.]*)") + "), "
            + rx_all(col, rf"(?i)\b([\w\-]+\.(?:{alt(tlds)})(?:[/\w\-?=&%+#.]*)?)\b") + ")")


def scheme_urls(col: str) -> str:
    return rx_all(col, rf"(?i)(https?://[^{WS}<>\"']+)")


def sender_domain(col: str) -> str:
    return f"regexp_replace(lower(regexp_extract(coalesce({col}, ''), '@([A-Za-z0-9.\\-]{{1,253}})', 1)), '\\.+$', '')"


def e164(col: str) -> str:
    s = f"trim(coalesce({col}, ''))"
    n = f"regexp_replace({s}, '[^0-9+]', '', 'g')"
    return (f"CASE WHEN regexp_matches({s}, '\\p{{L}}') THEN upper({s}) WHEN {n} = '' THEN '' WHEN starts_with({n}, '+') THEN {n} "
            f"WHEN length({n}) = 10 THEN concat('+1', {n}) ELSE concat('+', {n}) END")


def digits(col: str) -> str:
    return f"regexp_replace(coalesce({col}, ''), '[^0-9]', '', 'g')"


def auth_cte(src: str = "messages", bare: bool = True) -> str:
    """CTE ``auth``: source rows plus the eleven auth flags."""
    def dom(col: str) -> str:
        at = f"regexp_extract(coalesce({col}, ''), '@([A-Za-z0-9.\\-]+)', 1)"
        if not bare:
            return registrable(f"regexp_extract(coalesce({col}, ''), '@([A-Za-z0-9.\\-]{{1,253}})', 1)")
        host = f"regexp_extract(coalesce({col}, ''), '([A-Za-z0-9\\-]+\\.[A-Za-z0-9.\\-]+)', 1)"
        return registrable(f"CASE WHEN {at} <> '' THEN {at} ELSE {host} END")

    def last(m: str) -> str:
        return (f"coalesce(list_extract(regexp_extract_all(lower(coalesce(auth_results, '')), "
                f"'{m}\\s*=\\s*(pass|fail|softfail|neutral|none|temperror|permerror)', 1), -1), '')")
    head = "substr(lower(coalesce(received_spf, '')), 1, 16)"
    hd = "regexp_extract(lower(coalesce(auth_results, '')), 'header\\.d=([A-Za-z0-9.\\-]+)', 1)"
    return f"""a0 AS (SELECT *, {last('spf')} AS s0, {last('dkim')} AS k0, {last('dmarc')} AS m0,
  {registrable(f"CASE WHEN {hd} <> '' THEN {hd} ELSE regexp_extract(coalesce(dkim_signature, ''), 'd=([A-Za-z0-9.\\-]+)', 1) END")} AS sg,
  {dom('sender')} AS fd, {dom('return_path')} AS rd,
  (coalesce(auth_results, '') <> '' OR coalesce(received_spf, '') <> '' OR coalesce(dkim_signature, '') <> '') AS pres FROM {src}),
a1 AS (SELECT *, CASE WHEN s0 <> '' THEN s0 WHEN contains({head}, 'pass') THEN 'pass' WHEN contains({head}, 'fail') THEN 'fail' ELSE '' END AS s1 FROM a0),
auth AS (SELECT *, CAST(pres AS int) AS auth_present, CAST(s1='pass' AS int) AS spf_pass, CAST(k0='pass' AS int) AS dkim_pass,
  CAST(m0='pass' AS int) AS dmarc_pass, CAST(s1 IN ('fail','softfail') AS int) AS spf_fail, CAST(k0='fail' AS int) AS dkim_fail,
  CAST(m0='fail' AS int) AS dmarc_fail, CAST(sg <> '' AND sg = fd AS int) AS dkim_aligned,
  CAST(rd <> '' AND fd <> '' AND rd <> fd AS int) AS rp_mismatch,
  CAST(m0='pass' OR (s1='pass' AND sg <> '' AND sg = fd) AS int) AS auth_pass,
  CAST(m0='fail' OR s1 IN ('fail','softfail') OR k0='fail' OR (pres AND rd <> '' AND fd <> '' AND rd <> fd AND m0 <> 'pass') AS int) AS auth_fail FROM a1)"""


# --- URL risk ---------------------------------------------------------------
def netloc(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1))"


def hostname(url: str) -> str:
    return f"regexp_replace(regexp_replace({netloc(url)}, '^.*@', ''), ':[0-9]*$', '')"


def url_risk_cte(src: str, lx) -> str:
    """CTE ``url_risk`` over ``src(url, ...)``: score, level, flags text."""
    targets = arr(lx.VERDICT_TARGETS)
    parts = [
        f"CASE WHEN {any_of('domain', lx.VERDICT_SHORTENERS)} THEN 'URL_SHORTENER' END",
        "CASE WHEN target IS NOT NULL THEN concat('TYPOSQUATTING:', target) END",
        f"CASE WHEN list_contains({arr(lx.VERDICT_TLDS)}, tld) THEN concat('SUSPICIOUS_TLD:', tld) END",
        "CASE WHEN regexp_matches(replace(domain, 'www.', ''), '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 'IP_ADDRESS_URL' END",
        "CASE WHEN contains(domain, ':') AND port NOT IN ('80', '443') THEN concat('UNUSUAL_PORT:', port) END",
        "CASE WHEN length(url) > 150 THEN concat('LONG_URL:', length(url), 'chars') END",
        *[f"CASE WHEN contains(route, '{w}') THEN 'SUSPICIOUS_PATH:{w}' END" for w in lx.VERDICT_PATH_WORDS],
        "CASE WHEN labels > 3 THEN concat('MANY_SUBDOMAINS:', labels) END",
        "CASE WHEN contains(url, '@') THEN 'URL_INJECTION:@' END",
    ]
    pts = "CASE split_part(f, ':', 1) WHEN 'URL_SHORTENER' THEN 30 WHEN 'TYPOSQUATTING' THEN 50 WHEN 'SUSPICIOUS_TLD' THEN 25 WHEN 'IP_ADDRESS_URL' THEN 40 WHEN 'UNUSUAL_PORT' THEN 20 WHEN 'LONG_URL' THEN 15 WHEN 'SUSPICIOUS_PATH' THEN 5 WHEN 'MANY_SUBDOMAINS' THEN 20 WHEN 'URL_INJECTION' THEN 50 END"
    return f"""u0 AS (SELECT *, {netloc('url')} AS domain, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)) AS route FROM {src}),
u1 AS (SELECT *, CASE WHEN contains(domain, '.') THEN concat('.', list_extract(string_split(domain, '.'), -1)) ELSE '' END AS tld,
  list_extract(string_split(domain, ':'), 2) AS port, len(string_split(domain, '.')) AS labels, replace(domain, 'www.', '') AS dd FROM u0),
u2 AS (SELECT *, list_extract(list_filter({targets}, lambda t: levenshtein(dd, t) = 1 OR (dd <> t AND (contains(dd, t)
  OR regexp_replace(dd, '\\.?[^.]*$', '') = regexp_replace(t, '\\.[^.]*$', '')))), 1) AS target FROM u1),
u3 AS (SELECT *, list_filter([{', '.join(parts)}], lambda f: f IS NOT NULL) AS flags FROM u2),
u4 AS (SELECT *, CAST(least(100, coalesce(list_sum(list_transform(flags, lambda f: {pts})), 0)) AS int) AS risk_score FROM u3),
url_risk AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM u4)"""
