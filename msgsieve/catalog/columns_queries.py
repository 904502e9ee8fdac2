"""Text, link, number, header and feature column queries."""

from pyspark.sql import functions as F

from msgsieve import lexicons as lx
from msgsieve.catalog import sqltext as q
from msgsieve.catalog.registry import Inputs, query
from msgsieve.functions import auth, features as fe, phones, text as t, urls
from msgsieve.operators import filters, lookups

AUTH = ", ".join(auth.AUTH_FLAGS)
TOK = q.rx_all("lower(body)", r"([a-z']+)")
FLAT = f"trim(concat(subject, ' ', body, ' ', sender, ' ', array_to_string({q.scheme_urls('body')}, ' ')))"


@query("F1_normalise_records", """
SELECT id, CASE WHEN coalesce(nullif(a, ''), '') <> '' THEN a ELSE coalesce(body, '') END AS body, coalesce(nullif(caller, ''), sender, '') AS sender
FROM (SELECT id, body, sender, CASE WHEN message_type = 'vishing' THEN subject ELSE '' END AS a, CASE WHEN message_type='smishing' THEN '' ELSE sender END AS caller FROM messages)""", "messages")
def _(i: Inputs):
    m = i.messages.select("id", "body", "sender",
                          F.when(F.col("message_type") == "vishing", F.col("subject")).otherwise("").alias("transcript"),
                          F.when(F.col("message_type") == "smishing", "").otherwise(F.col("sender")).alias("caller_id"))
    n = fe.normalise_records(m, "vishing")
    return n.select("id", "body", F.col("caller_id").alias("sender"))


@query("F2_flatten_text", f"""
SELECT id, CASE WHEN message_type='phishing' THEN {FLAT} ELSE trim(concat(sender, ' ', body)) END AS flat_text FROM messages""", "messages")
def _(i: Inputs):
    m = i.messages
    args = (F.col("subject"), F.col("body"), F.col("sender"))
    return m.select("id", F.when(F.col("message_type") == "phishing", fe.flatten_text("phishing", *args)).otherwise(fe.flatten_text("smishing", *args)).alias("flat_text"))


def _link(field: str) -> str:
    return f"coalesce(list_bool_or(list_transform(ls, lambda x: {field})), false)"


_HOST = "regexp_extract(lower(x), '(?:https?://)?([^/\\s?#]+)', 1)"
EMAIL_SQL = f"""
WITH {q.auth_cte()},
b AS (SELECT *, {FLAT} AS ft FROM auth),
c AS (SELECT *, lower(ft) AS low, {q.extract_urls('ft', lx.URL_SHORTENERS, lx.SUSPICIOUS_TLDS)} AS ls, list_distinct(regexp_extract_all(lower(ft), '([\\p{{L}}\\p{{N}}_]+)', 1)) AS words FROM b),
d AS (SELECT *, CAST({_link("contains(lower(x), 'http://')")} AS int) AS has_http,
  CAST({_link("regexp_matches(lower(x), 'https?://[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')")} AS int) AS has_ip,
  CAST({_link(q.any_of('lower(x)', lx.URL_SHORTENERS))} AS int) AS shortener,
  CAST({_link("contains(lower(x), 'xn--')")} AS int) AS punycode, CAST({_link("contains(x, '@')")} AS int) AS at_in_url,
  CAST({_link(f"list_contains({q.arr(lx.SUSPICIOUS_TLDS)}, list_extract(string_split({_HOST}, '.'), -1))")} AS int) AS suspicious_tld,
  least(coalesce(list_max(list_transform(ls, lambda x: {q.entropy(_HOST)})), 0), 5.0)::DOUBLE AS max_entropy,
  least(greatest(coalesce(list_max(list_transform(ls, lambda x: len(string_split({_HOST}, '.')) - 2)), 0), 0), 5)::DOUBLE AS max_depth,
  coalesce(list_max(list_transform(ls, lambda x: CASE WHEN length({_HOST}) > 0 THEN length(regexp_replace({_HOST}, '[^01234]', '', 'g'))::DOUBLE / length({_HOST}) ELSE 0.0 END)), 0)::DOUBLE AS max_homoglyph,
  least(coalesce(list_max(list_transform(ls, lambda x: length(x))), 0)::DOUBLE / 100, 5.0)::DOUBLE AS max_length FROM c)
SELECT id, least(len(ls), 10) AS url_count, has_http, has_ip, shortener, punycode, at_in_url, suspicious_tld, round(max_entropy, 6) AS max_entropy, max_depth,
  round(max_homoglyph, 6) AS max_homoglyph, max_length,
  least(len(list_filter(words, lambda w: list_contains({q.arr(lx.URGENCY_WORDS)}, w))), 10) AS urgency,
  least(len(list_filter(words, lambda w: list_contains({q.arr(lx.CREDENTIAL_WORDS)}, w))), 5) AS credential,
  least(length(ft) - length(replace(ft, '!', '')), 10) AS exclamation,
  CAST({q.any_of('low', lx.SAFE_PHRASES)} AND greatest(suspicious_tld, shortener, has_ip, punycode, at_in_url) = 0 AND auth_fail = 0 AS int) AS safe_signal,
  {AUTH},
  least(3, CASE WHEN {q.any_of('low', lx.BEC_INSTRUMENT)} AND {q.any_of('low', lx.BEC_REQUEST)} THEN 2 ELSE 0 END + CAST({q.any_of('low', lx.BEC_OPENER)} AS int) + CAST({q.any_of('low', lx.BEC_SECRECY)} AS int)) AS bec_signal
FROM d"""


def flat_email(i: Inputs):
    m = i.messages
    return m.withColumn("flat_text", fe.flatten_text("phishing", F.col("subject"), F.col("body"), F.col("sender")))


@query("F3_email_features", EMAIL_SQL, "messages")
def _(i: Inputs):
    out = fe.email_features(flat_email(i))
    return out.select("id", *fe.EMAIL_FEATURES).withColumns({c: F.round(c, 6) for c in ("max_entropy", "max_homoglyph")})


_SH = "split_part(regexp_replace(lower(x), '^https?://', ''), '/', 1)"
OTP_D = t.OTP_DELIVERY
SMS_SQL = f"""
WITH c AS (SELECT *, {q.scheme_urls('body')} AS ls, {TOK} AS tok, regexp_replace(sender, '[^0-9]', '', 'g') AS sd FROM messages)
SELECT id, len(ls)::DOUBLE AS url_count, len(list_filter(ls, lambda x: {q.any_of('lower(x)', lx.URL_SHORTENERS)}))::DOUBLE AS shortener_count,
  len(list_filter(ls, lambda x: contains({_SH}, '.') AND list_contains({q.arr(lx.SUSPICIOUS_TLDS)}, list_extract(string_split({_SH}, '.'), -1))))::DOUBLE AS tld_count,
  {q.lex_count('tok', lx.URGENCY_WORDS)}::DOUBLE AS urgency, {q.lex_count('tok', lx.CREDENTIAL_WORDS)}::DOUBLE AS credential,
  {q.lex_count('tok', lx.MONEY_WORDS)}::DOUBLE AS money, {q.lex_count('tok', lx.AUTHORITY_WORDS)}::DOUBLE AS authority,
  regexp_matches(body, '\\+?[0-9][0-9\\-()\\s\\x0B]{{8,}}[0-9]')::int::DOUBLE AS has_phone, least(length(body) / 160.0, 4.0)::DOUBLE AS segments,
  round({q.share('body', r'[\x00-\x7F]')}, 6) AS non_ascii, round({q.share('body', r'[^\p{Nd}]')}, 6) AS digits,
  round(CASE WHEN length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace(body, '[^\\p{{Lu}}]', '', 'g'))::DOUBLE / length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')) ELSE 0.0 END, 6) AS upper,
  (length(body) - length(replace(body, '!', '')))::DOUBLE AS exclamation,
  (length(sd) BETWEEN 3 AND 6)::int::DOUBLE AS is_shortcode, (regexp_matches(sender, '\\p{{L}}') AND length(sd) = 0)::int::DOUBLE AS is_alpha,
  (length(sd) >= 10)::int::DOUBLE AS is_long_number, {q.rx('body', OTP_D)}::int::DOUBLE AS otp_delivery, {q.rx('body', t.OTP_THEFT)}::int::DOUBLE AS otp_theft
FROM c"""


@query("F4_sms_features", SMS_SQL, "messages")
def _(i: Inputs):
    out = fe.sms_features(i.messages).select("id", *fe.SMS_FEATURES)
    return out.withColumns({c: F.round(c, 6) for c in ("non_ascii", "digits", "upper")})


@query("F4_voice_features", f"""
WITH c AS (SELECT *, {TOK} AS tok, regexp_replace(sender, '[^0-9]', '', 'g') AS sd FROM messages)
SELECT id, {q.lex_count('tok', lx.URGENCY_WORDS)}::DOUBLE AS urgency, {q.lex_count('tok', lx.CREDENTIAL_WORDS)}::DOUBLE AS credential,
  {q.lex_count('tok', lx.MONEY_WORDS)}::DOUBLE AS money, {q.lex_count('tok', lx.AUTHORITY_WORDS)}::DOUBLE AS authority,
  len({q.rx_all('body', fe.PRESS)})::DOUBLE AS press, {q.rx('body', fe.AUTOMATED)}::int::DOUBLE AS automated, {q.rx('body', fe.CALLBACK)}::int::DOUBLE AS callback,
  {q.rx('body', fe.GIFT_CARD)}::int::DOUBLE AS gift_card, regexp_matches(body, '\\+?[0-9][0-9\\-()\\s\\x0B]{{8,}}[0-9]')::int::DOUBLE AS has_phone,
  least(length(body) / 200.0, 5.0)::DOUBLE AS length, round({q.share('body', r'[^\p{Nd}]')}, 6) AS digits, least(len(tok) / 50.0, 5.0)::DOUBLE AS words,
  (regexp_matches(sender, '\\p{{L}}') AND length(sd) = 0)::int::DOUBLE AS is_alpha, (length(sd) >= 10)::int::DOUBLE AS is_long_number
FROM c""", "messages")
def _(i: Inputs):
    return fe.voice_features(i.messages).select("id", *fe.VOICE_FEATURES).withColumn("digits", F.round("digits", 6))


@query("F5_lexicon_counts", f"""
WITH c AS (SELECT id, {TOK} AS tok FROM messages)
SELECT id, {q.lex_count('tok', lx.URGENCY_WORDS)} AS urgency, {q.lex_count('tok', lx.CREDENTIAL_WORDS)} AS credential,
  {q.lex_count('tok', lx.MONEY_WORDS)} AS money, {q.lex_count('tok', lx.AUTHORITY_WORDS)} AS authority FROM c""", "messages")
def _(i: Inputs):
    tok = F.col("tok")
    return i.messages.select("id", t.tokens(F.col("body")).alias("tok")).select(
        "id", t.lexicon_count(tok, lx.URGENCY_WORDS).alias("urgency"), t.lexicon_count(tok, lx.CREDENTIAL_WORDS).alias("credential"),
        t.lexicon_count(tok, lx.MONEY_WORDS).alias("money"), t.lexicon_count(tok, lx.AUTHORITY_WORDS).alias("authority"))


@query("F6_character_mix", f"""
SELECT doc_id, round({q.entropy('text')}, 6) AS entropy, round({q.share('text', r'[\x00-\x7F]')}, 6) AS non_ascii, round({q.share('text', r'[^\p{Nd}]')}, 6) AS digits,
  length(text) - length(replace(text, '!', '')) AS exclamation, regexp_matches(text, '\\+?[0-9][0-9\\-()\\s\\x0B]{{8,}}[0-9]')::int AS has_phone FROM documents""")
def _(i: Inputs):
    c = F.col("text")
    return i.table("documents").select(
        "doc_id", F.round(t.text_entropy(c), 6).alias("entropy"), F.round(t.non_ascii_ratio(c), 6).alias("non_ascii"),
        F.round(t.digit_ratio(c), 6).alias("digits"), t.exclamations(c).alias("exclamation"), t.has_phone(c).alias("has_phone"))


@query("F7_sender_shape", """
WITH c AS (SELECT id, sender, regexp_replace(sender, '[^0-9]', '', 'g') AS sd FROM messages)
SELECT id, sd AS digits, (length(sd) BETWEEN 3 AND 6)::int AS is_shortcode, (regexp_matches(sender, '\\p{L}') AND length(sd) = 0)::int AS is_alpha, (length(sd) >= 10)::int AS is_long_number FROM c""", "messages")
def _(i: Inputs):
    s = F.col("sender")
    return i.messages.select("id", t.sender_digits(s).alias("digits"), t.sender_is_shortcode(s).alias("is_shortcode"),
                             t.sender_is_alpha(s).alias("is_alpha"), t.sender_is_long_number(s).alias("is_long_number"))


@query("F8_otp_signals", f"SELECT id, {q.rx('body', t.OTP_DELIVERY)}::int AS otp_delivery, {q.rx('body', t.OTP_THEFT)}::int AS otp_theft FROM messages", "messages")
def _(i: Inputs):
    return i.messages.select("id", t.otp_delivery(F.col("body")).alias("otp_delivery"), t.otp_theft(F.col("body")).alias("otp_theft"))


@query("F9_auth_columns", f"WITH {q.auth_cte()} SELECT id, {AUTH} FROM auth", "messages")
def _(i: Inputs):
    return auth.with_auth_columns(i.messages).select("id", *auth.AUTH_FLAGS)


@query("F10_bec_score", f"""
SELECT id, least(3, CASE WHEN {q.any_of('low', lx.BEC_INSTRUMENT)} AND {q.any_of('low', lx.BEC_REQUEST)} THEN 2 ELSE 0 END + CAST({q.any_of('low', lx.BEC_OPENER)} AS int)
  + CAST({q.any_of('low', lx.BEC_SECRECY)} AS int)) AS bec FROM (SELECT id, lower(body) AS low FROM messages)""", "messages")
def _(i: Inputs):
    return i.messages.select("id", fe.bec_score(F.lower("body")).alias("bec"))


@query("F11_extract_urls", f"""
SELECT id, unnest({q.extract_urls('body', lx.URL_SHORTENERS, lx.SUSPICIOUS_TLDS)}) AS url, generate_subscripts({q.extract_urls('body', lx.URL_SHORTENERS, lx.SUSPICIOUS_TLDS)}, 1) - 1 AS pos FROM messages""", "messages")
def _(i: Inputs):
    return i.messages.select("id", F.posexplode(urls.extract_urls(F.col("body"))).alias("pos", "url"))


@query("F11_url_variants", f"""
SELECT id, array_to_string({q.rx_all('body', urls.STRICT_URL)}, ' ') AS strict, array_to_string({q.rx_all('body', r"(https?://(?:[a-zA-Z0-9$-_@.&+!*\\(),]|%[0-9a-fA-F][0-9a-fA-F])+)")}, ' ') AS central FROM messages""", "messages")
def _(i: Inputs):
    b = F.col("body")
    return i.messages.select("id", F.array_join(urls.strict_urls(b), " ").alias("strict"), F.array_join(urls.central_urls(b), " ").alias("central"))


_PHONE_SQL = r"(?:^|[^0-9])((?:\+?1[\s.\-]*)?(?:\(?[0-9]{3}\)?[\s.\-]*)[0-9]{3}[\s.\-]*[0-9]{4})(?:[^0-9]|$)"


@query("F12_extract_phones", f"""
WITH raw AS (SELECT doc_id, {q.rx_all('text', _PHONE_SQL)} AS found FROM documents),
n AS (SELECT doc_id, list_distinct(list_filter(list_transform(found, lambda m: {q.e164('m')}), lambda e: starts_with(e, '+') AND length(e) - 1 BETWEEN 10 AND 15)) AS nums FROM raw)
SELECT doc_id, array_to_string(list_sort(nums), ',') AS phones FROM n""")
def _(i: Inputs):
    return i.table("documents").select("doc_id", F.array_join(F.array_sort(phones.extract_phones(F.col("text"))), ",").alias("phones"))


@query("F13_e164", f"SELECT id, {q.e164('sender')} AS number FROM messages", "messages")
def _(i: Inputs):
    return i.messages.select("id", phones.e164(F.col("sender")).alias("number"))


LINKS = f"links AS (SELECT id, message_type, unnest({q.scheme_urls('body')}) AS url FROM messages)"


@query("F14_url_risk", f"""
WITH {LINKS}, {q.url_risk_cte('links', lx)} SELECT id, url, domain, risk_score, threat_level, array_to_string(flags, '|') AS flags FROM url_risk""", "messages")
def _(i: Inputs):
    out = lookups.url_risk(lookups.url_table(i.messages))
    return out.select("id", "url", urls.netloc(F.col("url")).alias("domain"), "risk_score", "threat_level", F.array_join("flags", "|").alias("flags"))


@query("F14_page_url_risk", f"""
WITH {q.url_risk_cte('pages', lx)} SELECT page_id, risk_score, threat_level, array_to_string(flags, '|') AS flags FROM url_risk""")
def _(i: Inputs):
    return lookups.url_risk(i.table("pages").select("page_id", "url")).select("page_id", "risk_score", "threat_level", F.array_join("flags", "|").alias("flags"))


@query("F15_url_suspicion", f"""
WITH {LINKS}, d AS (SELECT *, {q.netloc('url')} AS d FROM links)
SELECT id, url, CASE WHEN len(list_filter({q.arr(['.' + x for x in lx.SUSPICIOUS_TLDS])}, lambda s: ends_with(d, s))) > 0 THEN concat('Suspicious TLD: ', d)
  WHEN regexp_matches(d, '^[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') THEN concat('IP address domain: ', d)
  WHEN {q.any_of('d', lx.URL_SHORTENERS)} THEN concat('URL shortener: ', d) WHEN starts_with(lower(url), 'http://') THEN 'Unencrypted HTTP (not HTTPS)' END AS reason FROM d""", "messages")
def _(i: Inputs):
    return lookups.url_table(i.messages).select("id", "url", urls.suspicion_reason(F.col("url")).alias("reason"))


def esp_sql(h: str) -> str:
    return (f"({h} <> '' AND (list_contains({q.arr(lx.ESP_HOSTS)}, {h}) OR len(list_filter({q.arr(lx.ESP_SUFFIXES)}, lambda s: ends_with({h}, s))) > 0 OR starts_with({h}, 'click.') "
            f"OR starts_with({h}, 'click-') OR contains({h}, '.click-') OR (contains({h}, 'notification.') AND {q.any_of(h, lx.ESP_BANKS)})))")


@query("F16_host_columns", f"""
WITH l AS (SELECT id, {q.sender_domain('sender')} AS sd, unnest({q.scheme_urls('body')}) AS url FROM messages),
h AS (SELECT *, {q.hostname('url')} AS host FROM l)
SELECT id, url, sd AS sender_domain, {q.last_two('host')} AS registrable, {esp_sql('host')} AS esp,
  (host <> '' AND sd <> '' AND ({q.last_two('host')} = {q.last_two('sd')} OR ends_with(host, concat('.', sd)) OR ends_with(sd, concat('.', host)))) AS aligned FROM h""", "messages")
def _(i: Inputs):
    m = i.messages.select("id", urls.sender_domain(F.col("sender")).alias("sender_domain"), F.explode(urls.scheme_urls(F.col("body"))).alias("url"))
    host = urls.hostname(F.col("url"))
    return m.select("id", "url", "sender_domain", urls.registrable(host).alias("registrable"), urls.is_esp_host(host).alias("esp"),
                    urls.aligned_with_sender(host, F.col("sender_domain")).alias("aligned"))


@query("F17_disposable_sender", f"""
SELECT id, (contains(s, '@') AND d NOT IN ('privaterelay.appleid.com','private.icloud.com') AND len(list_filter({q.arr(lx.DISPOSABLE_DOMAINS)}, lambda x: d = x OR ends_with(d, concat('.', x)))) > 0) AS disposable
FROM (SELECT id, lower(trim(sender)) AS s, trim(list_extract(string_split(lower(trim(sender)), '@'), -1)) AS d FROM messages)""", "messages")
def _(i: Inputs):
    return i.messages.select("id", lookups.disposable_sender(F.col("sender")).alias("disposable"))


@query("F18_homograph", f"""
WITH c AS (SELECT doc_id, list_filter(regexp_extract_all(text, '([A-Za-z\\x{{370}}-\\x{{3FF}}\\x{{400}}-\\x{{4FF}}][A-Za-z0-9\\x{{370}}-\\x{{3FF}}\\x{{400}}-\\x{{4FF}}._\\-]+)', 1),
  lambda k: regexp_matches(k, '\\p{{Latin}}') AND regexp_matches(k, '[\\p{{Greek}}\\p{{Cyrillic}}]')) AS mixed,
  regexp_extract_all(lower(text), '\\b(xn--[a-z0-9-]+)', 1) AS puny, translate(text, '{lx.CONFUSABLE_FROM}', '{lx.CONFUSABLE_TO}') AS folded FROM documents)
SELECT doc_id, array_to_string(mixed, ' ') AS mixed, array_to_string(puny, ' ') AS punycode, md5(folded) AS folded_md5 FROM c""")
def _(i: Inputs):
    c = F.col("text")
    return i.table("documents").select("doc_id", F.array_join(t.mixed_script_tokens(c), " ").alias("mixed"),
                                       F.array_join(t.punycode_labels(c), " ").alias("punycode"), F.md5(t.fold_confusables(c)).alias("folded_md5"))


@query("F19_digit_swap_brand", f"""
SELECT id, CASE {' '.join(f"WHEN NOT contains(low, '{b}') AND contains(de, '{b}') THEN '{b}'" for b in lx.IMPERSONATE)} END AS brand
FROM (SELECT id, lower(body) AS low, translate(lower(body), '01345$@', 'oleassa') AS de FROM messages)""", "messages")
def _(i: Inputs):
    return i.messages.select("id", t.digit_swapped_brand(F.col("body")).alias("brand"))


@query("F25_preview", """
WITH a AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&#?\\w+;', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g')) AS s FROM pages)
SELECT page_id, CASE WHEN length(s) > 220 THEN concat(substr(s, 1, 219), '…') ELSE s END AS preview,
  md5(trim(regexp_replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), '(?is)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '[\\s\\x0B]+', ' ', 'g'))) AS text_md5 FROM a""")
def _(i: Inputs):
    h = F.col("html")
    return i.table("pages").select("page_id", t.preview(h).alias("preview"), F.md5(t.strip_html(h)).alias("text_md5"))


def _hit(ps: list[str]) -> str:
    return q.rx("html", fe.joined(ps))


@query("F26_screen_injection", f"""
WITH a AS (SELECT page_id, html, lower(html) AS low, {_hit(fe.SQL_PATTERNS)} AS sql_hit, {_hit(fe.XSS_PATTERNS)} AS xss_hit, {_hit(fe.TRAVERSAL_PATTERNS)} AS path_hit,
  {_hit(fe.COMMAND_PATTERNS)} OR ({_hit(fe.PIPE_PATTERNS)} AND contains(lower(html), 'sh')) OR ({_hit(fe.SEMICOLON_PATTERNS)} AND {q.any_of('lower(html)', fe.SHELL_WORDS)}) AS command_hit,
  contains(html, '<') AND contains(html, '>') AND (contains(lower(html), '<?xml') OR (contains(html, '<!ENTITY') AND contains(html, 'SYSTEM'))) AND {_hit(fe.XXE_PATTERNS)} AS xxe_hit FROM pages)
SELECT page_id, sql_hit, xss_hit, path_hit, command_hit, xxe_hit, (xss_hit OR xxe_hit) AS quarantined FROM a""")
def _(i: Inputs):
    out = fe.screen_injection(i.table("pages"), "html")
    return out.select("page_id", "sql_hit", "xss_hit", "path_hit", "command_hit", "xxe_hit", "quarantined")


@query("F27_header_ips", """
SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(received, '\\b([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})\\b', 1),
  lambda ip: len(list_filter(string_split(ip, '.'), lambda o: CAST(o AS int) > 255)) = 0 AND NOT regexp_matches(ip, '^(127\\.|10\\.|192\\.168\\.|172\\.16\\.|172\\.31\\.)')))), ',') AS ips FROM messages""", "messages")
def _(i: Inputs):
    return i.messages.select("id", F.array_join(fe.header_ips(F.col("received")), ",").alias("ips"))


@query("F28_time_and_fingerprint", """
WITH a AS (SELECT id, sender, subject, body, ts, lower(trim(rfc_message_id)) AS mid, strftime(coalesce(ts, TIMESTAMP '2024-01-01'), '%Y-%m-%dT%H:%M:%S') AS iso FROM messages)
SELECT id, mid AS message_id, epoch_us(date_trunc('second', coalesce(ts, TIMESTAMP '2024-01-01'))) AS parsed_us, sha256(concat('mid:', mid)) AS fp_mid,
  sha256(concat_ws('|', lower(trim(coalesce(sender,''))), lower(trim(subject)), lower(trim(body)), iso)) AS fp_text FROM a""", "messages")
def _(i: Inputs):
    m = i.messages
    as_of = F.lit("2024-01-01").cast("timestamp")
    raw = F.when(F.col("id") % 2 == 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000 (UTC)'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    when = t.message_time(raw, as_of)
    mid = t.message_id(F.col("rfc_message_id"))
    cols = [F.col(c) for c in ("sender", "subject", "body")]
    return m.select("id", mid.alias("message_id"), F.unix_micros(when).alias("parsed_us"), t.fingerprint(mid, *cols, when).alias("fp_mid"),
                    t.fingerprint(F.lit(""), *cols, when).alias("fp_text"))


@query("F29_keys", f"""
WITH a AS (SELECT id, sender, body, lower(trim(sender)) AS s FROM messages),
b AS (SELECT *, list_concat(list_concat(
  list_transform(list_filter(list_transform(regexp_extract_all(concat(sender, ' ', body), '(\\+?[0-9][0-9\\-.\\s\\x0B()]{{7,}}[0-9])', 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: length(d) >= 10), lambda d: concat('phone:', right(d, 10))),
  list_transform(regexp_extract_all(sender, '@([A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', 1), lambda d: concat('domain:', lower(d)))),
  CASE WHEN regexp_matches(trim(sender), '^[A-Za-z]{{3,15}}$') THEN [concat('alpha:', upper(trim(sender)))] ELSE [] END) AS keys FROM a)
SELECT id, array_to_string(keys, ',') AS entity_keys, substr(sha256(CASE WHEN contains(s, '@') THEN regexp_replace(list_extract(string_split(s, '@'), -1), '^>+|>+$', '', 'g') ELSE s END), 1, 16) AS campaign_id,
  CASE WHEN {q.sender_domain('sender')} <> '' THEN {q.sender_domain('sender')} ELSE s END AS sender_key,
  CASE WHEN regexp_extract(s, '^[^@\\s]+@([^@\\s]+)$', 1) <> '' THEN concat('redacted@', regexp_extract(s, '^[^@\\s]+@([^@\\s]+)$', 1))
    WHEN regexp_matches(s, '^\\+[0-9]+$') THEN concat('+', repeat('*', greatest(length(s) - 5, 0)), right(s, 4)) ELSE 'redacted' END AS redacted FROM b""", "messages")
def _(i: Inputs):
    s = F.col("sender")
    return i.messages.select("id", F.array_join(t.entity_keys(s, F.col("body")), ",").alias("entity_keys"), t.campaign_id(s).alias("campaign_id"),
                             lookups.sender_key(s).alias("sender_key"), t.redact_sender(s).alias("redacted"))


@query("F35_sms_pattern_reasons", f"""
SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(body), {q.lit(p)}) THEN {q.lit(r)} END" for p, r in fe.SMS_PHRASES)},
  CASE WHEN starts_with(sender, '+') AND NOT starts_with(sender, '+1') THEN 'International number' END], lambda x: x IS NOT NULL), '|') AS reasons FROM messages""", "messages")
def _(i: Inputs):
    return i.messages.select("id", F.array_join(fe.sms_pattern_reasons(F.col("body"), F.col("sender")), "|").alias("reasons"))


@query("F39_grade_label", "SELECT message_id, CASE verdict WHEN 'block' THEN 1 WHEN 'safe' THEN 0 END AS label FROM grades", "grades")
def _(i: Inputs):
    from msgsieve.operators.keyed import grade_label
    return i.view("grades").select("message_id", grade_label(F.col("verdict")).alias("label"))


@query("F40_seed_weak_labels", f"""
WITH {q.auth_cte()}, f AS (SELECT *, concat_ws(' ', subject, body, sender) AS seed_text FROM auth)
SELECT id, md5(seed_text) AS text_md5, CASE WHEN auth_pass = 1 THEN 0 WHEN (({q.rx('seed_text', fe.SEED_BAD_TLD)} OR {q.rx('seed_text', fe.SEED_SHORTENER)}) AND NOT {q.rx('seed_text', fe.SEED_SAFE)}) OR auth_fail = 1 THEN 1 ELSE 0 END AS seed_label FROM f""", "messages")
def _(i: Inputs):
    return fe.seed_weak_labels(i.messages).select("id", F.md5("seed_text").alias("text_md5"), "seed_label")


@query("U3_url_union", f"""
WITH a AS (SELECT page_id, list_distinct(list_concat(list_concat({q.rx_all('url', urls.STRICT_URL)}, {q.rx_all('html', '(?i)href=["' + "'" + ']([^"' + "'" + ']+)["' + "'" + ']')}), {q.rx_all('html', '(?i)src=["' + "'" + ']([^"' + "'" + ']+)["' + "'" + ']')})) AS found FROM pages),
b AS (SELECT page_id, list_transform(list_concat(found, list_transform(found, lambda u: url_decode(u))), lambda u: trim(u)) AS both_ FROM a)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(both_, lambda u: CASE WHEN starts_with(u, 'www.') THEN concat('http://', u) ELSE u END), lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://')))), ' ') AS urls FROM b""")
def _(i: Inputs):
    return i.table("pages").select("page_id", F.array_join(urls.url_union(F.col("url"), F.col("html")), " ").alias("urls"))


@query("P21_egress_filter", f"""
WITH {LINKS}, h AS (SELECT id, url, {q.hostname('url')} AS host FROM links)
SELECT id, url, (host <> '' AND host NOT IN ('localhost','0.0.0.0','metadata.google.internal','169.254.169.254') AND NOT regexp_matches(host, '^(127\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|169\\.254\\.)')) AS allowed FROM h""", "messages")
def _(i: Inputs):
    return filters.egress_filter(lookups.url_table(i.messages)).select("id", "url", "allowed")


HIGH = f"WITH {LINKS}, {q.url_risk_cte('links', lx)}, high AS (SELECT id, count(*) AS n FROM url_risk WHERE risk_score >= 70 GROUP BY id)"


@query("flagship_high_risk_link_share", f"""
{HIGH} SELECT m.message_type, count(*) AS messages, CAST(sum(CASE WHEN high.n > 0 THEN 1 ELSE 0 END) AS bigint) AS with_high_risk_link,
  round(sum(CASE WHEN high.n > 0 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS share FROM messages m LEFT JOIN high ON high.id = m.id GROUP BY m.message_type""", "messages")
def _(i: Inputs):
    flagged = lookups.with_high_risk_links(i.messages.select("id", "message_type", "body"))
    hit = F.count_if(F.col("high_risk_links") > 0)
    return flagged.groupBy("message_type").agg(F.count("*").alias("messages"), hit.alias("with_high_risk_link"), F.round(hit / F.count("*"), 6).alias("share"))


@query("J22_url_boost", f"""
{HIGH} SELECT m.id, coalesce(high.n, 0) AS bad_links, CASE WHEN high.n > 0 THEN 1 ELSE m.is_threat END AS is_threat,
  CASE WHEN high.n > 0 THEN greatest(m.confidence, 0.85) ELSE m.confidence END AS confidence FROM messages m LEFT JOIN high ON high.id = m.id""", "messages")
def _(i: Inputs):
    m = i.messages
    return lookups.url_boost(m, lookups.url_risk(lookups.url_table(m))).select("id", "bad_links", "is_threat", "confidence")
