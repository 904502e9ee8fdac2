"""Policy, tag, finding, verdict, call and directory queries."""

from pyspark.sql import functions as F

from msgsieve import lexicons as lx
from msgsieve.catalog import sqltext as q
from msgsieve.catalog.columns_queries import esp_sql
from msgsieve.catalog.lookups_queries import KG, LOOK, SKEY, vectors  # noqa: F401
from msgsieve.catalog.registry import Inputs, query
from msgsieve.functions import findings as fi, policy as po, verdict as ve
from msgsieve.functions.features import image_only_cap
from msgsieve.operators import directory as di, filters, lookups as lk

# --- policy ------------------------------------------------------------------
_HOSTS = "list_append(list_transform(regexp_extract_all(low, 'https?://([^/\\s\"''<>]+)', 1), lambda h: regexp_replace(split_part(h, ':', 1), '^www\\.', '')), dom)"


def _spoof() -> str:
    ask = f"({q.any_of('low', lx.PAYMENT_ASK)} OR contains(low, 'locked out'))"
    arms = []
    for b, real in lx.PAYMENT_BRANDS:
        wants = q.any_of("low", [f"pay with {b}", f"pay via {b}", f"{b} payment", f"send {b}"])
        arms.append(f"(contains(low, '{b}') AND ({ask} OR {wants}) AND len(list_filter(hosts, lambda h: len(list_filter({q.arr(real)}, lambda d: h = d OR ends_with(h, concat('.', d)))) > 0)) = 0)")
    return "(" + " OR ".join(arms) + ")"


_HITS = "(" + " + ".join(f"contains(low, {q.lit(w)})::int" for w in lx.RECRUIT) + ")"
_BLAST = "(contains(low, 'hello all') AND contains(low, 'applied'))"
_MERGE = q.any_of("low", lx.MERGE_TAGS)
_NL = f"(len(list_filter({q.arr(lx.NEWSLETTER_DOMAINS)}, lambda d: dom = d OR ends_with(dom, concat('.', d)))) > 0)"
_LISTED = "(coalesce(list_unsubscribe, '') <> '')"
POLICY = f"""{q.auth_cte(bare=False)}, {KG},
p0 AS (SELECT auth.*, kg.matched_domain, lower(concat_ws(' ', coalesce(subject,''), coalesce(body,''))) AS low, {q.sender_domain('sender')} AS dom FROM auth JOIN kg ON kg.id = auth.id),
p1 AS (SELECT *, {_HOSTS} AS hosts FROM p0),
p2 AS (SELECT *, {q.any_of('low', lx.HARD_MALICE)} OR {_spoof()} AS hard_malice, {_MERGE} AS merge_, {_HITS} >= 2 OR {_BLAST} AS many_,
  {_HITS} >= 2 OR {_BLAST} OR ({_MERGE} AND {q.any_of('low', lx.JOB_CONTEXT)}) AS job_, {q.rx('low', po.CALLBACK)} AS callback_pressure, {q.rx('sender', po.FREE_MAIL)} AS free_ FROM p1),
p3 AS (SELECT *, (job_ AND callback_pressure AND dom <> '' AND {q.any_of('dom', lx.RECRUIT_SENDER_HINTS)} AND len(list_filter(regexp_extract_all(low, '(?:www\\.)?([a-z0-9\\-]+\\.(?:com|net|org))', 1),
  lambda s: NOT contains(dom, s) AND NOT contains(s, dom) AND {q.any_of('s', lx.RECRUIT_SITE_HINTS)})) > 0) AS domain_mismatch FROM p2),
p4 AS (SELECT *, (merge_ AND job_) OR (free_ AND many_) OR domain_mismatch AS recruit_scam FROM p3),
pol AS (SELECT *, auth_pass=1 AND NOT hard_malice AND NOT recruit_scam AND (({_NL} AND ({_LISTED} OR {q.any_of('low', lx.UNSUBSCRIBE)} OR contains(low,'newsletter') OR contains(low,'tldr')))
   OR ({_LISTED} AND {q.any_of('low', lx.UNSUBSCRIBE)}) OR ({q.any_of('low', lx.UNSUBSCRIBE)} AND contains(low,'newsletter'))) AS marketing,
  matched_domain IS NOT NULL AND auth_pass=1 AND auth_fail=0 AND NOT hard_malice AND NOT recruit_scam AS known_good,
  auth_pass=1 AND NOT hard_malice AND NOT recruit_scam AND {q.any_of('low', lx.FINANCIAL_NOTICE)} AS auth_financial FROM p4)"""
SIG = ", ".join(po.SIGNALS)


@query("F20_policy_signals", f"WITH {POLICY} SELECT id, {SIG}, auth_pass, auth_fail, dom AS sender_domain FROM pol", "messages")
def _(i: Inputs):
    return po.policy_signals(i.messages).select("id", *po.SIGNALS, "auth_pass", "auth_fail", "sender_domain")


def with_policy(i: Inputs):
    return po.policy_verdict(po.policy_signals(lk.match_fleet_keys(i.messages, i.view("fleet"))))


VERDICT = f"""{POLICY}, pv0 AS (SELECT pol.*, f.confidence AS fc, f.sender_key IS NOT NULL AND NOT known_good AS fh FROM pol LEFT JOIN fleet f ON f.sender_key = pol.dom AND pol.dom <> ''),
pv AS (SELECT *, CASE WHEN recruit_scam OR hard_malice OR fh THEN 1 WHEN known_good OR auth_financial OR marketing THEN 0 END AS policy_pred,
 CASE WHEN recruit_scam THEN 0.94 WHEN hard_malice AND auth_pass=0 THEN 0.91 WHEN hard_malice AND callback_pressure THEN 0.92 WHEN hard_malice THEN 0.91 WHEN fh THEN least(0.75, fc)
  WHEN known_good THEN 0.02 WHEN auth_financial THEN 0.15 WHEN marketing THEN 0.12 END::DOUBLE AS policy_confidence FROM pv0)"""


@query("F30_policy_verdict", f"WITH {VERDICT} SELECT id, policy_pred, policy_confidence FROM pv", "messages fleet")
def _(i: Inputs):
    return with_policy(i).select("id", "policy_pred", "policy_confidence")


@query("P13_rescore_backfill", f"""
WITH {VERDICT}, p AS (SELECT * FROM pv WHERE (label IS NULL OR label <> 0) AND confidence >= 0.5)
SELECT id, 0 AS label, 0 AS is_threat, policy_confidence AS confidence, matched_domain FROM p WHERE policy_pred = 0 AND policy_confidence <= 0.05 AND matched_domain IS NOT NULL""", "messages fleet")
def _(i: Inputs):
    scored = with_policy(i).withColumnsRenamed({"policy_pred": "new_pred", "policy_confidence": "new_confidence"})
    kg = i.messages.select("id", lk.known_good_match(F.col("sender")).alias("matched_domain")).filter("matched_domain is not null")
    return filters.rescore_backfill(scored, kg).select("id", "label", "is_threat", "confidence", "matched_domain")


# --- tags --------------------------------------------------------------------
def _tag(code: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN '{code}' END"


_W = {k: q.any_of("low", v) for k, v in {
    "recruit": lx.TAG_RECRUIT, "spam": lx.TAG_SPAM, "money": lx.TAG_MONEY, "pii": lx.TAG_PII, "merge": lx.TAG_MERGE_FRAUD,
    "happy": lx.HAPPY, "fear": lx.URGENT + lx.FEAR, "brand": lx.IMPERSONATE, "verify": lx.TAG_VERIFY, "rel": lx.RELATIONSHIP,
    "black": lx.BLACKMAIL, "social": lx.SOCIAL_ENG, "adv": lx.ADVANCE_FEE, "sec": lx.TAG_SECURITY, "txn": lx.TAG_TXN,
    "mkt": lx.TAG_MARKETING, "rej": lx.TAG_REJECTION}.items()}
TAGS = f"""t0 AS (SELECT *, lower(concat(coalesce(subject,''), chr(10), coalesce(body,''))) AS low FROM messages),
t1 AS (SELECT *, regexp_matches(lower(sender), '@(gmail|yahoo|hotmail|outlook|icloud)\\.com\\b') AND {_W['recruit']} AS rg, {_W['merge']} AND {_W['recruit']} AS js, {_W['happy']} AS hp, {_W['fear']} AS fe,
  {_W['brand']} AND {_W['verify']} AS im, {_W['rel']} AS rl, {_W['black']} AS bk, {_W['spam']} AS sp, {_W['money']} AS mo, {_W['adv']} AS av, {_W['pii']} AS pi,
  {' + '.join(f"contains(low, {q.lit(w)})::int" for w in lx.TAG_POSITIVE)} AS pos, {' + '.join(f"contains(low, {q.lit(w)})::int" for w in lx.TAG_NEGATIVE)} AS neg FROM t0),
t2 AS (SELECT *, list_filter([{_tag('RECRUIT_GMAIL','rg')}, {_tag('JOB_SCAM','js')}, {_tag('BLAST', "contains(low,'bcc') OR contains(low,'hello all')")}, {_tag('HAPPY_LURE','hp')}, {_tag('FEAR_URGENCY','fe')},
  {_tag('IMPERSONATION','im')}, {_tag('RELATIONSHIP_NSFW','rl')}, {_tag('BLACKMAIL','bk')}, {_tag('SOCIAL_ENG', _W['social'] + ' OR hp::int + fe::int + im::int + rl::int + bk::int >= 2')},
  {_tag('SPAM_LIST','sp AND NOT mo AND NOT pi AND NOT js')}, {_tag('MALICE_MONEY','mo')}, {_tag('ADVANCE_FEE','av')}, {_tag('MALICE_PII','pi')}, {_tag('THREAT_MALICE','mo OR pi OR js OR av')},
  {_tag('THREAT_SPAM','sp AND NOT (mo OR pi OR js OR av)')}, {_tag('SECURITY', _W['sec'])}, {_tag('TXN', _W['txn'])}, {_tag('MARKETING', 'sp OR ' + _W['mkt'])}, {_tag('REJECTION', _W['rej'])}], lambda x: x IS NOT NULL) AS found FROM t1),
tg AS (SELECT *, list_slice(list_append(found, CASE WHEN fe OR bk OR rl OR rg OR js OR mo OR pi THEN 'SENT_NEG' WHEN pos > neg AND pos > 0 THEN 'SENT_POS' WHEN len(found) = 0 THEN 'SENT_UNK' ELSE 'SENT_NEUT' END), 1, 10) AS tags FROM t2)"""


@query("F21_message_tags", f"WITH {TAGS} SELECT id, array_to_string(tags, ',') AS tags FROM tg", "messages")
def _(i: Inputs):
    return po.message_tags(i.messages).select("id", F.array_join("tags", ",").alias("tags"))


# --- findings ----------------------------------------------------------------
def _c(code: str, cond: str) -> str:
    return f"({cond}) AS \"{code}\""


def _ors(codes: list[str]) -> str:
    return "(" + " OR ".join(f'"{c}"' for c in codes) + ")"


_TF = r"(?:^|[^0-9])((?:\+?1[\s\-.]?)?(?:800|888|877|866|855|844|833)[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{4})(?:[^0-9A-Za-z_]|$)"
_TR = f"translate({{}}, '{lx.CONFUSABLE_FROM}', '{lx.CONFUSABLE_TO}')"
_ADDR = "([\\w.+-]{1,64}@[\\w.-]{1,253}\\.[A-Za-z]{2,24})"
_sens = " OR ".join(q.rx("low", fi.t.bounded(w)) if w in lx.SENSITIVE_BOUNDED else f"contains(low, '{w}')" for w in lx.SENSITIVE_WORDS)
_brand = " OR ".join(q.rx("low", fi.t.bounded(b)) for b in lx.IMPERSONATE)
_ATT = "(?i)(\\.(?:" + "|".join(lx.RISKY_ATTACHMENT_EXT) + ")\\b)"
FIND = f"""{KG}, {LOOK}, f0 AS (SELECT m.*, kg.matched_domain, look.brand AS lookalike, concat(coalesce(subject,''), chr(10), coalesce(body,'')) AS content, concat(sender, chr(10), coalesce(subject,''), chr(10), coalesce(body,'')) AS blob,
  {q.sender_domain('sender')} AS dom, lower(concat_ws(' ', coalesce(received_spf,''), coalesce(auth_results,''))) AS stamps,
  trim(regexp_extract(sender, '^\\s*"?([^"<>]{{0,200}})"?\\s*<([^>]{{1,320}})>', 1)) AS dname, trim(regexp_extract(sender, '^\\s*"?([^"<>]{{0,200}})"?\\s*<([^>]{{1,320}})>', 2)) AS daddr FROM messages m JOIN kg ON kg.id = m.id JOIN look ON look.id = m.id),
f1 AS (SELECT *, lower({_TR.format('blob')}) AS low, {_TR.format('blob')} AS folded, list_transform(regexp_extract_all(content, '(?i)https?://([^/\\s\\x0B:]+)', 1), lambda d: lower(d)) AS links,
  regexp_replace(lower(dname), '[^a-z0-9]', '', 'g') AS nkey, trim(regexp_replace(regexp_replace(content, '<[^>]{{0,500}}>', ' ', 'g'), '[ \\t\\r\\n\\f]{{1,64}}', ' ', 'g')) AS plain,
  lower(regexp_extract(coalesce(reply_to,''), '{_ADDR}', 1)) AS ra, lower(regexp_extract(sender, '{_ADDR}', 1)) AS sa FROM f0),
f2 AS (SELECT *, list_filter(links, lambda d: NOT {esp_sql('d')} AND NOT (d <> '' AND dom <> '' AND ({q.last_two('d')} = {q.last_two('dom')} OR ends_with(d, concat('.', dom)) OR ends_with(dom, concat('.', d))))) AS foreign_,
  lower(translate(low, '01345$@', 'oleassa')) AS de FROM f1),
f3 AS (SELECT *, {_c('HOMOGRAPH', "len(list_filter(regexp_extract_all(blob, '([A-Za-z\\x{370}-\\x{3FF}\\x{400}-\\x{4FF}][A-Za-z0-9\\x{370}-\\x{3FF}\\x{400}-\\x{4FF}._\\-]+)', 1), lambda k: regexp_matches(k, '\\p{Latin}') AND regexp_matches(k, '[\\p{Greek}\\p{Cyrillic}]'))) > 0")},
  {_c('PUNYCODE_IDN', "regexp_matches(lower(blob), '\\bxn--[a-z0-9-]+')")},
  {_c('HTML_OBFUSCATION', ' OR '.join(f"(NOT contains(low, '{b}') AND contains(de, '{b}'))" for b in lx.IMPERSONATE))},
  {_c('URGENCY_FEAR', q.any_of('low', lx.URGENT + lx.FEAR))}, {_c('HAPPY_LURE', q.any_of('low', lx.HAPPY))}, {_c('CREDIT_LURE', q.any_of('low', lx.CREDIT_LURE))},
  {_c('SENSITIVE_ASK', _sens)}, {_c('RELATIONSHIP_LURE', q.any_of('low', lx.RELATIONSHIP))}, {_c('BLACKMAIL', q.any_of('low', lx.BLACKMAIL))},
  {_c('BAD_URL', f"len(list_filter(foreign_, lambda d: len(list_filter({q.arr(['.' + x for x in lx.SUSPICIOUS_TLDS])}, lambda s: ends_with(d, s))) > 0)) > 0")},
  {_c('SHORT_LINK', f"len(list_filter(links, lambda d: len(list_filter({q.arr(lx.URL_SHORTENERS)}, lambda s: d = s OR ends_with(d, concat('.', s)))) > 0)) > 0")},
  {_c('DOMAIN_MISMATCH', "dom <> '' AND len(foreign_) > 0 AND len(list_filter(foreign_, lambda d: contains(d, dom) OR contains(dom, d))) = 0")},
  {_c('SUSPICIOUS_RELAY', q.any_of('dom', lx.RELAY_HINTS) + ' OR ' + q.any_of('low', lx.RELAY_HINTS))},
  {_c('DISPLAY_NAME_SPOOF', "daddr <> '' AND matched_domain IS NULL AND length(nkey) >= 4 AND NOT contains(lower(daddr), nkey) AND len(list_filter(regexp_extract_all(lower(dname), '([a-z]{4,})', 1), lambda w: contains(lower(daddr), w))) = 0")},
  {_c('CALLBACK_PRESSURE', "message_type <> 'phishing' AND regexp_matches(content, '\\+?[0-9][0-9\\-.\\s\\x0B()]{7,}[0-9]')")},
  {_c('TOLL_FREE_CALLBACK', "message_type <> 'phishing' AND " + q.rx('content', _TF))}, {_c('NEIGHBOR_SPOOF', 'false')}, {_c('ADVANCE_FEE', q.any_of('low', lx.ADVANCE_FEE))},
  {_c('IMAGE_ONLY', "(regexp_matches(content, '(?i)<img\\b|cid:|\\[image:') AND length(plain) < 48) OR (length(plain) < 12 AND length(content) > 80 AND (contains(low,'<html') OR contains(low,'multipart')))")},
  {_c('ATTACHMENT_RISK', q.rx("concat_ws(' ', content, coalesce(attachments,''))", _ATT))}, {_c('LOOKALIKE_DOMAIN', 'lookalike IS NOT NULL')},
  {_c('SPF_FAIL', "contains(stamps,'spf=fail') OR contains(stamps,'spf fail')")}, {_c('DKIM_FAIL', "contains(stamps,'dkim=fail')")}, {_c('DMARC_FAIL', "contains(stamps,'dmarc=fail')")},
  {_c('AUTH_PASS', "(contains(stamps,'spf=pass') OR contains(stamps,'dkim=pass') OR contains(stamps,'dmarc=pass')) AND NOT (contains(stamps,'spf=fail') OR contains(stamps,'spf fail') OR contains(stamps,'dkim=fail') OR contains(stamps,'dmarc=fail'))")},
  {_c('REPLY_TO_MISMATCH', "ra <> '' AND sa <> '' AND ra <> sa AND split_part(ra,'@',-1) <> split_part(sa,'@',-1)")}, {_brand} AS brand_hit FROM f2),
fp AS (SELECT f3.*, fl.sender_key IS NOT NULL AS fleet_hit FROM f3 LEFT JOIN fleet fl ON fl.sender_key = CASE WHEN dom <> '' THEN dom ELSE lower(trim(sender)) END),
f4 AS (SELECT fp.*, (fleet_hit OR (message_type = 'vishing' AND camp.campaign_id IS NOT NULL)) AS "CAMPAIGN_MATCH" FROM fp LEFT JOIN camp ON camp.id = fp.id),
f5 AS (SELECT *, brand_hit AND matched_domain IS NULL AND CASE WHEN "AUTH_PASS" AND (contains(low,'unsubscribe') OR contains(low,'newsletter') OR contains(low,'view in browser') OR contains(low,'tldrnewsletter')) THEN {_ors(fi.NEWSLETTER_CONTEXT)} ELSE {_ors(fi.SPOOF_CONTEXT)} END AS "IMPERSONATION" FROM f4),
f6 AS (SELECT *, {' + '.join(f'"{c}"::int' for c in fi.LURES)} >= 2 AS "SOCIAL_ENGINEERING" FROM f5),
fin AS (SELECT *, list_filter([{', '.join(f'CASE WHEN "{c}" THEN {q.lit(c)} END' for c in fi.ORDER)}], lambda x: x IS NOT NULL) AS codes FROM f6)"""
_CAMPRX = r"(?:^|[^0-9])((?:\+?1[\s\-.]?)?\(?[0-9]{3}\)?[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{4})(?:[^0-9]|$)"
CAMP = f"""camp AS (SELECT c.id, min(p.campaign_id) AS campaign_id FROM (SELECT id, unnest(list_concat([right(regexp_replace(sender, '[^0-9]', '', 'g'), 10)], list_transform({q.rx_all('body', _CAMPRX)}, lambda p: right(regexp_replace(p, '[^0-9]', '', 'g'), 10)))) AS digits FROM messages) c JOIN packs p ON p.digits = c.digits GROUP BY c.id)"""
FINDINGS = f"{CAMP}, {FIND}"


def with_findings(i: Inputs):
    messages = i.timeless_messages
    m = lk.match_fleet_keys(messages, i.view("fleet"))
    m = m.join(lk.match_campaign_packs(messages, i.view("packs")), "id", "left")
    return fi.analyse_findings(m, campaign="campaign_id")


@query("F22_findings", f"WITH {FINDINGS} SELECT id, array_to_string(codes, ',') AS codes FROM fin", "messages fleet packs")
def _(i: Inputs):
    return with_findings(i).select("id", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@query("F22_finding_rows", f"WITH {FINDINGS} SELECT id, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS pos, true AS has_evidence FROM fin", "messages fleet packs")
def _(i: Inputs):
    return fi.finding_rows(with_findings(i)).select("id", "code", "pos", (F.length("evidence").between(1, 160)).alias("has_evidence"))


REASONS = f"""{FINDINGS}, rc AS (SELECT *, CASE WHEN matched_domain IS NOT NULL THEN ['KNOWN_GOOD'] WHEN len(codes) = 0 AND confidence >= 0.5 THEN ['ANOMALY'] ELSE codes END AS reasons FROM fin)"""


def with_reasons(i: Inputs):
    w = with_findings(i).withColumn("kg", lk.known_good_match(F.col("sender")).isNotNull())
    return fi.reason_codes(w, known_good="kg")


@query("F23_reason_codes", f"WITH {REASONS} SELECT id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) > 0 THEN reasons[1] ELSE 'ANOMALY' END AS primary_code FROM rc", "messages fleet packs")
def _(i: Inputs):
    return with_reasons(i).select("id", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"), "primary_code")


_ALIAS = "CASE g " + " ".join(f"WHEN '{k}' THEN {q.arr(v)}" for k, v in lx.PILL_ALIASES.items()) + " ELSE [g] END"


@query("F24_display_pills", f"""
WITH {TAGS}, {REASONS}, p AS (SELECT rc.id, list_slice(rc.reasons, 1, 6) AS pr, tg.tags FROM rc JOIN tg ON tg.id = rc.id)
SELECT id, array_to_string(pr, ',') AS pill_reasons, array_to_string(list_slice(list_filter(tags, lambda g: NOT list_has_any({_ALIAS}, pr) AND NOT list_contains(pr, g)), 1, 4), ',') AS pill_tags,
 array_to_string(list_transform(pr, lambda r: CASE {' '.join(f"WHEN r = '{k}' THEN '{v}'" for k, v in lx.FINDING_SEVERITY.items())} ELSE 'warn' END), ',') AS severities FROM p""", "messages fleet packs")
def _(i: Inputs):
    p = fi.display_pills(with_reasons(i))
    return p.select("id", *[F.array_join(c, ",").alias(c) for c in ("pill_reasons", "pill_tags", "severities")])


@query("F38_explain_rows", f"""
WITH {REASONS}, e AS (SELECT *, CASE WHEN len(reasons) > 0 THEN reasons[1] ELSE 'ANOMALY' END AS pc FROM rc)
SELECT id, {q.arr(lx.EXPLAIN_OPENERS)}[(CAST(concat('0x', substr(md5(concat(sender, '|', substr(content, 1, 80), '|', pc)), 1, 8)) AS bigint) % 10) + 1] AS opener, pc AS primary_code FROM e""", "messages fleet packs")
def _(i: Inputs):
    out = fi.explain_rows(with_reasons(i))
    return out.select("id", F.split_part("why_text", F.lit(": "), F.lit(1)).alias("opener"), "primary_code")


@query("F31_image_only_cap", """
WITH a AS (SELECT page_id, html, lower(html) AS low, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g')) AS plain FROM pages)
SELECT page_id, CASE WHEN (regexp_matches(low, '<img\\b|cid:|\\[image:') AND length(plain) < 48) OR (length(plain) < 12 AND length(html) > 80 AND (contains(low,'<html') OR contains(low,'multipart'))) THEN 0.72 ELSE 0.9 END::DOUBLE AS confidence FROM a""")
def _(i: Inputs):
    return i.table("pages").select("page_id", image_only_cap(F.lit(0.9), F.col("html")).alias("confidence"))


# --- verdict -----------------------------------------------------------------
def scored(i: Inputs):
    k = F.col("id")
    return i.messages.select("id", "sender", F.col("is_threat").alias("pred"), F.col("confidence").alias("conf"),
                             F.when(k % 7 == 0, "EXTREME").when(k % 7 == 1, "CRITICAL").when(k % 7 == 2, "WARNING").alias("anomaly_level"),
                             ((k % 11).cast("double") / 10).alias("novelty"), ((k % 13).cast("double") / 12).alias("sender_risk"), ((k % 17).cast("double") / 16).alias("link_risk"))


RISK = """s AS (SELECT id, is_threat AS p, confidence AS c, CASE id % 7 WHEN 0 THEN 'EXTREME' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'NORMAL' END AS l0, (id % 11)::DOUBLE / 10 AS n0, (id % 13)::DOUBLE / 12 AS sr, (id % 17)::DOUBLE / 16 AS lr FROM messages),
g AS (SELECT *, NOT ((p=1 AND c>=0.85) OR (p=0 AND c>=0.92)) AS gray FROM s), h AS (SELECT *, CASE WHEN gray THEN l0 ELSE 'NORMAL' END AS lvl, CASE WHEN gray THEN n0 ELSE 0 END AS nov FROM g),
rv AS (SELECT id, CASE WHEN p=1 AND c>=0.85 THEN 'quarantine' WHEN lvl='EXTREME' THEN 'triage_novel' WHEN p=1 THEN 'review' WHEN lvl='CRITICAL' THEN 'triage_novel' ELSE 'pass' END AS action,
 (p=1 AND c>=0.85) OR (p=1 AND lvl<>'EXTREME') AS verdict_threat, round(greatest(CASE WHEN p=1 THEN c ELSE 0 END, 0.6*nov, CASE WHEN sr>=0.45 THEN sr*0.25 ELSE 0 END, CASE WHEN lr>=0.5 THEN lr*0.3 ELSE 0 END), 4)::DOUBLE AS risk_score,
 (sr>=0.45)::int + (lr>=0.5)::int + (lvl IN ('CRITICAL','EXTREME'))::int + 1 AS n_reasons FROM h)"""


@query("F32_risk_verdict", f"WITH {RISK} SELECT * FROM rv", "messages")
def _(i: Inputs):
    return ve.risk_verdict(scored(i)).select("id", "action", "verdict_threat", "risk_score", F.size("reasons").alias("n_reasons"))


_FUSE = """fz AS (SELECT number, max(risk) AS base, count_if(risk >= 0.4) AS fl, sum(report_count) AS report_count, list_sort(list(DISTINCT category) FILTER (WHERE category <> '')) AS cats, list_sort(list(DISTINCT source)) AS srcs FROM number_feed GROUP BY 1),
fr AS (SELECT *, round(least(1.0, base + CASE WHEN base >= 0.4 THEN least(0.15, 0.05 * greatest(0, fl - 1)) ELSE 0 END), 4)::DOUBLE AS risk FROM fz),
fu AS (SELECT *, round(least(1.0, 0.4 + 0.2 * len(srcs)), 4)::DOUBLE AS confidence, CASE WHEN risk >= 0.75 OR (list_has_any(cats, ['fraud','scam','irs_scam','phishing','identity_theft']) AND risk >= 0.5) THEN 'fraud' WHEN risk >= 0.4 THEN 'spam' WHEN risk > 0 THEN 'neutral' ELSE 'unknown' END AS verdict FROM fr)"""


def fused(i: Inputs):
    feed = i.view("number_feed").withColumn("categories", F.filter(F.array("category"), lambda c: c != ""))
    return ve.fuse_reputation(feed)


@query("A16_fuse_reputation", f"WITH {_FUSE} SELECT number, risk, CAST(report_count AS bigint) AS report_count, array_to_string(coalesce(cats, []), ',') AS categories, array_to_string(srcs, ',') AS sources, confidence, verdict FROM fu", "number_feed")
def _(i: Inputs):
    return fused(i).select("number", "risk", "report_count", F.array_join("categories", ",").alias("categories"), F.array_join("sources", ",").alias("sources"), "confidence", "verdict")


@query("F33_screen_calls", f"""
WITH {_FUSE}, ca AS (SELECT e.event_id, e.user_id, e.event_id % 3 = 0 AS ht, (e.event_id % 21)::DOUBLE / 20 AS cr, e.event_id % 2 = 0 AS ct, e.event_id % 5 = 0 AS vo, (e.event_id % 11)::DOUBLE / 10 AS vr, e.event_id % 10 = 0 AS syn,
  CASE e.event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cv, e.event_id % 19 = 0 AS ck FROM events e),
j AS (SELECT ca.*, coalesce(fu.risk, 0) AS rr, fu.verdict AS rvd, coalesce(fu.cats, []) AS cats, coalesce(fu.srcs, []) AS srcs FROM ca LEFT JOIN fu ON fu.number = concat('+1888555', right(concat('0000', ca.user_id * 2), 4))),
k AS (SELECT *, CASE WHEN ht THEN cr ELSE 0 END AS c1, CASE WHEN vo THEN least(vr, 0.65) ELSE 0 END AS v1 FROM j),
r1 AS (SELECT *, greatest(rr, c1, v1) AS r0 FROM k), r2 AS (SELECT *, CASE WHEN rr >= 0.4 AND c1 >= 0.4 THEN least(1.0, r0 + 0.08) ELSE r0 END AS ra FROM r1),
r3 AS (SELECT *, CASE WHEN v1 >= 0.4 AND (rr >= 0.4 OR c1 >= 0.4) THEN least(1.0, ra + 0.05) ELSE ra END AS rb FROM r2),
r4 AS (SELECT *, round(CASE WHEN cv THEN greatest(0.0, rb - 0.05) WHEN NOT cv THEN least(1.0, rb + 0.05) ELSE rb END, 4)::DOUBLE AS risk FROM r3),
r5 AS (SELECT *, CASE WHEN ck THEN CASE WHEN risk >= 0.6 THEN 'label' ELSE 'allow' END WHEN risk >= 0.85 THEN 'block' WHEN risk >= 0.6 THEN 'silence' WHEN risk >= 0.4 THEN 'label' ELSE 'allow' END AS action,
 CASE WHEN coalesce(rvd, 'unknown') <> 'unknown' THEN rvd WHEN risk >= 0.85 THEN 'fraud' WHEN risk >= 0.4 THEN 'spam' ELSE 'unknown' END AS verdict FROM r4),
r6 AS (SELECT *, CASE WHEN action = 'allow' THEN '' ELSE coalesce(CASE cats[1] {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in lx.CALL_LABELS.items())} END, CASE verdict WHEN 'fraud' THEN 'Likely fraud' WHEN 'spam' THEN 'Spam likely' ELSE 'Suspicious caller' END) END AS lab FROM r5)
SELECT event_id, risk, action, verdict, action IN ('block','silence') AS is_threat, CASE WHEN lab = '' AND vo AND syn THEN 'Possible cloned voice' ELSE lab END AS label,
 concat_ws(',', CASE WHEN len(srcs) > 0 THEN 'reputation' END, CASE WHEN ht THEN 'transcription' END, CASE WHEN vo THEN 'voice' END) AS paths FROM r6""", "number_feed")
def _(i: Inputs):
    k = F.col("event_id")
    calls = i.table("events").select(
        "event_id", F.concat(F.lit("+1888555"), F.right(F.concat(F.lit("0000"), (F.col("user_id") * 2).cast("string")), F.lit(4))).alias("number"),
        (k % 3 == 0).alias("has_transcript"), ((k % 21).cast("double") / 20).alias("content_risk"), (k % 2 == 0).alias("content_threat"),
        F.array(F.lit("no threat signal")).alias("content_reasons"), (k % 5 == 0).alias("voice_ok"), ((k % 11).cast("double") / 10).alias("voice_risk"),
        F.when(k % 10 == 0, F.array(F.lit("SYNTHETIC_VOICE_SUSPECTED"))).otherwise(F.array().cast("array<string>")).alias("voice_codes"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("carrier_verified"), (k % 19 == 0).alias("contact_known"))
    rep = fused(i).select("number", F.col("risk").alias("rep_risk"), F.col("verdict").alias("rep_verdict"), F.col("categories").alias("rep_categories"),
                          F.col("sources").alias("rep_sources"), F.col("report_count").alias("rep_reports"))
    out = ve.screen_calls(calls.join(rep, "number", "left"))
    return out.select("event_id", "risk", "action", "verdict", "is_threat", "label", F.array_join("paths", ",").alias("paths"))


_DA = """CASE WHEN (label = 1 AND src IN ('human_grade','analyst_verified')) OR (src = 'personal_block' AND act = 'block') OR (src IN ('analyst_verified','vendor_verified') AND act = 'block') THEN 'block'
 WHEN act IN ('block','label','silence') OR label = 1 THEN 'label' ELSE 'none' END"""
_DASRC = "(SELECT *, coalesce(json_extract_string(metadata,'$.label_source'),'') AS src, coalesce(json_extract_string(metadata,'$.action'),'') AS act FROM messages)"


@query("F34_directory_action", f"SELECT id, {_DA} AS action, CASE WHEN {_DA} = 'label' THEN 'Suspicious Caller' ELSE '' END AS label FROM {_DASRC}", "messages")
def _(i: Inputs):
    return i.messages.withColumn("d", ve.directory_action(F.col("metadata"), F.col("label"))).select("id", "d.action", "d.label")


@query("U2_directory", f"""
WITH m AS (SELECT {q.e164('sender')} AS number, {_DA} AS action, 'Suspicious Caller' AS label, 1 AS src_, row_number() OVER (ORDER BY ts DESC NULLS LAST, id DESC) AS ord FROM {_DASRC} WHERE account_sub='acct3' AND message_type IN ('vishing','smishing') AND is_threat=1),
n AS (SELECT e164 AS number, CASE WHEN risk >= 0.85 THEN 'block' ELSE 'label' END AS action, CASE verdict WHEN 'fraud' THEN 'Fraud' ELSE 'Spam Likely' END AS label, 2 AS src_, row_number() OVER (ORDER BY risk DESC, e164) AS ord FROM number_reputation WHERE risk >= 0.4),
p AS (SELECT concat('+1', digits) AS number, CASE WHEN campaign_id = 'tax-01' THEN 'block' ELSE 'label' END AS action, 'Parcel scam' AS label, 4 AS src_, 0 AS ord FROM packs),
a AS (SELECT * FROM m WHERE starts_with(number, '+') AND action <> 'none' UNION ALL SELECT * FROM n UNION ALL SELECT '+18665550137', 'block', '', 3, 0 UNION ALL SELECT * FROM p)
SELECT number, CASE WHEN bool_or(action = 'block') THEN 'block' ELSE 'label' END AS action, CASE WHEN bool_or(action = 'block') THEN '' ELSE arg_min(label, src_ * 1000000 + ord) FILTER (WHERE action = 'label') END AS label FROM a GROUP BY number""", "messages number_reputation packs")
def _(i: Inputs):
    seeds = i.spark.createDataFrame([("8665550137",)], "number string")
    packs = i.view("packs").select(F.col("digits").alias("number"), F.when(F.col("campaign_id") == "tax-01", "block").otherwise("label").alias("action"),
                                   F.lit("Parcel scam").alias("label"), F.lit(0).alias("ord"))
    return di.directory(i.messages, i.view("number_reputation"), seeds, packs, "acct3")


_PAY = """CASE event_type WHEN 'click' THEN concat('{"complaint_count":', event_id % 9, ',"topic":"Robo"}') WHEN 'view' THEN concat('{"category":"', CASE WHEN event_id % 2 = 0 THEN 'Fraud' ELSE 'neutral' END, '"}')
 WHEN 'error' THEN concat('{"spamScore":', event_id % 101, ',"spamReports":', event_id % 7, '}') WHEN 'signup' THEN concat('{"fraud_score":', event_id % 101, ',"VOIP":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"spammer":', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END, '}')
 ELSE concat('{"is_scam":', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, ',"is_spam":', CASE WHEN event_id % 3 = 1 THEN 'true' ELSE 'false' END, '}') END"""


@query("F36_feed_score", """
WITH r AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 9 > 0 THEN least(0.9, 0.3 + 0.05 * (event_id % 9)) ELSE 0 END WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 0.9 ELSE 0 END WHEN 'error' THEN (event_id % 101) / 100.0
 WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN greatest(0.75, (event_id % 101) / 100.0) WHEN event_id % 2 = 0 AND (event_id % 101) / 100.0 < 0.4 THEN greatest(0.35, (event_id % 101) / 100.0) ELSE (event_id % 101) / 100.0 END
 ELSE CASE event_id % 3 WHEN 0 THEN 0.92 WHEN 1 THEN 0.6 ELSE 0 END END AS risk,
 CASE event_type WHEN 'click' THEN 'robo,ftc_complaint' WHEN 'view' THEN 'fraud' WHEN 'error' THEN 'spam' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN 'spammer,voip' WHEN event_id % 5 = 0 THEN 'spammer' WHEN event_id % 2 = 0 THEN 'voip' ELSE 'phone_intel' END
 ELSE CASE WHEN event_id % 3 = 0 THEN 'scam' ELSE 'spam' END END AS categories, CASE event_type WHEN 'click' THEN event_id % 9 WHEN 'error' THEN event_id % 7 ELSE 0 END AS report_count FROM events)
SELECT event_id, round(risk, 6)::DOUBLE AS risk, categories, report_count FROM r WHERE risk > 0""")
def _(i: Inputs):
    kinds = {"click": "complaints", "view": "category", "error": "hundred", "signup": "fraud"}
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    rows = i.table("events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("scam")).alias("source"), F.expr(_PAY).alias("payload"))
    return ve.feed_score(rows).select("event_id", F.round("risk", 6).alias("risk"), F.array_join("categories", ",").alias("categories"), "report_count")


@query("F37_report_codes", """
SELECT report_id, CASE WHEN reasons = '' THEN '' WHEN reasons = 'odd one' THEN 'ODD ONE' ELSE 'UNSOLICITED,CREDENTIAL_PHISH' END AS codes,
 CASE lower(channel) WHEN 'phishing' THEN 'email' WHEN 'sms' THEN 'sms' WHEN 'vishing' THEN 'call' ELSE 'email' END AS channel_name, CASE WHEN reasons = '' AND expected IS NULL AND detail IS NULL THEN 'empty_report' END AS error FROM reports""", "reports")
def _(i: Inputs):
    r = i.view("reports").withColumn("reasons", F.split("reasons", ","))
    return ve.report_codes(r).select("report_id", F.array_join("codes", ",").alias("codes"), "channel_name", "error")
