"""Portable input views over the driver tables.

Each view is one SQL text that Spark and DuckDB read the same way.  The driver
prose has none of the vocabulary the jobs look for, so every document gets a
phrase, a sender and header values chosen by its id; all rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.session import cut_lineage, spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

TEXT_TABLES = {"documents", "pages", "conversations"}   # much work per row

VIEWS: dict[str, str] = {}

VIEWS["messages"] = """
SELECT d.doc_id AS id,
       concat('acct', CAST(d.doc_id % 7 AS string)) AS account_sub,
       d.doc_id % 3 + 1 AS mailbox_id,
       CASE WHEN d.doc_id % 3 = 0 THEN 'phishing' WHEN d.doc_id % 3 = 1 THEN 'smishing' ELSE 'vishing' END AS message_type,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 2 = 0 THEN 'gmail' ELSE 'yahoo' END AS provider,
       CAST(d.doc_id % 400 AS string) AS provider_uid,
       CAST(d.doc_id % 2 AS string) AS uidvalidity,
       CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE 'INBOX' END AS folder,
       s.sender AS sender,
       concat('user', CAST(d.doc_id % 5 AS string), '@corp.example') AS recipient,
       e.ts AS ts,
       concat('Re: ', d.source) AS subject,
       concat(d.text, ' ', p.phrase) AS body,
       p.auth AS auth_results,
       CASE WHEN d.doc_id % 9 = 0 THEN 'Pass (mx: client-ip=10.0.0.8)' WHEN d.doc_id % 9 = 1 THEN 'SoftFail (mx)' ELSE NULL END AS received_spf,
       CASE WHEN d.doc_id % 8 = 0 THEN 'v=1; a=rsa; d=mail.example.com; s=k1' ELSE NULL END AS dkim_signature,
       CASE WHEN d.doc_id % 6 = 0 THEN '<bounce@news.example.com>' WHEN d.doc_id % 6 = 1 THEN '<x@other.example.net>' ELSE NULL END AS return_path,
       CASE WHEN d.doc_id % 10 = 0 THEN 'Helpdesk <help@evil.example.org>' ELSE NULL END AS reply_to,
       CASE WHEN d.doc_id % 4 = 3 THEN '<mailto:u@news.example.com>' ELSE NULL END AS list_unsubscribe,
       concat('from a (10.1.2.3) by b; from mx ([93.184.', CAST(d.doc_id % 256 AS string), '.', CAST(d.doc_id % 251 AS string), ']) by c; 300.1.1.1 192.168.0.4') AS received,
       CASE WHEN d.doc_id % 15 = 4 THEN 'invoice.docm' ELSE NULL END AS attachments,
       concat('<m', CAST(d.doc_id % 150 AS string), '@mail.example>') AS rfc_message_id,
       CASE WHEN (d.doc_id * 37) % 101 >= 50 THEN 1 ELSE 0 END AS is_threat,
       CAST((d.doc_id * 37) % 101 AS double) / 100 AS confidence,
       CASE WHEN d.doc_id % 5 = 0 THEN 1 WHEN d.doc_id % 5 = 1 THEN 0 ELSE NULL END AS label,
       concat('{"action":"', CASE WHEN d.doc_id % 4 = 0 THEN 'quarantine' WHEN d.doc_id % 4 = 1 THEN 'review' WHEN d.doc_id % 12 = 2 THEN 'block' ELSE 'pass' END,
              '","label_source":"', CASE WHEN d.doc_id % 2 = 0 THEN 'human_grade' ELSE 'model_prediction' END, '"',
              CASE WHEN d.doc_id % 3 = 0 THEN ',"anomaly_level":"HIGH"' ELSE '' END,
              CASE WHEN d.doc_id % 6 = 5 THEN ',"auto_processed":"true"' ELSE '' END, '}') AS metadata
FROM documents d
LEFT JOIN events e ON e.event_id = d.doc_id
JOIN (VALUES
  (0,'Your account is suspended, verify now at http://paypa1-secure.ru/login','spf=fail dkim=fail dmarc=fail'),
  (1,'USPS: package on hold, pay the fee http://bit.ly/fee22','none'),
  (2,'This is the IRS. A warrant for your arrest. Press 1 or call 866-555-0137','none'),
  (3,'Weekly newsletter. Unsubscribe or view in browser https://news.example.com/a','spf=pass dkim=pass header.d=example.com dmarc=pass'),
  (4,'Please buy a gift card, quick favor, keep this confidential','spf=pass dkim=none dmarc=fail'),
  (5,'Your verification code is 558213','none'),
  (6,'Reply with the 6-digit code we sent you','none'),
  (7,'Claim your prize: http://192.168.1.9:8081/claim?u=a@b','none'),
  (8,'See you at lunch on Friday','none'),
  (9,'Reset at https://login.secure.paypal.verify.example.net/account/update','spf=softfail dmarc=none'),
  (10,'Call me at (408) 555-0112 about the job, you applied, send your resume','spf=pass dkim=pass dmarc=pass'),
  (11,'Sign in at https://www.paypal.org/signin?x=1 or http://amaz0n.com/update','none')
) AS p(k, phrase, auth) ON p.k = d.doc_id % 12
JOIN (VALUES
  (0,'PayPal <service@paypa1.com>'),(1,'+18885550101'),(2,'IRS'),(3,'News <n@news.example.com>'),
  (4,'boss@gmail.com'),(5,'28849'),(6,'(800) 555-1001'),(7,'alerts@github.com'),(8,'x@mailinator.com'),
  (9,'+447700900103'),(10,'hr@talentemail.com'),(11,'a@arnazon.com'),(12,'8005551001')
) AS s(k, sender) ON s.k = d.doc_id % 13
"""

# One report per event: many reporters per sender key.
VIEWS["reports"] = """
SELECT e.event_id AS report_id, e.event_id AS message_id,
       concat('acct', CAST(e.user_id % 7 AS string)) AS account_sub,
       CASE e.event_type WHEN 'click' THEN 'phishing' WHEN 'view' THEN 'SMS' WHEN 'error' THEN 'vishing' ELSE 'fax' END AS channel,
       concat('s', CAST(e.user_id % 10 AS string), '@bulk', CAST(e.event_id % 9 AS string), '.example') AS sender,
       concat('bulk', CAST(e.event_id % 9 AS string), '.example') AS sender_key,
       CASE e.event_type WHEN 'click' THEN false WHEN 'view' THEN true WHEN 'error' THEN false ELSE NULL END AS expected,
       CASE e.event_type WHEN 'click' THEN 'unsolicited, Credential' WHEN 'error' THEN 'odd one' ELSE '' END AS reasons,
       CASE WHEN e.event_type = 'signup' THEN 'free text' ELSE NULL END AS detail,
       false AS promoted_to_fleet,
       e.ts AS created_at
FROM events e
"""

# Grades given by people: the graded events are clicks, views and sign-ups.
VIEWS["grades"] = """
SELECT e.event_id AS message_id, concat('acct', CAST(e.event_id % 7 AS string)) AS account_sub,
       CASE e.event_type WHEN 'click' THEN 'block' WHEN 'view' THEN 'safe' ELSE 'unsure' END AS verdict,
       e.ts AS graded_at
FROM events e WHERE e.event_type IN ('click', 'view', 'signup')
"""

VIEWS["fleet"] = """
SELECT * FROM (VALUES ('paypa1.com', 0.75D0), ('talentemail.com', 0.6D0), ('irs', 0.9D0), ('8005551001', 0.75D0))
AS f(sender_key, confidence)
"""

VIEWS["packs"] = """
SELECT * FROM (VALUES ('8665550137', 'tax-01'), ('8005551001', 'tax-01'), ('8885550101', 'parcel-07'))
AS p(digits, campaign_id)
"""

VIEWS["safe_rules"] = """
SELECT * FROM (VALUES ('acct0', 'exact', 'alerts@github.com'), ('acct0', 'domain', 'paypa1.com'),
  ('acct1', 'pattern', '%@github.com'), ('acct2', 'domain', 'news.example.com'), ('acct3', 'pattern', '%gmail%'),
  ('acct3', 'exact', 'boss@gmail.com'), ('acct4', 'pattern', '+1888%'), ('acct5', 'domain', 'mailinator.com'))
AS r(account_sub, match_type, pattern)
"""

VIEWS["ip_ranges"] = """
SELECT * FROM (VALUES (1572339712, 1572356095, 'RU', 'Some ISP'), (1572356096, 1572372479, 'FR', 'VPN Net'),
  (1572372480, 1572405247, 'FR', 'Home ISP'), (134744064, 134744319, 'US', 'Public DNS'))
AS g(lo, hi, country_code, isp)
"""

# Several sources reporting on the same numbers.
VIEWS["number_feed"] = """
SELECT concat('+1888555', lpad(CAST(e.user_id AS string), 4, '0')) AS number, e.event_type AS source,
       CAST((e.event_id * 53) % 101 AS double) / 100 AS risk,
       CASE e.event_type WHEN 'click' THEN 'robocall' WHEN 'error' THEN 'irs_scam' WHEN 'view' THEN 'spam' ELSE '' END AS category,
       e.event_id % 5 AS report_count
FROM events e
"""

VIEWS["number_reputation"] = """
SELECT concat('+1888', lpad(CAST(c_custkey AS string), 7, '0')) AS e164,
       CAST((c_custkey * 37) % 101 AS double) / 100 AS risk,
       CASE WHEN c_custkey % 2 = 0 THEN 'spam_likely' ELSE 'fraud' END AS verdict,
       'feed' AS source
FROM customer
"""

VIEWS["predictions"] = """
SELECT l.doc_id AS id, CASE WHEN l.doc_id % 3 = 0 THEN 'phishing' WHEN l.doc_id % 3 = 1 THEN 'smishing' ELSE 'vishing' END AS channel,
       l.toxic AS label,
       CASE WHEN l.doc_id % 17 = 0 THEN NULL WHEN l.quality = 0 OR l.doc_id % 4 = 0 THEN 1 ELSE 0 END AS pred,
       CAST((l.doc_id * 29) % 97 AS double) / 96 AS score,
       CASE WHEN l.doc_id % 6 = 0 THEN '' WHEN l.doc_id % 6 = 1 THEN 'pump_fake' WHEN l.doc_id % 6 = 2 THEN 'bec,auth' ELSE 'brand' END AS tags
FROM labels l
"""

VIEWS["queue"] = """
SELECT e.event_id AS id, e.event_id AS message_id, concat('acct', CAST(e.user_id % 7 AS string)) AS account_sub,
       e.event_id % 3 + 1 AS mailbox_id, 'gmail' AS provider, 'junk' AS action,
       CASE e.event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'ok' END AS status,
       e.event_id % 6 AS attempts, e.ts AS next_attempt_at, e.ts AS lease_until, e.ts AS created_at
FROM events e
"""

VIEWS["trial_fp"] = """
SELECT concat('fp-', lpad(CAST(e.user_id AS string), 6, '0')) AS fingerprint, CAST(count(*) AS bigint) AS attempts,
       CAST(max(e.event_id % 60) AS bigint) AS risk_score, concat('10.0.0.', CAST(max(e.user_id) % 250 AS string)) AS last_ip
FROM events e WHERE e.event_type = 'signup' GROUP BY e.user_id
"""

VIEWS["signups"] = """
SELECT c_custkey AS signup_id,
       CASE WHEN c_custkey % 9 = 0 THEN 'short' WHEN c_custkey % 9 = 1 THEN NULL ELSE concat('fp-', lpad(CAST(c_custkey AS string), 6, '0')) END AS fingerprint,
       CASE WHEN c_custkey % 4 = 0 THEN 'curl/8.0' ELSE 'Mozilla/5.0' END AS user_agent,
       CASE WHEN c_custkey % 5 = 0 THEN '127.0.0.1' ELSE concat('93.184.0.', CAST(c_custkey % 200 AS string)) END AS ip,
       CASE WHEN c_custkey % 8 = 7 THEN false ELSE true END AS want_trial
FROM customer
"""

VIEWS["profiles"] = """
SELECT c_name AS email, CAST((c_custkey * 41) % 101 AS double) / 100 AS threat_score FROM customer
"""

# Two versions of a small classifier: word terms with their idf and weight, and the numbers around them.
VIEWS["model_terms"] = """
SELECT * FROM (VALUES (1, 'w', 'account', 1.5D0, 1.0D0), (1, 'w', 'lunch', 2.0D0, -1.0D0), (1, 'x', 'intercept', 0.0D0, 0.0D0), (1, 'x', 'platt_a', 0.0D0, 1.0D0), (1, 'x', 'platt_b', 0.0D0, 0.0D0),
  (2, 'w', 'account', 1.4D0, 1.3D0), (2, 'w', 'verify', 1.9D0, 1.6D0), (2, 'w', 'package on hold', 2.2D0, 2.4D0), (2, 'w', 'claim your', 2.1D0, 1.9D0), (2, 'w', 'press', 1.7D0, 0.8D0),
  (2, 'w', 'the', 0.4D0, -0.2D0), (2, 'w', 'and', 0.4D0, 0.3D0), (2, 'w', 'de', 0.5D0, -0.6D0), (2, 'w', 'lunch on friday', 2.6D0, -2.2D0), (2, 'w', 'newsletter', 1.8D0, -1.5D0),
  (2, 'w', 'code', 1.3D0, 0.5D0), (2, 'w', 'update', 1.6D0, 0.7D0), (2, 'w', 'paypal', 1.2D0, 1.1D0), (2, 'w', 'github', 1.1D0, -1.4D0),
  (2, 'x', 'intercept', 0.0D0, -0.15D0), (2, 'x', 'platt_a', 0.0D0, 1.8D0), (2, 'x', 'platt_b', 0.0D0, 0.1D0))
AS t(version, kind, term, idf, weight)
"""

_cache: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; ``events.ts`` becomes an instant so windows and watermarks accept it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cache:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        _cache[key] = spread(df) if name in TEXT_TABLES else df
    return _cache[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A portable view as a lazy DataFrame."""
    sql = VIEWS[name].replace("D0)", "D)").replace("D0,", "D,")
    for t in TABLES:
        if f" {t}" in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


FEW_KEYS = 1 << 20    # so many keys are sent to every task


def timeless_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` without ``ts``, row for row, but no text meets ``events``: only the number of events of a message does."""
    event = "LEFT JOIN events e ON e.event_id = d.doc_id"
    assert event in VIEWS["messages"] and VIEWS["messages"].count("e.ts AS ts,") == 1
    sql = VIEWS["messages"].replace(event, "").replace("e.ts AS ts,", "")
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    messages = spark.sql(sql)
    several = cut_lineage(table(spark, sf_dir, "events").groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and id is not null"))
    keys = several.count()
    if not keys:
        return messages
    counted = messages.join(F.broadcast(several) if keys <= FEW_KEYS else several, "id", "left")
    return counted.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("_n", F.lit(1)).cast("int")))).select(*messages.columns)


def oracle(body: str, *views: str) -> str:
    """DuckDB text: the portable views as CTEs around ``body``."""
    if not views:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip().replace('D0)', ')').replace('D0,', ',')})" for v in views)
    return f"WITH {ctes}\nSELECT * FROM (\n{body}\n) AS result"
