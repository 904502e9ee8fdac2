"""Explicit schemas as DDL text; jobs never infer them."""

MESSAGE = ("id bigint, account_sub string, mailbox_id bigint, message_type string, provider string, provider_uid string, "
             "uidvalidity string, folder string, sender string, recipient string, ts timestamp, subject string, body string, "
             "embedding array<float>, is_threat int, confidence double, metadata string, label int, created_at timestamp")
RECORD = ("subject string, body string, snippet string, message string, text string, transcript string, `from` string, "
            "sender string, caller_id string, label string")
FEEDBACK = ("ts double, label string, source string, email struct<subject:string,body:string,`from`:string,sender:string>, _corrupt_record string")
GOLDEN = ("label int, tags array<string>, subject string, body string, `from` string, "
            "headers struct<authentication_results:string,return_path:string>, _corrupt_record string")
INGEST = ("id string, subject string, body string, snippet string, `from` string, sender string, account_sub string, "
            "mailbox_id bigint, headers map<string,string>, _corrupt_record string")
PACK = ("campaign_id string, label_text string, notes string, block array<string>, label array<variant>")
THREAT = ("type string, identifier string, metadata string")
AUDIT = ("guard_name string, event_type string, user_id string, severity string, details string")
ACTION = ("seq bigint, ts timestamp, action string, sender string, reason string")
CHALLENGE_ROW = "array<struct<id:string,group_id:string,taxonomy:string,expected_action:string,scenario:string,transcript:string,label:string>>"
CHALLENGE = (f"purpose string, training_eligible boolean, release_evidence boolean, rows {CHALLENGE_ROW}")
URL_CACHE = ("url_key string, url string, domain string, risk_score int, threat_level string, flags array<string>, cached_at timestamp")
DEAD_LETTER = ("kind string, id bigint, account_sub string, payload string, error string, retries int, failed_at timestamp")
