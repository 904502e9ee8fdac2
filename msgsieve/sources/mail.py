"""Raw RFC-822 mail to message records."""

from __future__ import annotations

import email
import email.header

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.functions.text import strip_html

PARSED = ("path string, sender string, recipient string, subject string, date_raw string, message_id string, plain string, html string, "
          "return_path string, auth_results string, received_spf string, dkim_signature string, reply_to string, received array<string>")
HEADERS = {"return_path": "Return-Path", "auth_results": "Authentication-Results", "received_spf": "Received-SPF",
           "dkim_signature": "DKIM-Signature", "reply_to": "Reply-To", "message_id": "Message-ID", "date_raw": "Date"}


def _decoded(value) -> str:
    if value is None:
        return ""
    try:
        return str(email.header.make_header(email.header.decode_header(str(value))))
    except (LookupError, ValueError):
        return str(value)


def _text(part) -> str:
    raw = part.get_payload(decode=True) or b""
    return raw.decode("utf-8", errors="ignore")


def _parse(path: str, raw: bytes) -> dict:
    msg = email.message_from_bytes(raw)
    texts: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in msg.walk():
        kind = part.get_content_type()
        attached = "attachment" in str(part.get("Content-Disposition") or "").lower()
        if not part.is_multipart() and not attached and kind in texts:
            texts[kind].append(_text(part))
    row = {"path": path, "sender": _decoded(msg["From"]), "recipient": _decoded(msg["To"]), "subject": _decoded(msg["Subject"]),
           "plain": "\n".join(texts["text/plain"]).strip(), "html": "\n".join(texts["text/html"]), "received": [str(v) for v in msg.get_all("Received", [])]}
    for field, header in HEADERS.items():
        row[field] = None if msg[header] is None else str(msg[header])
    return row


def parse_mail(raw: DataFrame) -> DataFrame:
    """Records from (path, content); plain text first, else the stripped HTML.

    Only MIME decoding runs in Python; HTML stripping stays in the JVM.
    """
    columns = [f.strip().split(" ")[0] for f in PARSED.split(", ")]

    def decode(batches):
        for pdf in batches:
            yield pd.DataFrame([_parse(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])], columns=columns)

    parsed = raw.select("path", "content").mapInPandas(decode, PARSED)
    body = F.when(F.col("plain") != "", F.col("plain")).otherwise(strip_html(F.col("html")))
    return parsed.withColumn("body", body).drop("plain", "html")


def ingest_eml_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_mail(spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", "content"))
