"""Mail files to messages and attachments."""

from __future__ import annotations

import email
import hashlib
from email import policy
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemap.functions.classify import process_number
from pricemap.functions.text import html_to_text

PERSON = "struct<name:string,email:string>"
MESSAGE_SCHEMA = (
    f"source_file string, message_id string, subject string, from_name string, from_email string, recipients array<{PERSON}>, sent_at timestamp, sent_raw string, "
    "body_text string, body_html string, is_mdn boolean, attachments array<struct<pos:int,name:string,mime:string,sha256:string,content:binary>>"
)


def _parse(name: str, content: bytes) -> tuple:
    msg = email.message_from_bytes(content, policy=policy.default)
    people = lambda *names: [{"name": n, "email": a.strip().lower()} for n, a in getaddresses([str(v) for h in names for v in msg.get_all(h, [])]) if "@" in a]
    sender = (people("From") or [{"name": "", "email": ""}])[0]
    raw_date = str(msg.get("Date", "") or "")
    try:
        sent = pd.Timestamp(parsedate_to_datetime(raw_date))
        sent = sent.tz_convert("UTC").tz_localize(None) if sent.tzinfo else sent
    except (TypeError, ValueError):
        sent = None
    plain, html, attached = [], [], []
    for part in msg.walk():
        if part.is_multipart():
            continue
        kind, file_name = part.get_content_type(), part.get_filename()
        data = part.get_payload(decode=True) or b""
        if file_name:
            attached.append({"pos": len(attached), "name": file_name, "mime": kind, "sha256": hashlib.sha256(data).hexdigest(), "content": data})
        elif kind in ("text/plain", "text/html"):
            (plain if kind == "text/plain" else html).append(data.decode(part.get_content_charset() or "utf-8", "replace"))
    receipt = msg.get_content_type() == "multipart/report" or any(p.get_content_type() == "message/disposition-notification" for p in msg.walk())
    own_id = str(msg.get("Message-ID", "") or "").strip() or hashlib.md5(content[:512]).hexdigest()
    return (name, own_id, str(msg.get("Subject", "") or ""), sender["name"], sender["email"], people("To", "Cc", "Bcc"), sent, raw_date, "\n".join(plain), "\n".join(html), receipt, attached)


def parse_messages(files: DataFrame) -> DataFrame:
    """Messages of mail files (name, content): headers, recipients, text body (HTML stripped where there is none), attachments."""

    def parse(batches):
        for pdf in batches:
            yield pd.DataFrame([_parse(n, bytes(c)) for n, c in zip(pdf["name"], pdf["content"])], columns=[c.split()[0] for c in ("source_file", "message_id", "subject", "from_name", "from_email", "recipients", "sent_at", "sent_raw", "body_text", "body_html", "is_mdn", "attachments")])

    parsed = files.select("name", "content").mapInPandas(parse, MESSAGE_SCHEMA)
    body = F.when(F.trim("body_text") != "", F.col("body_text")).otherwise(html_to_text(F.col("body_html")))
    return parsed.withColumn("body", body).drop("body_text", "body_html").withColumn("has_attachment", F.size("attachments") > 0)


def message_attachments(messages: DataFrame) -> DataFrame:
    """One row per attachment; its content is a column of its own, so lists don't read it."""
    return messages.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.*")


def assign_process(messages: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Process of every message of a batch: the number in the first one's subject, else one named after the batch."""
    first = messages.groupBy(batch).agg(F.min_by(F.coalesce(process_number(F.col("subject")), F.lit("")), "ingest_seq").alias("__n"))
    named = F.when(F.col("__n") != "", F.col("__n")).otherwise(F.concat(F.lit("SEM_NUMERO_"), F.col(batch).cast("string")))
    return messages.join(first, batch).withColumn("process_number", named).drop("__n")
