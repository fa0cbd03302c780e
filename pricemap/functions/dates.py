"""Dates in mail text, and elapsed times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemap.functions.text import strip_accents

# Month names.
MONTHS = ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
# Where replies quote the date of the message they answer.
HISTORY = [
    r"(?im)^\s*Em\s+(.{6,120}?),\s*.+escreveu\s*:\s*$",
    r"(?im)^\s*On\s+(.{6,140}?)\s+wrote\s*:\s*$",
    r"(?im)^\s*(?:Date|Data|Sent|Enviado\s+em)\s*:\s*(.+)\s*$",
]


def parse_date(col: Column) -> Column:
    """Timestamp of a mail date, a d/m/y date or a Portuguese one; null otherwise."""
    text = F.trim(col)
    # the weekday can't be parsed and says nothing
    mail = F.regexp_extract(text, r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[+-]\d{4})?)", 1)
    mail = F.trim(F.regexp_replace(mail, r"\s+", " "))
    formats = ["d MMM yyyy H:mm:ss Z", "d MMM yyyy H:mm Z", "d MMM yyyy H:mm:ss", "d MMM yyyy H:mm"]
    found = [F.try_to_timestamp(mail, F.lit(f)) for f in formats]
    numeric = r"(?i)(\d{1,2}/\d{1,2}/\d{2,4})(?:\s*(?:,|-|as|às)?\s*)(\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp][Mm])?)?"
    day, hour = F.regexp_extract(text, numeric, 1), F.upper(F.regexp_replace(F.regexp_extract(text, numeric, 2), r"\s+", ""))
    blob = F.concat(day, F.lit(" "), F.when(hour == "", "00:00").otherwise(hour))
    clocks = ["H:mm:ss", "H:mm", "h:mma", "h:mm:ssa"]
    for year, digits in (("yyyy", 4), ("yy", 2)):
        fits = F.length(F.regexp_extract(day, r"/(\d+)$", 1)) == digits
        found += [F.when(fits, F.try_to_timestamp(blob, F.lit(f"d/M/{year} {c}"))) for c in clocks]
    plain = strip_accents(F.lower(text))
    long = r"(\d{1,2})\s+de\s+([a-z]+)\s+de\s+(\d{4})(?:\s*(?:,|-|as)?\s*(\d{1,2}:\d{2}(?::\d{2})?))?"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(plain, long, 2)).cast("string")
    clock = F.regexp_extract(plain, long, 4)
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) <= 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    spelled = F.concat_ws(" ", F.concat_ws("/", F.regexp_extract(plain, long, 1), month, F.regexp_extract(plain, long, 3)), clock)
    found.append(F.try_to_timestamp(spelled, F.lit("d/M/yyyy H:mm:ss")))
    return F.coalesce(*found)


def history_dates(body: Column) -> Column:
    """Texts of the dates that a body quotes, in the order of the three patterns."""
    return F.concat(*[F.transform(F.coalesce(F.regexp_extract_all(body, F.lit(p), F.lit(1)), F.array().cast("array<string>")), lambda x: F.trim(x)) for p in HISTORY])


def request_date(dates: Column, replied_at: Column) -> Column:
    """The latest of ``dates`` up to the reply, else the latest of all."""
    known = F.filter(dates, lambda d: d.isNotNull())
    return F.coalesce(F.array_max(F.filter(known, lambda d: d <= replied_at)), F.array_max(known))


def _micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def elapsed_hours(start: Column, end: Column) -> Column:
    return (_micros(end) - _micros(start)) / 3.6e9


def elapsed_text(start: Column, end: Column) -> Column:
    """"Xd Yh" from a day on, else "Xh Ymin"; null for negative and missing spans."""
    minutes = F.floor((_micros(end) - _micros(start)) / 6e7)
    days, hours = F.floor(minutes / 1440), F.floor(minutes / 60)
    long = F.concat(days.cast("string"), F.lit("d "), (hours % 24).cast("string"), F.lit("h"))
    short = F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("min"))
    return F.when(minutes >= 1440, long).when(minutes >= 0, short)


def date_text(col: Column) -> Column:
    """dd/mm/yyyy hh:mm."""
    return F.date_format(col, "dd/MM/yyyy HH:mm")
