"""Text clean-up as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Every Latin letter up to U+017F whose compatibility form is one base letter and marks."""
    plain = {}
    for code in range(0xA0, 0x180):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accent_table()


def strip_accents(col: Column) -> Column:
    """Letters without their accents."""
    return F.translate(col, ACCENTED, PLAIN)


def normalize_desc(col: Column) -> Column:
    """Trimmed, lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def clean_text(col: Column) -> Column:
    """Carriage returns as line feeds, control characters as spaces, runs of blanks and of empty lines shortened."""
    out = F.regexp_replace(col, r"\r\n|\r", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def html_to_text(col: Column) -> Column:
    """Tags stripped, the two commonest entities resolved, three or more blanks as a line break."""
    out = F.regexp_replace(col, r"<[^>]+>", " ")
    out = F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t\n\r]{3,}", "\n"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def normalize_cell(col: Column) -> Column:
    """Lower case, no accents, one space between words (G1)."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(col, F.lit("")))), r"\s+", " "))


def normalize_header(col: Column) -> Column:
    """Header text: no accents or degree signs, everything but letters and digits as one space, lower case."""
    plain = F.lower(strip_accents(F.translate(F.coalesce(col, F.lit("")), "º°ª", "")))
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def file_tokens(name: Column) -> Column:
    """Distinct words of a file name without its extension."""
    stem = F.regexp_replace(strip_accents(F.lower(F.coalesce(name, F.lit("")))), r"\.[^.]*$", "")
    return F.array_distinct(F.filter(F.split(stem, "[^a-z0-9]+"), lambda x: x != ""))


def truncate_text(col: Column, n: int = 50_000) -> tuple[Column, Column]:
    """(the first n characters, whether there were more)."""
    return F.substring(col, 1, n), F.length(col) > n


def is_poor_text(col: Column) -> Column:
    """Fewer than 25 letters and digits, or fewer than 6 words."""
    text = F.coalesce(col, F.lit(""))
    return (F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) < 25) | (F.regexp_count(text, F.lit(r"\S+")) < 6)


def prefer_second(first: Column, second: Column) -> Column:
    """The second text where it is at least 1.2 times as long."""
    longer = F.length(F.trim(second)) >= 1.2 * F.greatest(F.length(F.trim(F.coalesce(first, F.lit("")))), F.lit(1))
    return F.when(second.isNotNull() & longer, second).otherwise(first)


def file_kind(name: Column) -> Column:
    """Kind of document by extension."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^.]+)$", 1))
    # Image extensions.
    images = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
    return (
        F.when(ext == ".pdf", "pdf").when(ext.isin(".xlsx", ".xls"), "planilha").when(ext == ".csv", "csv")
        .when(ext.isin(".docx", ".doc"), "docx").when(ext == ".eml", "email").when(ext.isin(images), "imagem").otherwise("desconhecido")
    )


def is_budget_file(name: Column, scope: str = "loose") -> Column:
    """Whether a name's extension is a quotation document's: loose files, or members of archives and mails (F1)."""
    # Loose files take csv, archives and mails take images instead.
    own = r"\.(pdf|docx|doc|xlsx|xls|csv)$" if scope == "loose" else r"\.(pdf|docx|doc|xlsx|xls|png|jpg|jpeg|tif|tiff|bmp|webp)$"
    return F.lower(F.coalesce(name, F.lit(""))).rlike(own)


def content_hash(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content.cast("binary"), 256)


def stable_id(kind: str, *parts: Column) -> Column:
    """Identifier of a file: kind and parts, the last one a hash of which 12 digits count."""
    *names, digest = parts
    return F.concat_ws(":", F.lit(kind), *names, F.substring(digest, 1, 12))


def display_name(file_name: Column) -> Column:
    """Base name of a file without extension, underscores as spaces."""
    base = F.regexp_extract(F.coalesce(file_name, F.lit("")), r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), "_", " "))


def as_json(col: Column) -> Column:
    """JSON text of an array, for interchange."""
    return F.to_json(col)


def from_json_names(col: Column) -> Column:
    """Array of strings of a JSON text."""
    return F.from_json(col, "array<string>")
