"""Tax ids, phones, company names and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemap.functions.text import strip_accents

# Area codes in use.
AREA_CODES = [
    "11", "12", "13", "14", "15", "16", "17", "18", "19", "21", "22", "24", "27", "28", "31", "32", "33", "34", "35", "37", "38",
    "41", "42", "43", "44", "45", "46", "47", "48", "49", "51", "53", "54", "55", "61", "62", "63", "64", "65", "66", "67", "68", "69",
    "71", "73", "74", "75", "77", "79", "81", "82", "83", "84", "85", "86", "87", "88", "89", "91", "92", "93", "94", "95", "96", "97", "98", "99",
]
# Mail providers that name no company, and labels that end a domain.
GENERIC_DOMAINS = [
    "gmail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "yahoo.com", "yahoo.com.br", "icloud.com", "me.com", "aol.com",
    "bol.com.br", "uol.com.br", "terra.com.br", "globo.com", "ig.com.br", "proton.me", "protonmail.com",
]
DOMAIN_SUFFIXES = ["com", "net", "org", "gov", "edu", "mil", "co", "ac", "nom", "br", "uk", "ar", "cl", "uy", "py", "mx", "es", "pt", "us"]
# Words of company names that say nothing about which company it is.
COMPANY_STOP_WORDS = ["ltda", "eireli", "me", "epp", "sa", "s", "a", "comercio", "servicos", "de", "da", "do", "das", "dos", "empresa", "sociedade", "limitada"]
# Marks of a legal name, and the patterns of tax ids and phones.
COMPANY_MARKS = ["LTDA", "S/A", "S.A.", "EIRELI", "ME", "EPP", "SOCIEDADE", "EMPRESA"]
TAX_ID = r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}"
TAX_ID_STRICT = r"(?:\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\b\d{14}\b)"
PHONE = r"(?:\+?55\s*)?(?:\(?\d{2}\)?\s*)?\d{4,5}[\s.-]?\d{4}"
WEIGHTS = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


def bound(col: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def digits(col: Column) -> Column:
    return F.regexp_replace(col, r"\D", "")


def _check_digit(d: Column, weights: list[int]) -> Column:
    total = sum((F.substring(d, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def tax_id_valid(col: Column) -> Column:
    """Whether the 14 digits of a tax id carry the right check digits; false for other lengths and one repeated digit."""

    def right(d: Column) -> Column:
        checks = (F.substring(d, 13, 1).cast("int") == _check_digit(d, WEIGHTS)) & (F.substring(d, 14, 1).cast("int") == _check_digit(d, [6, *WEIGHTS]))
        return F.when(d.rlike(r"^\d{14}$") & ~d.rlike(r"^(\d)\1{13}$"), checks).otherwise(False)

    return bound(digits(F.coalesce(col, F.lit(""))), right)


def format_tax_id(d: Column) -> Column:
    """dd.ddd.ddd/dddd-dd of 14 digits."""
    part = lambda a, n: F.substring(d, a, n)
    return F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/"), part(9, 4), F.lit("-"), part(13, 2))


def first_tax_id(text: Column) -> Column:
    """The first tax id in a text, formatted; its check digits are not looked at."""
    return bound(digits(F.regexp_extract(text, f"({TAX_ID})", 1)), lambda d: F.when(F.length(d) == 14, format_tax_id(d)))


def strong_tax_id(text: Column) -> Column:
    """A labelled valid tax id, else the first written one if valid, else any 14 digits of the text that validate."""
    labelled = digits(F.regexp_extract(text, r"(?i)\bcnpj\b[^\d]{0,12}([\d./-]{10,30})", 1))
    labelled = bound(labelled, lambda d: F.when(F.length(d) >= 14, F.substring(d, -14, 14)))
    written = digits(F.regexp_extract(text, f"({TAX_ID_STRICT})", 1))
    windows = bound(digits(text), lambda every: F.transform(F.sequence(F.lit(1), F.greatest(F.length(every) - 13, F.lit(1))), lambda i: F.substr(every, i, F.lit(14))))
    best = F.get(F.filter(F.concat(F.array(labelled, written), windows), tax_id_valid), F.lit(0))
    return bound(best, lambda d: F.when(d.isNotNull(), format_tax_id(d)))


def _local(d: Column) -> Column:
    return F.when(d.startswith("55") & F.length(d).isin(12, 13), F.substr(d, F.lit(3))).otherwise(d)


def format_phone(d: Column) -> Column:
    """(dd) ddddd-dddd or (dd) dddd-dddd of 11 or 10 digits."""
    head = F.length(d) - 6
    return F.concat(F.lit("("), F.substring(d, 1, 2), F.lit(") "), F.substr(d, F.lit(3), head), F.lit("-"), F.substring(d, -4, 4))


def phone_valid(col: Column) -> Column:
    """10 or 11 digits, without the country's, that start with an area code in use."""
    right = lambda d: F.length(d).isin(10, 11) & F.substring(d, 1, 2).isin(AREA_CODES)
    return bound(bound(digits(F.coalesce(col, F.lit(""))), _local), right)


def first_phone(text: Column) -> Column:
    """The first phone of 10 or 11 digits in a text, formatted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE})"), F.lit(1)), lambda m: digits(m))
    found = F.transform(found, lambda d: F.when((F.length(d) == 13) & d.startswith("55"), F.substr(d, F.lit(3))).otherwise(d))
    return F.get(F.transform(F.filter(found, lambda d: F.length(d).isin(10, 11)), format_phone), F.lit(0))


def strong_phone(text: Column) -> Column:
    """A labelled phone with an area code in use, else the best window of a run of digits (near a phone word first), else the first phone."""
    labelled = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:telefone|fone|tel|contato)[^\d]{0,12}([\d()\s+\-.]{6,30}\d)"), F.lit(1)), lambda m: bound(digits(m), _local))
    first = F.get(F.filter(labelled, phone_valid), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(r"(\d{6,})"), F.lit(1))

    def windows(run: Column) -> Column:
        own = [F.transform(F.filter(F.sequence(F.lit(1), F.length(run)), lambda i, n=n: i + (n - 1) <= F.length(run)), lambda i, n=n: F.substr(run, i, F.lit(n))) for n in (11, 10)]
        return F.concat(*own)

    every = F.filter(F.flatten(F.transform(runs, windows)), phone_valid)

    def near(w: Column) -> Column:
        at = F.instr(text, w)
        around = F.lower(F.substr(text, F.greatest(at - 40, F.lit(1)), F.lit(91)))
        return around.rlike("telefone|fone|contato|cel|whatsapp|tel")

    # windows next to a phone word come first; within a class the first found
    best = bound(every, lambda own: F.coalesce(F.get(F.filter(own, near), F.lit(0)), F.get(own, F.lit(0))))
    shown = lambda d: F.when(d.isNotNull(), format_phone(d))
    return F.coalesce(bound(first, shown), bound(bound(best, _local), shown), first_phone(text))


def legal_name(text: Column) -> Column:
    """A line within four of the first with a tax id that holds a mark of a legal name, at most 180 characters."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(TAX_ID)), True).cast("int")
    near = F.slice(lines, F.greatest(at - 4, F.lit(1)), F.least(at, F.lit(5)) + 4)
    marks = "|".join(x.replace(".", r"\.") for x in COMPANY_MARKS)
    found = F.get(F.filter(near, lambda x: F.upper(strip_accents(x)).rlike(marks)), F.lit(0))
    return F.when(at > 0, F.substring(found, 1, 180))


def humanize(token: Column) -> Column:
    """Words of a token, each capitalised."""
    return F.initcap(F.lower(F.trim(F.regexp_replace(token, r"[_\-\s]+", " "))))


def company_from_email(email: Column) -> Column:
    """Company that a mail domain names; null for providers and names without a letter."""
    domain = F.lower(F.trim(F.regexp_extract(email, r"@(.+)$", 1)))
    parts = F.filter(F.split(domain, r"\."), lambda x: x != "")
    last, second = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    label = F.when((F.size(parts) >= 3) & last.isin(DOMAIN_SUFFIXES) & second.isin(DOMAIN_SUFFIXES), F.try_element_at(parts, F.lit(-3))).otherwise(F.coalesce(second, last))
    named = (domain != "") & ~domain.isin(GENERIC_DOMAINS) & label.rlike("[A-Za-z]")
    return F.when(named, humanize(label))


def preferred_name(email: Column, name: Column) -> Column:
    """Company of the domain, else the given name, else the address' local part."""
    given = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(company_from_email(email), F.when(given != "", given), humanize(F.regexp_extract(email, r"^([^@]*)", 1)))


def normalize_name(col: Column) -> Column:
    """Company name in plain lower-case words."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(col, F.lit("")))), r"[^a-z0-9]+", " "))


def name_tokens(col: Column) -> Column:
    """Distinct words of three letters or more that tell companies apart."""
    return F.array_distinct(F.filter(F.split(normalize_name(col), " "), lambda x: (F.length(x) >= 3) & ~x.isin(COMPANY_STOP_WORDS)))
