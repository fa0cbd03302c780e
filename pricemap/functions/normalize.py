"""Units, codes, money and quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemap.functions.contacts import bound
from pricemap.functions.text import clean_text, strip_accents

# Canonical units and their other spellings (accents are stripped before they are looked up).
UNIT_SYNONYMS = {
    "UN": ["UN", "UND", "UNID", "UNIDADE", "UNIDADES", "PC", "PCA", "PECA"],
    "CX": ["CX", "CAIXA", "CAIXAS"],
    "KG": ["KG", "QUILO", "QUILOGRAMA", "QUILOGRAMAS"],
    "L": ["L", "LT", "LITRO", "LITROS"],
    "M": ["M", "MT", "METRO", "METROS"],
    "KIT": ["KIT", "KITS", "CJ", "CONJUNTO", "CONJUNTOS"],
    "EMB": ["EMB", "EMBALAGEM", "EMBALAGENS"],
    "FR": ["FR", "FRASCO", "FRASCOS", "FD"],
    "RL": ["RL", "ROLO", "ROLOS"],
    "G": ["G", "GR", "GRAMA", "GRAMAS"],
    "ML": ["ML", "MILILITRO", "MILILITROS"],
    "PAR": ["PAR", "PARES"],
}
# Codes that stand for none.
PLACEHOLDERS = ["0", "NA", "NULL", "NONE", "X", "XX"]
# Unit names that a line of text may hold beside its quantity.
UNIT_TOKENS = ["UN", "UND", "UNID", "UNIDADE", "PCT", "PC", "PÇ", "EMB", "KG", "G", "MG", "L", "LT", "ML", "CX", "FR", "FD", "RL", "M", "M2", "M3", "PAR", "CJ"]


def normalize_unit(col: Column) -> Column:
    """Canonical unit of supply; null for blanks, money, digits and long unknown words."""
    text = F.trim(F.regexp_replace(F.upper(strip_accents(col)), r"\s+", " "))
    pairs = [x for unit, names in UNIT_SYNONYMS.items() for name in names for x in (F.lit(name), F.lit(unit))]
    known = F.create_map(*pairs)[text]
    return F.when((text == "") | text.contains("R$") | text.rlike(r"\d"), None).otherwise(
        F.coalesce(known, F.when((F.length(text) <= 8) & text.rlike(r"^[A-Z]+$"), text))
    )


def normalize_code(col: Column) -> Column:
    """Material code without separators, upper case; null for placeholders and fewer than 4 characters."""
    code = F.upper(F.regexp_replace(F.trim(col), r"[\s\-./\\]", ""))
    return F.when((F.length(code) >= 4) & ~code.isin(PLACEHOLDERS), code)


def parse_brl(col: Column) -> Column:
    """Brazilian money text as a number: dots group, a comma is decimal, a lone dot before other than three digits is decimal.

    The grammar covers the whole amount, so a missing thousands dot or a sign loses nothing.
    """
    text = F.regexp_replace(F.upper(col.cast("string")), r"R\$|\s", "")
    amount = F.regexp_extract(text, r"(-?\d[\d.]*(?:,\d+)?)", 1)
    comma = F.replace(F.replace(amount, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    grouped = amount.rlike(r"^-?\d{1,3}(\.\d{3})+$")
    plain = amount.rlike(r"^-?\d+(\.\d+)?$")
    number = F.when(amount.contains(","), comma).when(grouped, F.replace(amount, F.lit("."), F.lit(""))).when(plain, amount)
    return number.try_cast("double")


def parse_number(col: Column) -> Column:
    """Loose number: with both separators dots group, a lone one of either kind is decimal."""

    def number(text: Column) -> Column:
        both = text.contains(",") & text.contains(".")
        return F.when(both, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("."))).try_cast("double")

    return bound(F.regexp_replace(F.trim(col.cast("string")), r"[^\d,.\-]", ""), number)


def quantity_diverges(a: Column, b: Column, factor: float = 2.0) -> Column:
    """Whether the larger quantity is over ``factor`` times the smaller; false where one is missing or not positive."""
    low = F.least(a, b)
    return F.coalesce(a.isNotNull() & b.isNotNull() & (low > 0) & (F.greatest(a, b) / low > factor), F.lit(False))


def derived_unit_price(unit_price: Column, total_price: Column, quantity: Column) -> Column:
    """Unit price, or total by quantity where it is missing or was given the total."""
    by_total = F.when(quantity.isNotNull() & (quantity != 0), total_price / quantity)
    return F.when(unit_price.isNull(), by_total).when(F.abs(unit_price - total_price) < 1e-6, F.coalesce(by_total, unit_price)).otherwise(unit_price)


def normalize_items(items: DataFrame) -> DataFrame:
    """Item rows with cleaned text, canonical unit, numbers and defaults; blank numbers and codes as null."""

    def blank_null(name: str) -> Column:
        own = F.trim(F.col(name).cast("string"))
        return F.when(own != "", own)

    return items.withColumns(
        {
            "description": clean_text(F.coalesce(F.col("description"), F.lit(""))),
            "unit": normalize_unit(F.col("unit")),
            "quantity": parse_brl(F.col("quantity")),
            "unit_price": parse_brl(F.col("unit_price")),
            "total_price": parse_brl(F.col("total_price")),
            "item_no": blank_null("item_no"),
            "material_code": blank_null("material_code"),
            "location": F.coalesce(blank_null("location"), F.lit("desconhecida")),
            "extraction_source": F.coalesce(blank_null("extraction_source"), F.lit("ia")),
        }
    )


def unit_and_quantity(segment: Column) -> tuple[Column, Column]:
    """Unit and quantity of a line: neighbours between bars first, then a unit and a number side by side."""
    found = _measured(segment)
    return found["unit"], found["quantity"]


def _measured(segment: Column) -> Column:
    """(unit, quantity) of a line; each step is bound, or what uses it twice would compute it twice at every level."""
    names = F.array(*[F.lit(x) for x in UNIT_TOKENS])
    pair = lambda unit, quantity: F.struct(unit.alias("unit"), quantity.alias("quantity"))

    def beside(parts: Column) -> Column:
        upper = F.transform(parts, lambda x: F.upper(F.regexp_replace(x, r"\s+", " ")))
        fits = F.filter(F.transform(upper, lambda x, i: F.struct(x.alias("unit"), i.alias("i"))), lambda p: F.array_contains(names, p["unit"]))

        def first(fits: Column, step: int) -> Column:
            own = F.transform(fits, lambda p: pair(p["unit"], F.when(p["i"] + step >= 0, parse_number(F.get(parts, p["i"] + step)))))
            return F.get(F.filter(own, lambda p: p["quantity"].isNotNull()), F.lit(0))

        return bound(fits, lambda fits: F.when(F.size(fits) > 0, F.coalesce(first(fits, 1), first(fits, -1))))

    either = "|".join(UNIT_TOKENS)
    unit_first, number_first = rf"(?iU)\b({either})\b\s+(\d+(?:[.,]\d+)?)\b", rf"(?iU)\b(\d+(?:[.,]\d+)?)\b\s+({either})\b"
    said = lambda pattern, unit, number: F.when(segment.rlike(pattern), pair(F.upper(F.regexp_extract(segment, pattern, unit)), parse_number(F.regexp_extract(segment, pattern, number))))
    parts = F.filter(F.transform(F.split(segment, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.coalesce(bound(parts, beside), said(unit_first, 1, 2), said(number_first, 2, 1))
    return F.coalesce(found, pair(F.lit(None).cast("string"), F.lit(None).cast("double")))
