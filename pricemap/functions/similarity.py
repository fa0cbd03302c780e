"""String similarity: native bounds and metrics, and the exact matcher's ratio in a vectorised function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = r"([\p{L}\p{N}_]+)"
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Long values that the letters' and digits' marks take (26 times 4 and 10 times 2 bits).
LETTER_LONGS = 3


def words(col: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(_WORDS), F.lit(1))


def token_sorted(col: Column) -> Column:
    """The words of a text in order, one space between."""
    return F.array_join(F.sort_array(words(col)), " ")


def levenshtein_score(a: Column, b: Column) -> Column:
    """100 for equal texts, 0 for texts without a place in common; both empty is 100."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(F.round(100.0 * (longest - F.levenshtein(a, b)) / longest, 4))


def marks(col: Column) -> Column:
    """Bits of a text by which pairs are ruled out: up to four of each letter, two of each digit, and its pairs of neighbours hashed to 256."""
    most = [(c, 2 if c.isdigit() else 4) for c in _SYMBOLS]
    longs, used = [[]], 0
    for c, n in most:
        if used + n > 63:
            longs, used = [*longs, []], 0
        count = F.least(F.length(col) - F.length(F.translate(col, c, "")), F.lit(n))
        full = F.call_function("shiftleft", F.lit(1).cast("long"), count) - 1
        longs[-1].append(F.shiftleft(full, used))
        used += n
    letters = [_either(own) for own in longs]
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 1, F.lit(1))), lambda k: F.pmod(F.hash(F.substring(col, k, 2)), F.lit(256)))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)))
    neighbours = [_neighbours(places, k, bit) for k in range(4)]
    return F.struct(*[v.alias(f"l{k}") for k, v in enumerate(letters)], *[v.alias(f"g{k}") for k, v in enumerate(neighbours)])


def _either(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out.bitwiseOR(v)
    return out


def _neighbours(places: Column, part: int, bit) -> Column:
    return F.aggregate(places, F.lit(0).cast("long"), lambda s, x: F.when(F.floor(x / 64) == part, s.bitwiseOR(bit(x))).otherwise(s))


def _alone(a: Column, b: Column, kind: str) -> Column:
    """Marks of the kind that ``a`` has and ``b`` hasn't."""
    names = [f"{kind}{k}" for k in range(LETTER_LONGS if kind == "l" else 4)]
    out = F.lit(0)
    for n in names:
        out = out + F.bit_count(a[n].bitwiseAND(F.bitwise_not(b[n])))
    return out


def ratio_possible(m1: Column, m2: Column, n1: Column, n2: Column, least: float) -> Column:
    """Whether the matcher's ratio (times 100) of texts of ``n1`` and ``n2`` characters can be ``least`` or more: a letter too many has no partner."""
    size = (n1 + n2) * F.lit(least / 200.0) - 1e-6
    return (n1 - _alone(m1, m2, "l") >= size) & (n2 - _alone(m2, m1, "l") >= size)


def levenshtein_possible(m1: Column, m2: Column, n1: Column, n2: Column, least: float) -> Column:
    """Whether the Levenshtein score of texts of ``n1`` and ``n2`` characters can be ``least`` or more.

    An edit settles one letter too many on either side, or two pairs of neighbours.
    """
    edits = F.greatest(n1, n2) * F.lit(1 - least / 100.0) + 1e-6
    near = F.abs(n1 - n2) <= edits
    return near & (_alone(m1, m2, "l") <= edits) & (_alone(m2, m1, "l") <= edits) & (_alone(m1, m2, "g") <= 2 * edits) & (_alone(m2, m1, "g") <= 2 * edits)


def matcher_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else SequenceMatcher(None, a, b).ratio() * 100


def _ratio(a: Column, b: Column) -> Column:
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([matcher_ratio(p or "", q or "") for p, q in zip(x, y)], dtype=float)

    return F.pandas_udf(ratio, "double")(a, b)


def matcher_ratio_of(a: Column, b: Column) -> Column:
    """The matcher's ratio of two texts as they are."""
    return _ratio(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Matcher ratio of the sorted words."""
    return _ratio(token_sorted(a), token_sorted(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Largest matcher ratio among the common words and either side's common and own words."""
    left, right = F.array_distinct(words(a)), F.array_distinct(words(b))
    join = lambda x: F.array_join(F.array_sort(x), " ")
    common = join(F.array_intersect(left, right))
    first = F.trim(F.concat_ws(" ", common, join(F.array_except(left, right))))
    second = F.trim(F.concat_ws(" ", common, join(F.array_except(right, left))))
    return F.greatest(_ratio(common, first), _ratio(common, second), _ratio(first, second))


def best_term_ratio(token: Column, terms: list[str]) -> Column:
    """Best Levenshtein score of a token against a short list of terms, without an index (``operators.terms`` has the matcher's ratio)."""
    return F.greatest(F.lit(0.0), *[levenshtein_score(token, F.lit(t)) / 100 for t in terms])


def item_similarity(no_a: Column, no_b: Column, desc_a: Column, desc_b: Column, unit_a: Column, unit_b: Column, qty_a: Column, qty_b: Column, metric: str = "levenshtein") -> Column:
    """100 for equal numbers, else 60 % description, 25 % unit, 15 % quantity within 5 %."""
    text = token_set_ratio(desc_a, desc_b) if metric == "difflib" else levenshtein_score(token_sorted(desc_a), token_sorted(desc_b))
    return weighted_similarity(no_a, no_b, text, unit_a, unit_b, qty_a, qty_b)


def weighted_similarity(no_a: Column, no_b: Column, text: Column, unit_a: Column, unit_b: Column, qty_a: Column, qty_b: Column) -> Column:
    """:func:`item_similarity` where the descriptions' score is known."""
    same_unit = F.when(unit_a.isNotNull() & (unit_a == unit_b), 100.0).otherwise(0.0)
    close = (qty_a == qty_b) | (F.abs(qty_a - qty_b) / F.greatest(F.abs(qty_a), F.abs(qty_b)) < 0.05)
    same_qty = F.when(F.coalesce(close, F.lit(False)), 100.0).otherwise(0.0)
    return F.when(no_a.isNotNull() & (no_a == no_b), 100.0).otherwise(0.6 * text + 0.25 * same_unit + 0.15 * same_qty)
