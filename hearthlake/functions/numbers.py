"""Displayed numbers to integers: each portal writes them its own way, and the ways are not merged.

All rules are column expressions. Patterns use ASCII classes with the no-break space spelled out,
since Java's \\s leaves it out; rounding is half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.geo import literal_map

WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
SQUARE_METRES = r"(?:m²|m2|sq\.?\s*m|sqm)"
AMOUNT = r"([0-9][0-9\s.,]*)"


def spaced(text: Column) -> Column:
    """No-break spaces as spaces."""
    return F.replace(text.cast("string"), F.lit(" "), F.lit(" "))


def filled(text: Column) -> Column:
    """A text, null if it is empty; nullif would work the text out twice inside a lambda, and twice more for each one around it."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is no match or the group is empty."""
    return filled(F.regexp_extract(text, pattern, group))


def once(value: Column, rule) -> Column:
    """rule(value) with value worked out once, however often the rule names it."""
    return F.transform(F.array(value), lambda x: rule(x))[0]


def matched(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def rounded(number: Column) -> Column:
    return F.bround(number.try_cast("double"), 0).cast("long")


def digits(text: Column) -> Column:
    """All digits as one number: 70,000.00 is 7000000."""
    return F.regexp_replace(text.cast("string"), "[^0-9]", "").try_cast("long")


def decimal_comma(text: Column) -> Column:
    """A comma without a point is a decimal comma, rounded; else all digits."""
    comma = lambda raw: F.contains(raw, F.lit(",")) & ~F.contains(raw, F.lit("."))
    return once(F.trim(spaced(text)), lambda raw: F.when(comma(raw), rounded(F.replace(F.replace(raw, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")))).otherwise(digits(raw)))


def dot_thousands(text: Column) -> Column:
    """Points between groups of three are thousands; a lone comma is decimal; else all digits."""

    def rule(compact: Column) -> Column:
        comma = F.contains(compact, F.lit(",")) & ~F.contains(compact, F.lit("."))
        return F.when(matched(compact, r"^[0-9]{1,3}(\.[0-9]{3})+$"), digits(compact)).when(comma, rounded(F.replace(compact, F.lit(","), F.lit(".")))).otherwise(digits(compact))

    return once(F.regexp_replace(F.replace(spaced(text), F.lit("&#x20AC;"), F.lit("")), "[€$£ ]", ""), rule)


def comma_thousands(text: Column, join_spaces: bool = False) -> Column:
    """Commas are dropped, the first number with its decimals is rounded; with join_spaces, spaces are dropped too."""
    cleaned = F.regexp_replace(spaced(text), "[, ]" if join_spaces else ",", "")
    return rounded(found(cleaned, r"([0-9]+(?:\.[0-9]+)?)"))


def first_token(text: Column) -> Column:
    """The first run of digits with points, commas and spaces between them: all its digits."""
    return digits(found(F.trim(spaced(text)), r"([0-9]+(?:[.\s,][0-9]+)*)"))


def european(text: Column) -> Column:
    """Groups of three are thousands, whichever sign parts them; any other single sign is decimal."""

    def rule(raw: Column) -> Column:
        grouped = matched(raw, r"^[0-9]{1,3}(\.[0-9]{3})+$") | matched(raw, r"^[0-9]{1,3}(,[0-9]{3})+$")
        both = F.contains(raw, F.lit(",")) & F.contains(raw, F.lit("."))
        return F.when(grouped | both, digits(raw)).otherwise(rounded(F.replace(raw, F.lit(","), F.lit("."))))

    return once(found(spaced(text), r"([0-9]+(?:[.,][0-9]+)*)"), rule)


def decimal(text: Column) -> Column:
    return F.trim(F.replace(text.cast("string"), F.lit(","), F.lit("."))).try_cast("double")


#: By portal: how it writes whole numbers.
DIALECTS = {
    "franimo": digits, "akiyaportal": digits, "mubawab": digits, "domaza": digits, "holprop": digits, "ok_bulgaria": digits, "abruzzopropertyitaly": digits, "lefigaro": decimal_comma,
    "greenacres": dot_thousands, "homege": comma_thousands, "bulgarianproperties": lambda t: comma_thousands(t, join_spaces=True), "centrarium": first_token, "abruzzoruralproperty": european,
}


def area(text: Column, dialect=digits, unit: str = SQUARE_METRES) -> Column:
    """The number before a unit of area, read in a dialect."""
    return dialect(found(spaced(text), rf"(?i){AMOUNT}\s*{unit}"))


def area_or_number(text: Column, dialect=digits, unit: str = SQUARE_METRES) -> Column:
    """As area; a text without a unit is read as a number."""
    return F.when(matched(spaced(text), rf"(?i){AMOUNT}\s*{unit}"), area(text, dialect, unit)).otherwise(dialect(spaced(text)))


def leading_area(text: Column) -> Column:
    """Only the number that the text starts with, so that the 2 of m2 is not read."""
    return digits(found(spaced(text), r"^\s*([0-9.,\s]+)"))


def decimal_area(text: Column, zero_is_null: bool = False) -> Column:
    """105.3m² is 105; with zero_is_null nothing stands for zero."""
    value = F.replace(found(F.replace(spaced(text), F.lit(","), F.lit("")), rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*{SQUARE_METRES}"), F.lit(","), F.lit("")).try_cast("double")
    return once(value, lambda v: F.when(v > 0, rounded(v))) if zero_is_null else rounded(value)


def hectares(text: Column) -> Column:
    """Square metres of a number of hectares; null for zero."""
    value = decimal(found(spaced(text), r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*hectares?\b"))
    return once(value, lambda v: F.when(v > 0, rounded(v * 10_000)))


def bedroom_words(text: Column) -> Column:
    """three bedrooms, 3-bedroom."""
    token = F.lower(found(text, rf"(?i)\b({'|'.join(WORDS)}|[0-9]+)\s*-?\s*bedrooms?\b"))
    return F.coalesce(token.try_cast("long"), F.element_at(literal_map(WORDS), token).cast("long"))


def layout(text: Column) -> Column:
    """A Japanese floor plan: 3LDK."""
    pattern = r"(?i)([0-9]+)\s*(LDK|SDK|DK|LK|K|R|LD|S)\b"
    return F.concat(found(text, pattern), F.upper(found(text, pattern, 2)))


def layout_bedrooms(text: Column) -> Column:
    return found(layout(text), "^([0-9]+)").try_cast("long")


def year(text: Column) -> Column:
    return found(text, r"\b((?:19|20)[0-9]{2})\b").try_cast("long")
