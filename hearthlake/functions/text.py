"""String rules of the listing engine as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.geo import literal_map

# Display names of the portals, in the order in which facets show them.
SOURCE_NAMES = {
    "franimo": "Franimo", "ok_bulgaria": "OK Bulgaria", "akiyaportal": "Akiya Portal", "holprop": "Holprop", "abruzzopropertyitaly": "Abruzzo Property Italy",
    "abruzzoruralproperty": "Abruzzo Rural", "centrarium": "Centrarium", "mubawab": "Mubawab", "homege": "home.ge", "bulgarianproperties": "Bulgarian Properties",
    "domaza": "Domaza", "lefigaro": "Le Figaro", "greenacres": "Green-Acres",
}


def plain_letters() -> tuple[str, str]:
    """Every character of the first plane that is one letter and its marks, and that letter: canonical decomposition, as a rule."""
    pairs = []
    for code in range(0xC0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]) and not unicodedata.combining(parts[0]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = plain_letters()
#: White space of the first 128 characters, which both engines treat alike.
BLANKS = r"[\x20\x09-\x0D]+"


def blank_as_null(value: Column) -> Column:
    return F.get(F.array_remove(F.array(value), ""), F.lit(0))


def node_text(value: Column) -> Column:
    """Text with every run of white space, no-break spaces too, as one space; null where nothing is left."""
    return blank_as_null(F.trim(F.regexp_replace(value, r"[\s\x{00A0}]+", " ")))


def pretty_source(source: Column) -> Column:
    """Display name of a portal key; unknown keys get words with capitals for underscores and hyphens."""
    words = F.transform(F.split(F.regexp_replace(source, "[_-]+", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.when(F.coalesce(source, F.lit("")).isin("", "—"), F.coalesce(source, F.lit(""))).otherwise(F.coalesce(F.element_at(literal_map(SOURCE_NAMES), source), F.array_join(words, " ")))


def source_rank(source: Column) -> Column:
    """Place of a portal in facets; unknown ones share the last place."""
    place = F.array_position(F.array(*map(F.lit, SOURCE_NAMES)), source)
    return F.when(place > 0, place - 1).otherwise(999)


def location_hint(dept: Column, region: Column, country: Column) -> Column:
    return F.coalesce(blank_as_null(dept), blank_as_null(region), blank_as_null(country), F.lit(""))


def search_terms(query: str) -> list[str]:
    """The words of a query, lower-cased."""
    return query.strip().lower().split()


def terms(query: Column) -> Column:
    """The words of a text, lower-cased: the rule of search_terms as a column."""
    return F.filter(F.split(F.lower(query), BLANKS), lambda x: x != "")


def haystack(*fields: Column) -> Column:
    """The fields that are not blank, space-joined and lower-cased."""
    return F.lower(F.concat_ws(" ", *map(blank_as_null, fields)))


def contains_all(hay: Column, terms: list[str]) -> Column:
    found = F.lit(True)
    for term in terms:
        found = found & F.contains(hay, F.lit(term))
    return found


def fold(name: Column) -> Column:
    """A name for matching: no accents or other combining marks, no part in parentheses, lower case."""
    plain = F.regexp_replace(F.translate(name, ACCENTED, PLAIN), r"[\x{0300}-\x{036F}]", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s*\(.*\)\s*", "")))


def without_pitch(description: Column) -> Column:
    """A description without the portal's sales pitch at its end; null where nothing is left."""
    return node_text(F.regexp_replace(description, r"(?i)\s*Start a free trial[^.]*\.\s*$", ""))


def label(value: Column) -> Column:
    """A table label: collapsed, without spaces and colons at its ends, lower-cased."""
    return F.lower(F.regexp_replace(node_text(value), r"^[ :]+|[ :]+$", ""))


def first_match(text: Column, needles: list[tuple[str, str]]) -> Column:
    """The value of the first needle that the lower-cased text contains."""
    found = F.lit(None).cast("string")
    for needle, value in reversed(needles):
        found = F.when(F.contains(F.lower(text), F.lit(needle)), value).otherwise(found)
    return found


def latin_parts(text: Column, dropped: list[str]) -> Column:
    """The comma-separated parts without Cyrillic letters and not among dropped (lower case)."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike("[A-Za-z]") & ~p.rlike(r"\p{IsCyrillic}") & ~F.lower(p).isin(dropped))


def photo_name(name: Column) -> Column:
    """A file name without its usual ending; any other is marked."""
    return F.when(F.endswith(name, F.lit(".jpg")), F.regexp_replace(name, r"\.jpg$", "")).otherwise(F.concat(F.lit("="), name))


def path_head(url: Column) -> Column:
    """Everything up to the last slash, which an address without one gets too."""
    return F.concat(F.regexp_replace(url, r"/?[^/]*$", ""), F.lit("/"))


def path_tail(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]*)$", 1)


def relative(url: Column, prefix: str) -> Column:
    return F.when(F.startswith(url, F.lit(prefix)), F.substring(url, F.lit(len(prefix) + 1), F.length(url))).otherwise(url)


def absolute(url: Column, base: str) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def pretty_type(raw: Column, aliases: dict[str, str], fallback: str, joiner: str = "") -> Column:
    """The name of a kind of property: an alias of its lower-cased words joined by `joiner`, else the text with one capital."""
    trimmed = F.trim(raw)
    key = F.regexp_replace(F.lower(trimmed), r"\s+", joiner)
    capital = F.concat(F.upper(F.substring(trimmed, 1, 1)), F.lower(F.substring(trimmed, F.lit(2), F.length(trimmed))))
    return F.when(F.coalesce(raw, F.lit("")) == "", fallback).otherwise(F.coalesce(F.try_element_at(literal_map(aliases), key), capital))


def dutch_number(value: Column) -> Column:
    """A number without decimals, thousands apart by dots; a dash where there is none."""
    return F.coalesce(F.translate(F.format_number(F.round(value), 0), ",", "."), F.lit("—"))
