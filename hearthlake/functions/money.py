"""Prices: which amount a portal shows, in what currency, and what it is in euros."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.numbers import AMOUNT, DIALECTS, digits, found, matched, once, rounded, spaced

# Documented rates. Where a portal's rate is stated the other way round, amounts are divided.
TIMES = {"akiyaportal": {"USD": 0.85}, "homege": {"USD": 0.85}, "bulgarianproperties": {"GBP": 1.163, "USD": 0.87}, "domaza": {"USD": 0.87}, "greenacres": {"USD": 0.87}, "ok_bulgaria": {"GBP": 1.166}}
DIVIDED_BY = {"akiyaportal": {"JPY": 170.0}, "homege": {"GEL": 3.03}, "mubawab": {"MAD": 10.9}}

# How each portal writes prices, in the order in which they count. A pattern has a group for each side on which the sign may stand.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "lefigaro": [(r"([0-9\s.,]+)\s*€|€\s*([0-9\s.,]+)", "EUR")],
    "centrarium": [(r"€\s*([0-9\s.,]+)|([0-9\s.,]+)\s*€", "EUR")],
    "abruzzopropertyitaly": [(r"€\s*([0-9.,\s]+)", "EUR")],
    "abruzzoruralproperty": [(r"€\s*([0-9.,\s]+)", "EUR")],
    "franimo": [(r"€\s*([0-9.,\s]+)", "EUR")],
    "bulgarianproperties": [(rf"(?i)(?:€|&euro;)\s*{AMOUNT}", "EUR"), (rf"(?i)(?:£|&pound;)\s*{AMOUNT}", "GBP"), (rf"(?i)(?:\$|USD)\s*{AMOUNT}", "USD")],
    "mubawab": [(rf"(?i){AMOUNT}\s*EUR\b", "EUR"), (rf"(?i){AMOUNT}\s*(?:DH|MAD)\b", "MAD")],
    "homege": [
        (rf"(?i){AMOUNT}\s*(?:€|EUR\b)", "EUR"), (rf"€\s*{AMOUNT}", "EUR"), (rf"(?i){AMOUNT}\s*(?:₾|GEL\b)", "GEL"), (rf"₾\s*{AMOUNT}", "GEL"),
        (rf"(?i){AMOUNT}\s*(?:\$|USD\b|US\$)", "USD"), (rf"\$\s*{AMOUNT}", "USD"),
    ],
    "greenacres": [
        (r"(?i)(?:prijs\s+in\s+euros?|price\s+in\s+euros?)\s*:\s*([0-9\s.]+)", "EUR"), 
        (r"([0-9][0-9\s.]*)\s*(?:€|&euro;|&#x20AC;|\bEUR\b)|(?:€|&euro;|&#x20AC;|\bEUR\b)\s*([0-9][0-9\s.]*)", "EUR"), (r"([0-9][0-9\s.]*)\s*\$|\$\s*([0-9][0-9\s.]*)", "USD"),
    ],
    "ok_bulgaria": [(r"€\s*([0-9.,\s]+)", "EUR"), (r"£\s*([0-9.,\s]+)", "GBP")],
    "holprop": [(r"(?i)€\s*([0-9.,\s]+)|([0-9.,\s]+)\s*EUR\b", "EUR"), (r"(?i)£\s*([0-9.,\s]+)\s*GBP", "GBP"), (r"(?i)\$\s*([0-9.,\s]+)\s*USD", "USD")],
    "domaza": [(rf"€\s*{AMOUNT}|{AMOUNT}\s*€", "EUR"), (rf"\$\s*{AMOUNT}", "USD")],
    "akiyaportal": [(r"\$\s*([0-9,]+(?:\.[0-9]+)?)", "USD"), (r"[¥￥]\s*([0-9,]+)", "JPY"), (r"(?i)([0-9,]+)\s*(?:yen|JPY|円)", "JPY")],
}
# Texts instead of a price.
NO_PRICE = {
    "lefigaro": r"(?i)prix\s+(?:sur\s+demande|nous\s+consulter)|nous\s+consulter",
    "mubawab": r"(?i)price\s+on\s+request|prix\s+à\s+consulter",
    "abruzzoruralproperty": r"(?i)\b(sold|under offer|reserved)\b",
}
GROUPS = re.compile(r"(?<!\\)\((?!\?)")
MONEY = "struct<amount:bigint,currency:string>"


def captured(blob: Column, pattern: str) -> Column:
    """What the first match of a pattern captures, in whichever of its groups."""
    return F.coalesce(*(found(blob, pattern, i + 1) for i in range(len(GROUPS.findall(pattern)))))


def money(text: Column, source: str) -> Column:
    """(amount, currency) of the first pattern of the portal that the text meets; null where none does."""
    read = DIALECTS[source]

    def rule(blob: Column) -> Column:
        stated = F.array(*(F.struct(read(captured(blob, p)).cast("long").alias("amount"), F.lit(c).alias("currency")) for p, c in PATTERNS[source]))
        if source == "ok_bulgaria":  # whichever sign comes first
            sign = F.when(found(blob, r"([€£])\s*[0-9.,\s]+") == "€", "EUR").otherwise("GBP")
            stated = F.array(F.struct(digits(found(blob, r"[€£]\s*([0-9.,\s]+)")).alias("amount"), sign.alias("currency")))
        first = F.try_element_at(F.filter(stated, lambda m: m["amount"].isNotNull()), F.lit(1)).cast(MONEY)
        if source not in NO_PRICE:
            return first
        silent = matched(blob, NO_PRICE[source])
        if source == "abruzzoruralproperty":
            silent = silent & ~F.contains(blob, F.lit("€"))
        return F.when(~silent, first)

    return once(spaced(text), rule)


def amounts_by(blob: Column, source: str) -> dict[str, Column]:
    """The first amount of each currency that a text without no-break spaces states, null for the others."""
    read, own = DIALECTS[source], {}
    for pattern, currency in PATTERNS[source]:
        amount = read(captured(blob, pattern)).cast("long")
        own[currency] = F.coalesce(own[currency], amount) if currency in own else amount
    return own


def amounts(text: Column, source: str) -> Column:
    """Every currency that the text states, as a map to the first amount of each."""
    own = amounts_by(spaced(text), source)
    entries = F.array(*(F.struct(F.lit(c).alias("key"), a.alias("value")) for c, a in own.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def to_euro(amount: Column, currency: Column, source: str) -> Column:
    """Whole euros at the portal's documented rate, half to even; null for a currency without a rate."""
    return once(F.struct(amount.alias("amount"), currency.alias("currency")), lambda paid: euros(paid["amount"], paid["currency"], source))


def euros(amount: Column, currency: Column, source: str) -> Column:
    """As to_euro, for an amount and a currency that are columns already: both are named more than once."""
    value = F.when(currency == "EUR", amount.cast("long"))
    for c, rate in TIMES.get(source, {}).items():
        value = value.when(currency == c, rounded(amount * F.lit(rate)))
    for c, rate in DIVIDED_BY.get(source, {}).items():
        value = value.when(currency == c, rounded(amount / F.lit(rate)))
    return value


def priced(paid: Column, source: str) -> Column:
    """(price, currency, origin): what is stored of an amount and where it comes from. One portal's prices stay as they are."""

    def rule(paid: Column) -> Column:
        amount, currency = paid["amount"], paid["currency"]
        if source == "holprop":
            return F.struct(amount.alias("price"), F.coalesce(currency, F.lit("EUR")).alias("currency"), F.when(currency.isNotNull(), F.concat(F.lit("portal_"), F.lower(currency))).alias("origin"))
        origin = F.when(currency == "EUR", "portal_eur").otherwise(F.concat(F.lower(currency), F.lit("_converted")))
        return F.struct(to_euro(amount, currency, source).alias("price"), F.lit("EUR").alias("currency"), origin.alias("origin"))

    return once(paid, rule)


def best_priced(stated: Column, source: str, order: tuple[str, ...] = ("EUR", "GBP", "USD")) -> Column:
    """As priced, from a map of stated amounts: the portal's euros, else the first currency that is there."""

    def first(stated: Column) -> Column:
        return reduce(lambda rest, c: F.when(stated[c].isNotNull(), F.struct(stated[c].alias("amount"), F.lit(c).alias("currency"))).otherwise(rest), reversed(order), F.lit(None).cast(MONEY))

    return priced(once(stated, first), source)


def price_before_drop(text: Column, price: Column, currency: Column) -> Column:
    """The price before `Decreased by N unit`, in the price's currency; a drop in dirhams counts against a price in euros at the rate."""
    pattern = rf"(?i)Decreased by\s+{AMOUNT}\s*(EUR|DH|MAD)\b"
    drop, unit = digits(found(text, pattern)), F.upper(found(text, pattern, 2))
    dirham = unit.isin("DH", "MAD")
    return F.when(dirham & (currency == "MAD"), price + drop).when((unit == "EUR") & (currency == "EUR"), price + drop).when(dirham & (currency == "EUR"), price + to_euro(drop, F.lit("MAD"), "mubawab"))


FX_SOURCE = "documented fixed rate, not a live feed"


#: The order in which stated currencies count.
ORDER = ("EUR", "GBP", "USD", "JPY", "GEL", "MAD")


def code(currency: Column) -> Column:
    """A currency in upper case; Spark's own upper goes through ICU, which takes longer than reading a page's JSON-LD."""
    return F.when(currency.isin(*ORDER), currency).otherwise(F.upper(currency))


def first_stated(stated: dict[str, Column], order: tuple[str, ...] = ORDER) -> Column:
    """The portal's euros if they are there, else the first currency of the order that is."""
    return F.coalesce(*(F.when(stated[c].isNotNull(), c) for c in order if c in stated))


def provenance_parts(stated: dict[str, Column], first: Column, source: str, order: tuple[str, ...] = ORDER) -> dict[str, Column]:
    """What the raw fields keep of a price, null where it is not there: price_<currency> of every stated amount, price_source and, where converted, price_eur, fx_rate and fx_source.

    stated has the amounts by currency, first the currency that counts. One portal's amounts are never
    converted; one calls its dollars its own price.
    """
    rates = TIMES.get(source, {}) | {c: 1 / r for c, r in DIVIDED_BY.get(source, {}).items()}
    converted = (first != "EUR") & F.lit(source != "holprop")
    kept = {f"price_{c.lower()}": stated[c].cast("string") if c in stated else F.lit(None).cast("string") for c in order}
    amount = F.coalesce(*(stated[c] for c in order if c in stated))
    kept["price_eur"] = F.coalesce(kept["price_eur"], F.when(converted, euros(amount, first, source).cast("string")))
    own = "portal_usd" if source == "akiyaportal" else None
    kept["price_source"] = F.when(first == "USD", own).otherwise(None) if own else F.lit(None)
    kept["price_source"] = F.coalesce(kept["price_source"], *(F.when(converted & (first == c), f"{c.lower()}_converted") for c in order), *(F.when(first == c, f"portal_{c.lower()}") for c in order))
    rate = F.lit(None).cast("double")
    for c, r in rates.items():
        rate = F.when(converted & (first == c), r).otherwise(rate)
    kept["fx_rate"] = rate.cast("string")
    kept["fx_source"] = F.when(rate.isNotNull(), FX_SOURCE)
    return {k: v.cast("string") for k, v in kept.items()}


def provenance(stated: Column, source: str, order: tuple[str, ...] = ORDER) -> Column:
    """Map of what the raw fields keep of a price, from a map of currencies to amounts."""

    def rule(stated: Column, first: Column) -> Column:
        kept = provenance_parts({c: stated[c] for c in order}, first, source, order)
        return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, kept)), F.array(*kept.values())), lambda k, v: v.isNotNull())

    return once(stated, lambda stated: once(first_stated({c: stated[c] for c in order}, order), lambda first: rule(stated, first)))
