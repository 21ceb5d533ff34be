"""Rules that put implausible areas right. Prices are never cleaned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of listing that have no living area, and kinds for which a very large one is plausible.
LAND_TYPES = ("terrein", "bouwgrond")
BIG_TYPES = (
    "kasteel", "landgoed", "klooster", "hotel", "hotel-restaurant", "camping", "gebouw", "bedrijfsruimte/ kantoor", "wijngaard", "discotheek", "restaurant", "winkel", "gîtes/ chambres d'hôtes",
)


def living_of_land(kind: Column, living: Column, land_types: tuple[str, ...] = LAND_TYPES) -> Column:
    """No living area for a plot of land."""
    return F.when(~F.coalesce(F.lower(kind), F.lit("")).isin(*land_types), living)


def plausible_living(kind: Column, living: Column, rooms: Column, beds: Column, land: Column, big_types: tuple[str, ...] = BIG_TYPES) -> Column:
    """Null for a living area over 2000, or over 500 where neither rooms nor beds nor land are stated, unless the kind is a large one."""
    bare = rooms.isNull() & beds.isNull() & land.isNull()
    odd = ~F.coalesce(F.lower(kind), F.lit("")).isin(*big_types) & ((living > 2000) | (bare & (living > 500)))
    return F.when(~F.coalesce(odd, F.lit(False)), living)


def plot_as_land(living: Column, land: Column, is_land: Column | None = None, least: int = 1000) -> tuple[Column, Column, Column]:
    """(living, land, moved): an area the size of a plot, with no land stated, is the land's."""
    plot = land.isNull() & (living >= least)
    if is_land is not None:
        plot = plot | (land.isNull() & is_land & living.isNotNull())
    plot = F.coalesce(plot, F.lit(False))
    return F.when(~plot, living), F.when(plot, living).otherwise(land), plot


def land_unless_echoed(living: Column, land: Column) -> Column:
    """No land where it only repeats the living area."""
    return F.nullif(land, living)
