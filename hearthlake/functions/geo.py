"""Countries, coordinates and the projection of the locator map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country names as the portals write them, and portals that list one country only.
ISO_BY_NAME = {
    "france": "FR", "italy": "IT", "italia": "IT", "spain": "ES", "españa": "ES", "portugal": "PT", "greece": "GR", "bulgaria": "BG",
    "montenegro": "ME", "serbia": "RS", "albania": "AL", "morocco": "MA", "maroc": "MA", "georgia": "GE", "japan": "JP",
}
SOURCE_COUNTRY = {
    "franimo": "FR", "greenacres": "FR", "lefigaro": "FR", "akiyaportal": "JP", "ok_bulgaria": "BG", "bulgarianproperties": "BG",
    "abruzzopropertyitaly": "IT", "abruzzoruralproperty": "IT", "centrarium": "ME", "mubawab": "MA", "homege": "GE",
}
CODES = sorted(set(ISO_BY_NAME.values()))


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def iso(name: Column) -> Column:
    """ISO-2 code of a country name or code; null where it is neither."""
    key = F.lower(F.trim(name.cast("string")))
    return F.when((F.length(key) == 2) & F.upper(key).isin(CODES), F.upper(key)).otherwise(F.element_at(literal_map(ISO_BY_NAME), key))


def country_for(raw_country: Column, row_country: Column, source: Column, seed_country: Column | None = None) -> Column:
    """The first that resolves: raw fields, the row, the seed, the source's home."""
    seed = [iso(seed_country)] if seed_country is not None else []
    return F.coalesce(iso(raw_country), iso(row_country), *seed, F.element_at(literal_map(SOURCE_COUNTRY), source))


def clean_coordinate(value: Column, limit: float) -> Column:
    """The number if it is one between -limit and limit, else null."""
    number = value.try_cast("double")
    return F.when(number.between(-limit, limit) & ~F.isnan(number), number)


def plottable(lat: Column, lon: Column) -> Column:
    inside = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(inside, F.lit(False))


def not_at_zero(lat: Column, lon: Column, least: float = 1e-4, both: bool = False) -> tuple[Column, Column]:
    """Coordinates nearer to zero than least become null: each by itself, or only where both are."""
    if both:
        zero = (F.abs(lat) < least) & (F.abs(lon) < least)
        return F.when(~zero, lat), F.when(~zero, lon)
    return F.when(F.abs(lat) >= least, lat), F.when(F.abs(lon) >= least, lon)


def project(lat: Column, lon: Column, box: tuple[float, float, float, float], width: float, height: float) -> tuple[Column, Column, Column]:
    """x, y in a frame of width by height over box (min lon, max lon, min lat, max lat), and whether they fall inside it."""
    west, east, south, north = box
    squeeze = F.cos(F.radians(F.lit((south + north) / 2)))
    x = (lon * squeeze - west * squeeze) / ((F.lit(east) - west) * squeeze) * width
    y = (F.lit(north) - lat) / (north - south) * height
    return x, y, (x >= 0) & (x <= width) & (y >= 0) & (y <= height)


def tolerance(span: Column) -> Column:
    """How far a simplified outline may stray, from the extent of the country."""
    return F.greatest(F.lit(0.004), F.least(F.lit(0.03), span / 600))


def bounds(rings: Column) -> Column:
    """Struct west, east, south, north of all points ([lon, lat]) of an outline's rings."""
    points = F.flatten(rings)
    lons, lats = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(lons).alias("west"), F.array_max(lons).alias("east"), F.array_min(lats).alias("south"), F.array_max(lats).alias("north"))


def extent(rings: Column) -> Column:
    """The larger side of an outline's bounding box, in degrees."""
    box = bounds(rings)
    return F.greatest(box["east"] - box["west"], box["north"] - box["south"])
