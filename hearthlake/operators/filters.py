"""Filters of the listing view, each a predicate that Spark can push down."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.text import contains_all, haystack, pretty_source, search_terms

FACETS = ("source", "searches", "type", "region", "dept_nl", "energy_label")
#: Facets whose value is a comma-joined list.
MULTI = frozenset(["searches"])
NO_VALUE = "—"
HAY_FIELDS = ("place", "type", "dept_nl", "region", "description", "features", "agent", "reference", "snippet", "source")


@dataclass(frozen=True)
class FilterSpec:
    query: str = ""
    price_min: float | None = None
    price_max: float | None = None
    eur_m2_max: float | None = None
    bedrooms_min: float | None = None
    living_min: float | None = None
    land_min: float | None = None
    only_drops: bool = False
    only_new_days: int | None = None
    hide_gone: bool = True
    need_living: bool = False
    chosen: dict[str, tuple[str, ...]] = field(default_factory=dict)


def facet_values(name: str) -> Column:
    """The values of a facet of a row: a dash for a blank, every name of a list."""
    column = F.coalesce(F.col(name), F.lit(""))
    if name in MULTI:
        return F.filter(F.split(column, ","), lambda v: v != "")
    return F.array(F.when(column == "", NO_VALUE).otherwise(column))


def row_haystack() -> Column:
    return haystack(*(F.col(c) for c in HAY_FIELDS), pretty_source(F.col("source")), F.col("country"))


def predicates(spec: FilterSpec) -> list[Column]:
    """What a row must meet, apart from the facets. A null price, area or count fails a bound; a null age passes."""
    found = []
    for column, least in (("price", spec.price_min), ("bedrooms", spec.bedrooms_min), ("living_m2", spec.living_min), ("land_m2", spec.land_min)):
        if least is not None:
            found.append(F.col(column) >= least)
    for column, most in (("price", spec.price_max), ("eur_m2", spec.eur_m2_max)):
        if most is not None:
            found.append(F.col(column) <= most)
    if spec.only_drops:
        found.append(F.col("price_drop") > 0)
    if spec.only_new_days is not None:
        found.append(F.coalesce("days_known", F.lit(0)) <= spec.only_new_days)
    if spec.hide_gone:
        found.append(F.col("gone_at").isNull())
    if spec.need_living:
        found.append(F.coalesce("living_m2", F.lit(0)) != 0)
    if terms := search_terms(spec.query):
        found.append(contains_all(row_haystack(), terms))
    return [F.coalesce(p, F.lit(False)) for p in found]


def facet_predicates(spec: FilterSpec) -> dict[str, Column]:
    return {name: F.arrays_overlap(facet_values(name), F.array(*map(F.lit, values))) for name, values in spec.chosen.items() if values}


def matching(view: DataFrame, spec: FilterSpec, skip: str | None = None) -> DataFrame:
    """The rows of view that meet the filter; skip names a facet whose own choice is left out."""
    for p in [*predicates(spec), *(p for name, p in facet_predicates(spec).items() if name != skip)]:
        view = view.where(p)
    return view


def ingest_skip(price: Column, priceless: bool | None = None, above: int | None = None, below: int | None = None) -> Column:
    """Whether a card is left out: no price where those are dropped, or a price outside the bounds."""
    outside = F.lit(False)
    if above is not None:
        outside = outside | (price > above)
    if below is not None:
        outside = outside | (price < below)
    return F.when(price.isNull(), F.lit(bool(priceless))).otherwise(outside)


def ingest_skip_by_spec(cards: DataFrame, specs: DataFrame) -> DataFrame:
    """cards (search, price) that their search's skip rule keeps; specs (search, skip) is one row a search."""
    rule = F.col("skip")
    drop = F.when(F.col("price").isNull(), F.coalesce(rule["priceless"], F.lit(False))).otherwise(
        F.coalesce(F.col("price") > rule["above"], F.lit(False)) | F.coalesce(F.col("price") < rule["below"], F.lit(False))
    )
    return cards.join(specs.select("search", "skip"), "search", "left").where(~drop).select(*cards.columns)
