"""Portals as table functions of SQL: pages in, typed rows out, by the portal's name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

from hearthlake.sources.html import Field, Selector, parse

#: What a table function is made of: the columns that it adds, and what it does with the rows of one listing, one at a time.
ADAPTERS: dict[str, tuple[StructType, type]] = {}


def adapter(name: str, **columns: DataType):
    """Registers a fold over the rows of one key, in order, under a name that SQL can call it by: add(row) and end() give rows."""

    def register(f: type):
        ADAPTERS[name] = (StructType([StructField(c, kind) for c, kind in columns.items()]), f)
        return f

    return register


@adapter("price_changes", at=LongType(), price=LongType(), before=LongType(), status=StringType())
class PriceChanges:
    """What a listing's sightings (at, price) change: new, then each drop and rise; unpriced sightings change nothing."""

    def __init__(self):
        self.first, self.before = True, None

    def add(self, row: Row) -> Iterator[tuple]:
        price, before = row["price"], self.before
        status = "new" if self.first else None if price is None or before is None or price == before else "price_drop" if price < before else "price_rise"
        self.first, self.before = False, before if price is None else price
        if status:
            yield row["at"], price, before, status

    def end(self) -> Iterator[tuple]:
        return iter(())


@adapter("spans", first_at=LongType(), last_at=LongType(), n=LongType())
class Spans:
    """The first and last sighting of a key, and how many there are."""

    def __init__(self):
        self.first = self.last = None
        self.n = 0

    def add(self, row: Row) -> Iterator[tuple]:
        self.first = row["at"] if self.n == 0 else self.first
        self.last, self.n = row["at"], self.n + 1
        return iter(())

    def end(self) -> Iterator[tuple]:
        yield self.first, self.last, self.n


def described(analyzed: AnalyzeArgument, name: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
    """The columns of a call, from its arguments: the key's, named as in the table, then the adapter's."""
    for argument, what in ((name, "name"), (key, "key")):
        if not argument.isConstantExpression or not isinstance(argument.value, str):
            raise ValueError(f"the {what} must be a constant text")
    if name.value not in ADAPTERS:
        raise ValueError(f"there is no adapter {name.value!r}; there are {', '.join(sorted(ADAPTERS))}")
    if not analyzed.isTable or key.value not in analyzed.dataType.names:
        raise ValueError(f"the table has no column {key.value!r}; it has {', '.join(analyzed.dataType.names) if analyzed.isTable else 'no columns'}")
    schema = StructType().add(key.value, analyzed.dataType[key.value].dataType)
    for field in ADAPTERS[name.value][0]:
        schema = schema.add(field)
    needed = [c for c in (key.value, "at", "price") if c in analyzed.dataType.names]
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("at")], select=[SelectedColumn(c) for c in needed])


class PerKey:
    """per_key(TABLE(rows), name, key): the adapter of that name over the rows of every key, in order of the column at.

    The call's columns follow from the table and the name while it is analysed; so does the partitioning, by the
    key alone, and that only the columns needed are read. Rows of one key meet in one task, one row at a time; none is kept.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, name: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        return described(table, name, key)

    def __init__(self):
        self.fold = None

    def eval(self, table: Row, name: str, key: str):
        if self.fold is None:
            self.fold, self.key = ADAPTERS[name][1](), table[key]
        for found in self.fold.add(table):
            yield (self.key, *found)

    def terminate(self):
        if self.fold is not None:
            for found in self.fold.end():
                yield (self.key, *found)


#: Sources of cards: card selector and fields. The portals are added when the functions are registered.
CARD_SOURCES: dict[str, tuple[str, dict[str, str]]] = {"navigation": ("nav > ul li", {"link": "a@href", "label": "a"})}


def card_source(name: str) -> tuple[str, dict[str, str]]:
    """The card selector and fields of a source."""
    if name not in CARD_SOURCES:
        raise ValueError(f"there is no source {name!r}; there are {', '.join(sorted(CARD_SOURCES))}")
    return CARD_SOURCES[name]


class PageCards:
    """page_cards(TABLE(pages), source): url, pos and the source's fields as texts, for every card of pages (url, html).

    The columns follow from the source's name while the call is analysed. Pages are read where they lie.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        if not name.isConstantExpression or not isinstance(name.value, str):
            raise ValueError("the source must be a constant text")
        if not table.isTable or not {"url", "html"} <= set(table.dataType.names):
            raise ValueError("the table must have the columns url and html")
        schema = StructType().add("url", StringType()).add("pos", IntegerType())
        for field in card_source(name.value)[1]:
            schema = schema.add(field, StringType())
        return AnalyzeResult(schema, select=[SelectedColumn("url"), SelectedColumn("html")])

    def __init__(self):
        self.card = None

    def eval(self, table: Row, name: str):
        if self.card is None:
            card, fields = card_source(name)
            self.card, self.fields = Selector(card), [Field(v) for v in fields.values()]
        for pos, node in enumerate(self.card.all(parse(table["html"] or ""))):
            yield (table["url"], pos, *(f.read(node) for f in self.fields))


class Adapters:
    """adapters(): the names that per_key takes, and the columns that each gives."""

    def eval(self):
        for name in sorted(ADAPTERS):
            yield name, ADAPTERS[name][0].simpleString()


def register_functions(spark: SparkSession) -> None:
    """Makes per_key, page_cards and adapters known to the SQL of a session."""
    from hearthlake.sources.portals import PORTALS  # the functions themselves need only the selectors, not the columns

    CARD_SOURCES.update({name: (portal.card, portal.fields) for name, portal in PORTALS.items()})
    spark.udtf.register("per_key", udtf(PerKey))
    spark.udtf.register("page_cards", udtf(PageCards))
    spark.udtf.register("adapters", udtf(Adapters, returnType=StructType().add("name", StringType()).add("columns", StringType())))


