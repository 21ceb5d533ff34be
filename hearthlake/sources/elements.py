"""Pages as a table of elements; selectors are joins of intervals inside a page, fields are grouped from what they find.

An element's descendants are the rows of its page whose number `pre` lies after its own and not after its
`post`. So a descendant is an interval join, a child one on `parent`, a later sibling one on equal parents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthlake.session import written
from hearthlake.sources.html import SCOPES, SELF_CLOSING, VOID

#: Tags of the rows that hold text, and text of scripts and styles, which is no text of what they stand in.
TEXT, RAW, CODE = "#text", "#raw", ("script", "style")
ROOT = "#root"


class Rows(HTMLParser):
    """One page as rows in document order; unknown closing tags are skipped, open elements end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attrs, self.text = [None], [ROOT], [None], [None]
        self.at, self.held = 0, ""

    def add(self, parent: int, tag: str, attrs: dict | None, text: str | None) -> int:
        self.parent.append(parent), self.tag.append(tag), self.attrs.append(attrs), self.text.append(text)
        return len(self.tag) - 1

    def flush(self) -> None:
        data, self.held = self.held, ""
        if self.tag[self.at] in CODE:
            self.add(self.at, RAW, None, data) if data else None
        elif shown := " ".join(data.split()):
            self.add(self.at, TEXT, None, shown)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        under, seen = self.at, self.at
        if tag in SELF_CLOSING:
            while self.parent[seen] is not None and self.tag[seen] not in SCOPES:
                under = self.parent[seen] if self.tag[seen] in SELF_CLOSING[tag] else under
                seen = self.parent[seen]
        new = self.add(under, tag, {k: v or "" for k, v in attrs}, None)
        self.at = under if tag in VOID else new

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.flush()
        self.add(self.at, tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        node = self.at
        while self.parent[node] is not None and self.tag[node] != tag:
            node = self.parent[node]
        if self.parent[node] is not None:
            self.at = self.parent[node]

    def handle_data(self, data: str) -> None:
        self.held += data

    def last(self) -> list[int]:
        """For every row the number of the last one inside it."""
        post = list(range(len(self.tag)))
        for n in range(len(post) - 1, 0, -1):
            post[self.parent[n]] = max(post[self.parent[n]], post[n])
        return post


def elements(pages: DataFrame) -> DataFrame:
    """page, url, pre, post, parent, tag, attrs, text: one row for each element and text of pages (url, html), the page itself as row 0.

    page tells rows of pages apart, whose addresses may repeat. A null page has its row 0 only.
    """
    names = ["page", "url", "pre", "post", "parent", "tag", "attrs", "text"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = Rows()
                rows.feed(html or "")
                rows.close()
                rows.flush()
                n = len(rows.tag)
                columns = [[page] * n, [url] * n, list(range(n)), rows.last(), rows.parent, rows.tag, [None if a is None else list(a.items()) for a in rows.attrs], rows.text]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    numbered = pages.select(F.monotonically_increasing_id().alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return numbered.mapInArrow(run, "page long, url string, pre int, post int, parent int, tag string, attrs map<string,string>, text string")


STEP = re.compile(r"[>~](?=\s|$)|(?:[^\s>\[]|\[[^\]]*\])+")
COMPOUND = re.compile(r"([a-zA-Z0-9]+|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)(?::has\(([^)]*)\))?$")
TEST = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


def chains(selector: str) -> list[list[tuple[str, str]]]:
    """The alternatives of a selector, each as compound selectors with the sign before them: inside, > directly inside, ~ after."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        chain, sign = [], ""
        for word in STEP.findall(alternative):
            if word in (">", "~"):
                sign = word
            else:
                chain.append((word, sign))
                sign = ""
        out.append(chain)
    return out


def condition(compound: str) -> tuple[Column, str | None]:
    """What tag, attrs must be for a compound selector, and the compound selector of something inside, if it asks for one."""
    m = COMPOUND.match(compound)
    if m is None:
        raise ValueError(f"cannot read the selector {compound!r}")
    tests = [F.col("attrs").isNotNull()]
    if m[1] not in (None, "*"):
        tests.append(F.col("tag") == m[1])
    for cls, ident, name, sign, value in TEST.findall(m[2]):
        have = F.col("attrs")["class" if cls else "id" if ident else name]
        if cls:
            tests.append(F.array_contains(F.split(have, r"\s+"), cls))
        elif ident:
            tests.append(have == ident)
        else:
            tests.append({"": have.isNotNull(), "=": have == value, "*=": F.contains(have, F.lit(value)), "^=": F.startswith(have, F.lit(value)), "$=": F.endswith(have, F.lit(value))}[sign])
    return F.coalesce(reduce(and_, tests), F.lit(False)), m[3]


def meeting(table: DataFrame, compound: str) -> DataFrame:
    """The elements that meet a compound selector."""
    test, inside = condition(compound)
    found = table.where(test)
    if inside is None:
        return found
    below = meeting(table, inside).select(F.col("page").alias("_page"), F.col("pre").alias("_pre"))
    return found.join(below, (F.col("page") == F.col("_page")) & (F.col("_pre") > F.col("pre")) & (F.col("_pre") <= F.col("post")), "left_semi")


def selected(table: DataFrame, tops: DataFrame, selector: str) -> DataFrame:
    """page, top, pre, post of what a selector finds inside each of tops (page, top, last)."""
    found = []
    for chain in chains(selector):
        at = tops.select("page", "top", F.col("top").alias("_pre"), F.col("last").alias("_post"), F.lit(None).cast("int").alias("_parent"))
        for compound, sign in chain:
            own = meeting(table, compound).select("page", "pre", "post", "parent")
            place = {"": (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_post")), ">": F.col("parent") == F.col("_pre"), "~": (F.col("parent") == F.col("_parent")) & (F.col("pre") > F.col("_pre"))}[sign]
            step = at.join(own, "page").where(place)
            at = step.select("page", "top", F.col("pre").alias("_pre"), F.col("post").alias("_post"), F.col("parent").alias("_parent")).distinct()
        found.append(at.select("page", "top", F.col("_pre").alias("pre"), F.col("_post").alias("post")))
    return reduce(DataFrame.unionByName, found).distinct()


def parsed_field(text: str) -> tuple[str, str, bool, bool]:
    """`selector@attribute` as selector, attribute, whether attribute=text is asked for, whether all matches are."""
    if " until " in text or text.startswith("**"):
        raise ValueError(f"{text!r} is no field of one element")
    path, _, attribute = text.lstrip("*").partition("@")
    return path.strip(), attribute.removesuffix("="), attribute.endswith("="), text.startswith("*")


def read(table: DataFrame, tops: DataFrame, fields: dict[str, str]) -> DataFrame:
    """page, top, f: the fields found inside each of tops (page, top, last), as a map of texts; the first match of each, or all of them, one a line.

    Fields whose selector is one step are tested on the rows inside the tops; only chains are joined step by step.
    """
    inside = tops.join(table, "page").where((F.col("pre") >= F.col("top")) & (F.col("pre") <= F.col("last")))
    direct, stepped = {}, []
    for name, (path, *_) in ((k, parsed_field(v)) for k, v in fields.items()):
        steps = chains(path) if path else []
        if path and (any(len(c) > 1 or c[0][1] for c in steps) or ":has(" in path):
            stepped.append(selected(table, tops, path).select("page", "top", "pre", F.lit(name).alias("name")))
        elif path:
            direct[name] = reduce(or_, (condition(c[0][0])[0] for c in steps)) & (F.col("pre") > F.col("top"))
        else:
            direct[name] = F.col("pre") == F.col("top")
    names = F.array_compact(F.array(*(F.when(test, name) for name, test in direct.items()))) if direct else F.array().cast("array<string>")
    met = inside.select("page", "top", "pre", F.explode(names).alias("name"))
    met = reduce(DataFrame.unionByName, stepped, met).distinct()

    ways = {name: parsed_field(text) for name, text in fields.items()}
    way = lambda k: F.create_map(*(x for name, w in ways.items() for x in (F.lit(name), F.lit(w[k]))))[F.col("name")]
    met = met.join(table.select("page", "pre", "post", "tag", "attrs"), ["page", "pre"]).withColumns({"attribute": way(1), "both": way(2), "every": way(3)})
    texts = table.where(F.col("tag").isin(TEXT, RAW)).select("page", F.col("pre").alias("_at"), F.col("tag").alias("_kind"), "text")
    wanted = met.where((F.col("attribute") == "") | F.col("both")).select("page", "pre", "post", "tag").distinct()
    kind = F.when(F.col("tag").isin(*CODE), RAW).otherwise(TEXT)
    said = wanted.join(texts, "page").where((F.col("_at") > F.col("pre")) & (F.col("_at") <= F.col("post")) & (F.col("_kind") == kind))
    said = said.groupBy("page", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), " ").alias("said"))
    said = said.withColumn("said", F.nullif(F.regexp_replace("said", r"^\s+|\s+$", ""), F.lit("")))
    own = F.col("attrs")[F.col("attribute")]
    value = F.when(F.col("both"), F.concat(F.coalesce(own, F.lit("")), F.lit("="), F.coalesce("said", F.lit("")))).when(F.col("attribute") != "", own).otherwise(F.col("said"))
    values = met.join(said, ["page", "pre"], "left").withColumn("value", value).where(F.col("value").isNotNull())
    one = values.groupBy("page", "top", "name").agg(
        F.min_by("value", "pre").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("every"), F.struct("pre", "value")))), lambda x: x["value"]), "\n").alias("all"), F.any_value("every").alias("every")
    )
    kept = one.withColumn("value", F.when(F.col("every"), F.nullif("all", F.lit(""))).otherwise(F.col("first"))).where(F.col("value").isNotNull())
    return kept.groupBy("page", "top").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("f"))


def extracted_cards(pages: DataFrame, card: str, fields: dict[str, str], page_fields: dict[str, str] | None = None) -> DataFrame:
    """pages (url, html) as url, pos, n, f, p: a row for each card, in document order, with its fields and those of its page.

    A page without cards gives one row with pos null. The element table is written once and read by every join.
    """
    table = written(elements(pages), "elements")
    roots = table.where("pre = 0").select("page", "url", F.col("pre").alias("top"), F.col("post").alias("last"))
    tops = written(selected(table, roots, card).select("page", F.col("pre").alias("top"), F.col("post").alias("last")), "cards")
    own = W.partitionBy("page").orderBy("top")
    placed = tops.withColumn("pos", (F.row_number().over(own) - 1).cast("int")).withColumn("n", F.count("*").over(W.partitionBy("page")).cast("int"))
    found = placed.join(read(table, tops, fields), ["page", "top"], "left") if fields else placed.withColumn("f", F.lit(None).cast("map<string,string>"))
    empty = F.create_map().cast("map<string,string>")
    whole = read(table, roots, page_fields).select("page", F.col("f").alias("p")) if page_fields else roots.select("page", empty.alias("p"))
    rows = roots.select("page", "url").join(found.select("page", "pos", "n", "f"), "page", "left").join(whole, "page", "left")
    return rows.select("url", "pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", empty).alias("f"), F.coalesce("p", empty).alias("p"))
