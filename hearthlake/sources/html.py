"""Raw pages to named text fields: a small selector over parsed HTML, run by Spark on every page where it lies.

Only what a selector finds leaves the Python step, as a map of strings; every rule about numbers,
prices, places and addresses is a column expression on top of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, chain as chained

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that an opening tag of the same kind closes.
SELF_CLOSING = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPES = frozenset("table ul ol dl div section article body html select".split())
SIMPLE = re.compile(r"([a-zA-Z0-9]+|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)(?::has\(([^)]*)\))?$")
PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


class Node:
    __slots__ = ("attrs", "below", "children", "classes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = attrs["class"].split() if "class" in attrs else ()
        self.below: list[Node] | None = None

    def walk(self) -> list[Node]:
        """All elements below, in document order; listed once, after the page is read."""
        if self.below is None:
            found, waiting = [], [c for c in reversed(self.children) if isinstance(c, Node)]
            while waiting:
                node = waiting.pop()
                found.append(node)
                waiting += [c for c in reversed(node.children) if isinstance(c, Node)]
            self.below = found
        return self.below

    def raw(self) -> str:
        parts, waiting = [], list(reversed(self.children))
        while waiting:
            item = waiting.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag not in ("script", "style"):
                waiting += [" ", *reversed(item.children), " "]
        return "".join(parts)

    def text(self) -> str | None:
        """Text with white space collapsed; None if there is none."""
        return " ".join(self.raw().split()) or None


class Builder(HTMLParser):
    """Tolerant tree builder: unknown closing tags are skipped, open ones end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self.at
        if tag in SELF_CLOSING:
            seen = node
            while seen.parent is not None and seen.tag not in SCOPES:
                if seen.tag in SELF_CLOSING[tag]:
                    node = seen.parent
                seen = seen.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, node)
        node.children.append(new)
        self.at = node if tag in VOID else new

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


class Simple:
    """One compound selector: tag, classes, id, attributes, and :has(compound selector of something inside)."""

    def __init__(self, text: str):
        m = SIMPLE.match(text)
        if m is None:
            raise ValueError(f"cannot read the selector {text!r}")
        self.tag = m[1] if m[1] not in (None, "*") else None
        self.tests = PART.findall(m[2])
        self.inside = Simple(m[3]) if m[3] else None

    def meets(self, node: Node) -> bool:
        if self.tag is not None and node.tag != self.tag:
            return False
        for cls, ident, name, sign, value in self.tests:
            if cls:
                if cls not in node.classes:
                    return False
            elif ident:
                if node.attrs.get("id") != ident:
                    return False
            else:
                have = node.attrs.get(name)
                if have is None or sign == "=" and have != value or sign == "*=" and value not in have or sign == "^=" and not have.startswith(value) or sign == "$=" and not have.endswith(value):
                    return False
        return self.inside is None or any(map(self.inside.meets, node.walk()))


class Selector:
    """Alternatives of compound selectors joined by spaces (inside), > (directly inside) or ~ (after, inside the same element)."""

    def __init__(self, text: str):
        self.chains = []
        for alternative in re.split(r",(?![^\[]*\])", text):
            words = re.findall(r"[>~](?=\s|$)|(?:[^\s>\[]|\[[^\]]*\])+", alternative)
            chain, sign = [], ""
            for word in words:
                if word in (">", "~"):
                    sign = word
                else:
                    chain.append((Simple(word), sign))
                    sign = ""
            self.chains.append(chain)

    def meets(self, node: Node, top: Node) -> bool:
        return any(self.climbs(node, chain, len(chain) - 1, top) for chain in self.chains)

    def climbs(self, node: Node, chain: list, at: int, top: Node) -> bool:
        simple, sign = chain[at]
        if not simple.meets(node):
            return False
        if at == 0:
            return sign != ">" or node.parent is top
        if sign == "~":
            beside = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else [node]
            return any(self.climbs(c, chain, at - 1, top) for c in beside[: next(i for i, c in enumerate(beside) if c is node)])
        parent = node.parent
        while parent is not None and parent is not top:
            if self.climbs(parent, chain, at - 1, top):
                return True
            if sign == ">":
                return False
            parent = parent.parent
        return False

    def all(self, top: Node) -> Iterator[Node]:
        return (n for n in top.walk() if self.meets(n, top))

    def first(self, top: Node) -> Node | None:
        return next(self.all(top), None)


#: Pages whose rows are made at once.
PAGES_AT_ONCE = 200
#: Stands between the matches of a ** field.
RECORD = "\x1e"


class Field:
    """`selector`, `selector@attribute`, `@attribute` of the element itself; `@attribute=` gives attribute=text; * before it gives all matches, one a line.

    ** before it joins all matches by RECORD instead. ` until selector` after it ends the search at the
    first such element in document order, ` until selector with word` at the first whose text has the word.
    """

    def __init__(self, text: str):
        text, _, stop = text.partition(" until ")
        stop, _, self.word = stop.partition(" with ")
        self.stop = Selector(stop) if stop else None
        self.every, self.between = text.startswith("*"), RECORD if text.startswith("**") else "\n"
        path, _, attribute = text.lstrip("*").partition("@")
        self.attribute, self.both = attribute.removesuffix("="), attribute.endswith("=")
        self.selector = Selector(path) if path.strip() else None

    def read(self, top: Node) -> str | None:
        found = [top] if self.selector is None else self.selector.all(top) if self.stop is None else self.before(top)
        values = (self.value(n) for n in found)
        kept = (v for v in values if v is not None)
        return (self.between.join(kept) or None) if self.every else next(kept, None)

    def before(self, top: Node) -> Iterator[Node]:
        for node in top.walk():
            if self.stop.meets(node, top) and self.word in (node.text() or "").lower():
                return
            if self.selector.meets(node, top):
                yield node

    def value(self, node: Node) -> str | None:
        if self.both:
            return f"{node.attrs.get(self.attribute, '')}={node.text() or ''}"
        if self.attribute:
            return node.attrs.get(self.attribute)
        if node.tag in ("script", "style"):
            return "".join(c for c in node.children if isinstance(c, str)).strip() or None
        return node.text()


def text_maps(rows: list[list[tuple[str, str]]]) -> pa.Array:
    """Lists of names and texts as one column of maps; from two flat lists, since arrow takes pairs apart slowly."""
    pairs = list(chained.from_iterable(rows))
    keys, values = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.MapArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def extracted(pages: DataFrame, card: str | None, fields: dict[str, str], page_fields: dict[str, str] | None = None, pairs: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """pages (url, html) as url, pos, n, f, p, facts: one row for each card, or one for each page without a card selector.

    f has the card's fields, p those of the page, facts the label and value texts of the rows that
    pairs names (row, label, value selectors; without a value element the rest of the row's text counts),
    labels lower-cased without colons, later rows winning.
    A page without cards gives one row with pos null. Null pages give nothing to find.
    """
    from hearthlake.sources.flat import Compiled, Flat, flat  # it stands on the selectors of this module

    rows = {k: Field(v) for k, v in fields.items()}
    whole = {k: Field(v) for k, v in (page_fields or {}).items()}
    boxes = Selector(card) if card else None
    tables = [(Selector(r), Field(a), Field(b)) for r, a, b in pairs or []]
    text_map = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("url", pa.string()), ("pos", pa.int32()), ("n", pa.int32()), ("f", text_map), ("p", text_map), ("facts", text_map)])
    outer = re.compile(r"^[ :]+|[ :]+$")

    tidied: dict[str, str] = {}

    def tidy(key: str) -> str:
        if key not in tidied:
            if len(tidied) >= 5_000:  # pages repeat their labels, but need not
                tidied.clear()
            tidied[key] = outer.sub("", key).lower()
        return tidied[key]

    def fact(key: str | None, found: str | None, said) -> tuple[str, str] | None:
        if key and not found:  # the value is what the row says after its label
            found = (said() or "").removeprefix(key).strip(" :")
        return (tidy(key), found) if key and found else None

    def by_tree(html: str) -> tuple[list, list, dict]:
        """The cards' fields, the page's, and its facts, from the tree of the page."""
        root = parse(html)
        read = lambda fields, top: [(k, v) for k, field in fields.items() if (v := field.read(top)) is not None]
        facts = dict(x for row, label, value in tables for n in row.all(root) if (x := fact(label.read(n), value.read(n), n.text)))
        return [read(rows, n) for n in (boxes.all(root) if boxes else [root])], read(whole, root), facts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Compiled()
        flat_rows, flat_whole = bits.fields(rows), bits.fields(whole)
        flat_boxes, flat_tables = bits.selector(boxes), [(bits.selector(r), bits.field(a), bits.field(b)) for r, a, b in tables]

        def by_tags(page: Flat) -> tuple[list, list, dict]:
            facts = dict(x for row, label, value in flat_tables for n in page.all(row, 0) if (x := fact(page.read(label, n), page.read(value, n), lambda n=n: page.text(n))))
            return [page.found(flat_rows, n) for n in (page.all(flat_boxes, 0) if boxes else [0])], page.found(flat_whole, 0), facts

        for batch in batches:
            # A batch's pages are many: rows leave as soon as there are some, so that a task holds few.
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(start, PAGES_AT_ONCE)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for url, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    page = flat(html or "", bits)
                    cards, own, facts = by_tree(html or "") if page is None else by_tags(page)
                    facts = list(facts.items())
                    for pos, found in enumerate(cards or [[]]):
                        for column, value in zip(out, (url, pos if cards else None, len(cards), found, own, facts), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:3], schema.types[:3], strict=True)] + [text_maps(c) for c in out[3:]], schema=schema)

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "url string, pos int, n int, f map<string,string>, p map<string,string>, facts map<string,string>")
