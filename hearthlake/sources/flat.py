"""Pages as flat lists of their elements, read from the tags in one pass; selectors are bits, looked up once for each different tag.

What selectors find follows from the kinds of a page's tags and their order alone. Pages of one template have the same
ones, so this order, and the places that were found in it, are remembered; texts and attributes are read on every page.

Only plain markup is read this way: anything that html.parser might read in its own way (stray signs,
comments, unmatched closing tags, references in attributes) makes `flat` give None, and the tree is built.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

from hearthlake.sources.html import SCOPES, SELF_CLOSING, VOID, Field, Selector, Simple

TAGS = re.compile(r"(<[^>]*>)")
OPENING = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][\w:.-]*(?:="[^"<&]*"|='[^'<&]*')?)*)\s*>""", re.ASCII)
CLOSING = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>", re.ASCII)
ATTRIBUTE = re.compile(r"""\s+([a-zA-Z][\w:.-]*)(?:="([^"]*)"|='([^']*)')?""", re.ASCII)
#: Elements whose text the parser reads in another way; scripts and styles are read here, the others by the parser.
CODE, SPECIAL = ("script", "style"), frozenset("title textarea xmp iframe noembed noframes noscript plaintext svg math".split())
#: Different tags that are remembered, and tags of remembered pages; beyond it the memory is emptied.
REMEMBERED, PLACES = 5_000, 100_000


class Tag:
    """A tag as an element that has no place yet; what selectors ask of an element."""

    __slots__ = ("attrs", "bits", "classes", "closing", "code", "kind", "mask", "tag", "void")

    def __init__(self, tag: str, attrs: dict[str, str], closing: bool):
        self.tag, self.attrs, self.closing = tag, attrs, closing
        self.classes = attrs["class"].split() if "class" in attrs else ()
        self.code, self.void, self.mask, self.bits, self.kind = tag in CODE, tag in VOID, 0, (), 0


class Compiled:
    """Selectors and fields as bits of their compound selectors."""

    def __init__(self) -> None:
        self.count = 0
        #: The compound selectors with their bits, by what a tag must have: its name, a class, an attribute, or nothing.
        self.tests: dict[tuple[str, str], list[tuple[int, Simple]]] = {}
        self.inner: dict[int, int] = {}
        self.seen: dict[str, Tag | None] = {}
        #: Attributes whose values some selector tests, by tag or for all, and what tags have that differ in others only: bits, mask and kind.
        self.tested: dict[str | None, set[str]] = {None: {"class"}}
        self.alike: dict[tuple, tuple] = {}
        self.kinds: dict[tuple, int] = {}
        self.shapes: dict[tuple[int, ...], Shape | None] = {}
        self.places = 0
        #: Places are remembered by the identity of these lists, so none may end before its memory.
        self.kept: list[list | tuple] = []

    def bit(self, simple: Simple) -> int:
        """The bit of a compound selector; what it asks of elements inside has a bit of its own."""
        bit = 1 << self.count
        self.count += 1
        bare = Simple.__new__(Simple)  # whatever stands inside the element
        bare.tag, bare.tests, bare.inside = simple.tag, simple.tests, None
        asked = ("tag", bare.tag) if bare.tag else ("", "")
        for cls, ident, name, _, _ in bare.tests[:1] if not bare.tag else ():
            asked = ("class", cls) if cls else ("has", "id" if ident else name)
        self.tests.setdefault(asked, []).append((bit, bare))
        self.tested.setdefault(bare.tag, set()).update("id" if ident else name for _, ident, name, sign, _ in bare.tests if ident or sign)
        if simple.inside is not None:
            self.inner[bit] = self.bit(simple.inside)
        return bit

    def selector(self, selector: Selector | None) -> list[list[tuple[int, str]]] | None:
        if selector is None:
            return None
        self.kept.append([[(self.bit(simple), sign) for simple, sign in chain] for chain in selector.chains])
        return self.kept[-1]

    def field(self, field: Field) -> tuple:
        self.kept.append((field, self.selector(field.selector), self.selector(field.stop)))
        return self.kept[-1]

    def fields(self, fields: dict[str, Field]) -> list[tuple]:
        """Fields with their names, as Flat.found reads them."""
        self.kept.append([(name, self.field(field)) for name, field in fields.items()])
        return self.kept[-1]

    def tag(self, token: str) -> Tag | None:
        """What a tag says; None if it is not plain."""
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        found = None
        if m := CLOSING.fullmatch(token):
            found = Tag(m[1].lower(), {}, True)
        elif m := OPENING.fullmatch(token):
            found = Tag(m[1].lower(), {k.lower(): a or b for k, a, b in ATTRIBUTE.findall(m[2])}, False)
        if found is not None and found.tag in SPECIAL:
            found = None
        if found is not None:
            every, own = self.tested[None], self.tested.get(found.tag, ())
            said = found.tag, found.closing, *[(k, v if k in every or k in own else None) for k, v in found.attrs.items()]
            known = self.alike.get(said)
            if known is None:
                if len(self.alike) >= REMEMBERED:
                    self.alike.clear()
                known = self.alike[said] = self.met(found)
            found.bits, found.mask, found.kind = known
        self.seen[token] = found
        return found

    def met(self, found: Tag) -> tuple[tuple[int, ...], int, int]:
        """The bits that a tag meets, together, and the number of its kind."""
        asked = {("", ""), ("tag", found.tag), *(("class", c) for c in found.classes), *(("has", a) for a in found.attrs)}
        bits = () if found.closing else tuple(sorted(bit for one in asked for bit, simple in self.tests.get(one, ()) if simple.meets(found)))
        return bits, sum(bits), self.kinds.setdefault((found.tag, found.closing, sum(bits)), len(self.kinds))


class Shape:
    """A page's elements without texts and attributes; memory is what was found in it."""

    __slots__ = ("begin", "codes", "end", "hits", "last", "memory", "opens", "parent")


class Flat:
    """tags, parent, last (the last element inside), texts and where each element's begin and end; hits are the elements that meet each bit."""

    __slots__ = ("begin", "code", "end", "hits", "inner", "last", "memory", "parent", "tags", "texts")

    def text(self, n: int) -> str | None:
        if self.tags[n].code:
            return " ".join(self.code.get(n, "").split()) or None
        a, b = self.begin[n], self.end[n]
        return " ".join((self.texts[a] if b - a == 1 else " ".join(self.texts[a:b])).split()) or None

    def meets(self, n: int, bit: int) -> bool:
        if not self.tags[n].mask & bit:
            return False
        inside = self.inner.get(bit)
        return inside is None or any(self.meets(k, inside) for k in self.between(n, inside))

    def between(self, n: int, bit: int) -> list[int]:
        """The elements below one that meet a bit, whatever stands inside them, in document order."""
        hits = self.hits.get(bit, ())
        return hits[bisect_right(hits, n) : bisect_right(hits, self.last[n])] if n and hits else hits

    def climbs(self, n: int, chain: list[tuple[int, str]], at: int, top: int) -> bool:
        bit, sign = chain[at]
        if not self.meets(n, bit):
            return False
        if at == 0:
            return sign != ">" or self.parent[n] == top
        parent = self.parent[n]
        if sign == "~":
            return any(self.climbs(k, chain, at - 1, top) for k in self.between(parent, chain[at - 1][0]) if k < n and self.parent[k] == parent)
        while parent > top:
            if self.climbs(parent, chain, at - 1, top):
                return True
            if sign == ">":
                return False
            parent = self.parent[parent]
        return False

    def all(self, chains: list, top: int) -> list[int]:
        key = id(chains), top
        if key not in self.memory:
            self.memory[key] = self.sought(chains, top)
        return self.memory[key]

    def sought(self, chains: list, top: int) -> list[int]:
        chains = [chain for chain in chains if all(bit in self.hits for bit, _ in chain)]
        if len(chains) == 1:
            chain = chains[0]
            return [n for n in self.between(top, chain[-1][0]) if self.climbs(n, chain, len(chain) - 1, top)]
        found = {n for chain in chains for n in self.between(top, chain[-1][0]) if self.climbs(n, chain, len(chain) - 1, top)}
        return sorted(found)

    def found(self, fields: list[tuple], top: int) -> list[tuple[str, str]]:
        """Names and texts of the fields that an element has; fields that no element meets are asked once."""
        key = id(fields), top
        if key not in self.memory:
            self.memory[key] = [(name, field) for name, field in fields if field[1] is None or self.all(field[1], top)]
        return [(name, text) for name, field in self.memory[key] if (text := self.read(field, top)) is not None]

    def places(self, compiled: tuple, top: int) -> list[int]:
        """The elements that a field may read; a stop that asks for a word is looked for on every page."""
        field, chains, stop = compiled
        found = [top] if chains is None else self.all(chains, top)
        if stop is not None and not field.word:
            end = next(iter(self.all(stop, top)), None)
            found = [n for n in found if end is None or n < end]
        return found

    def read(self, compiled: tuple, top: int) -> str | None:
        key = id(compiled), top
        found = self.memory.get(key)
        if found is None:
            found = self.memory[key] = self.places(compiled, top)
        field, _, stop = compiled
        if stop is not None and field.word:
            end = next((n for n in self.all(stop, top) if field.word in (self.text(n) or "").lower()), None)
            found = [n for n in found if end is None or n < end]
        if not field.every:
            for n in found:
                if (text := self.value(field, n)) is not None:
                    return text
            return None
        return field.between.join([text for n in found if (text := self.value(field, n)) is not None]) or None

    def value(self, field: Field, n: int) -> str | None:
        tag = self.tags[n]
        if field.both:
            return f"{tag.attrs.get(field.attribute, '')}={self.text(n) or ''}"
        if field.attribute:
            return tag.attrs.get(field.attribute)
        if tag.code:
            return self.code.get(n, "").strip() or None
        return self.text(n)


ROOT = Tag("#root", {}, False)


def flat(html: str, compiled: Compiled) -> Flat | None:
    """The elements of a page; None if its markup is not plain."""
    pieces = TAGS.split(html)
    tokens = pieces[1::2]
    if html.count("<") != len(tokens):
        return None
    if len(compiled.kinds) > REMEMBERED:
        compiled.seen.clear(), compiled.alike.clear(), compiled.kinds.clear(), compiled.shapes.clear()
        compiled.places = 0
    found = list(map(compiled.seen.get, tokens))
    if None in found:
        found = [tag or compiled.tag(token) for tag, token in zip(found, tokens, strict=True)]
        if None in found:
            return None
    key = tuple([tag.kind for tag in found])
    shape = compiled.shapes.get(key, ROOT)
    if shape is ROOT:  # not there; None stands for markup that is not plain
        if compiled.places > PLACES:
            compiled.shapes.clear()
            compiled.places = 0
        shape = compiled.shapes[key] = shaped(found)
        compiled.places += len(key) + 1
    if shape is None:
        return None
    page = Flat()
    texts, page.code = pieces[::2], {}
    for n, i in shape.codes:
        page.code[n], texts[i] = texts[i], ""
    tags = [ROOT]
    tags += [found[i] for i in shape.opens]
    page.texts = [unescape(t) if "&" in t else t for t in texts] if "&" in html else texts
    page.tags, page.parent, page.last, page.begin, page.end, page.hits, page.memory, page.inner = tags, shape.parent, shape.last, shape.begin, shape.end, shape.hits, shape.memory, compiled.inner
    return page


def shaped(found: list[Tag]) -> Shape | None:
    """Where the elements of a page begin and end, from its tags; None if its markup is not plain. Text i stands before tag i."""
    tags, parent, last, begin, end, codes, hits = [ROOT], [-1], [0], [0], [0], [], {}
    at, coded, total = 0, False, len(found) + 1
    for i, tag in enumerate(found):
        if coded:
            if not (tag.closing and tag.tag == tags[at].tag):
                return None
            codes.append((at, i))
        if tag.closing:
            coded, node, n = False, at, len(tags) - 1
            while node and tags[node].tag != tag.tag:
                node = parent[node]
            if not node:
                return None
            while at >= node and at:  # what is still open inside ends here, too
                last[at], end[at] = n, i + 1
                if at == node:
                    break
                at = parent[at]
            at = parent[node]
            continue
        under = at
        if tag.tag in SELF_CLOSING:
            seen, closes = at, SELF_CLOSING[tag.tag]
            while seen and tags[seen].tag not in SCOPES:
                if tags[seen].tag in closes:
                    under = parent[seen]
                seen = parent[seen]
            while at != under:
                last[at], end[at] = len(tags) - 1, i + 1
                at = parent[at]
        new = len(tags)
        tags.append(tag), parent.append(under), last.append(new), begin.append(i + 1), end.append(i + 1)
        for bit in tag.bits:
            hits.setdefault(bit, []).append(new)
        if not tag.void:
            at, coded = new, tag.code
    if coded:
        return None
    while at:
        last[at], end[at] = len(tags) - 1, total
        at = parent[at]
    last[0], end[0] = len(tags) - 1, total
    shape = Shape()
    shape.opens = [i for i, tag in enumerate(found) if not tag.closing]
    shape.parent, shape.last, shape.begin, shape.end, shape.codes, shape.hits, shape.memory = parent, last, begin, end, codes, hits, {}
    return shape
