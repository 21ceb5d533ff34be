"""Pages read from their tags in one pass against the tree that html.parser gives: every selector and field of every portal, on its own markup and on shuffled markup."""

import random
import re

import pytest

from hearthlake.plans.detail_queries import PAGES
from hearthlake.plans.source_queries import CARDS
from hearthlake.sources.details import COMMON, DETAILS
from hearthlake.sources.flat import Compiled, flat
from hearthlake.sources.html import Field, Selector, parse
from hearthlake.sources.portals import PORTALS, cards


def filled(template: str, i: int) -> str:
    for k, v in {"id": i, "p": 1000 + i, "m2": 20 + i, "land": 400 + i, "place": "Village C"}.items():
        template = template.replace("{" + k + "}", str(v))
    return template


def shuffled(html: str, seed: int) -> str:
    """The pieces of a page with some left out, doubled or moved, so that elements nest in other ways."""
    draw = random.Random(seed)
    pieces = re.split(r"(<[^>]*>)", html)
    for _ in range(draw.randint(1, 8)):
        i, j = draw.randrange(len(pieces)), draw.randrange(len(pieces))
        pieces.insert(i, draw.choice([pieces[j], "<p>", "<li>", "<td>x", "<br>", "<ul>", "</div>", "<div>", " a&lt;b ", "</p>", "<tr>", "<!-- c -->", "<", "<img src='u'>", "<br/>", "<h2>similar</h2>", "<a title='x>y'>"]))
        if draw.random() < 0.5:
            del pieces[draw.randrange(len(pieces))]
    return "".join(pieces)


def agree(html: str, card: str | None, fields: dict[str, str], pairs: list) -> bool:
    """Whether the page was plain; what is read from it must be what the tree gives."""
    bits = Compiled()
    texts = list(fields.values()) + [x for _, label, value in pairs for x in (label, value)]
    compiled = [(t, Field(t), bits.field(Field(t))) for t in texts]
    boxes = [(s, bits.selector(Selector(s))) for s in ([card] if card else []) + [row for row, _, _ in pairs]]
    page = flat(html, bits)
    if page is None:
        return False
    root = parse(html)
    for selector, chains in [(None, None), *boxes]:
        mine = [0] if selector is None else page.all(chains, 0)
        tree = [root] if selector is None else list(Selector(selector).all(root))
        assert [page.text(n) for n in mine] == [n.text() for n in tree], (selector, html)
        for text, field, own in compiled:
            assert [page.read(own, n) for n in mine] == [field.read(n) for n in tree], (selector, text, html)
    return True


@pytest.mark.parametrize("source", sorted(PAGES))
def test_one_pass_gives_what_the_tree_gives(source):
    detail, portal = DETAILS[source], PORTALS[source]
    whole = "<html><body>" + filled(PAGES[source][1], 7) + "</body></html>"
    cards = '<html><body><div id="listings">' + "\n".join(filled(CARDS[source][0], i) for i in range(3)) + "</div></body></html>"
    assert agree(whole, None, COMMON | detail.fields, detail.pairs)
    assert agree(cards, portal.card, portal.fields | portal.page, [])
    plain = 0
    for seed in range(60):
        plain += agree(shuffled(whole, seed), None, COMMON | detail.fields, detail.pairs)
        plain += agree(shuffled(cards, seed), portal.card, portal.fields | portal.page, [])
    assert plain > 10


@pytest.mark.parametrize("html", ["<p>a<!-- c -->b", "a < b", "<a title='x>y'>z</a>", "<script>if (a<b) {}</script>", "</b>x", '<a href="?a=1&amp;b=2">x</a>', "<p>a</b>c</p>", "<title>a<b>c</title>", "<script>x", "<br/>"])
def test_other_markup_goes_to_the_parser(html):
    assert flat(html, Compiled()) is None


@pytest.mark.parametrize("source", sorted(PAGES))
def test_pages_of_one_template_share_their_places(source):
    """Places are found once for a template; texts, attributes, empty texts and where a search ends are each page's own."""
    detail, bits = DETAILS[source], Compiled()
    fields = {k: Field(v) for k, v in (COMMON | detail.fields | {"stopped": "*p, h2 until h2 with end"}).items()}
    compiled = bits.fields(fields)
    pages = ["<html><body>" + filled(PAGES[source][1], i) + f"<p>{'' if i % 2 else ' a &amp; b '}</p><h2>{'End' if i % 3 else 'more'}</h2><p>{i}</p><script>{i}</script></body></html>" for i in range(6)]
    read = [flat(html, bits).found(compiled, 0) for html in pages]
    assert len(bits.shapes) == 1
    assert read == [[(k, v) for k, field in fields.items() if (v := field.read(root)) is not None] for root in map(parse, pages)]


def test_cards_carry_no_copy_of_their_page(spark):
    """Listings need no text of the page around them: twenty cards held it twenty times."""
    pages = spark.createDataFrame([("u", '<body><div id="listings"><div><a href="/listings/a-b">x</a></div></div></body>')], "url string, html string")
    assert cards(pages, "akiyaportal").select("p").first()["p"] == {}
    assert cards(pages, "akiyaportal", PORTALS["akiyaportal"].page).select("p").first()["p"]["body"] == "x"


def test_tags_that_differ_in_values_nobody_tests_are_matched_once():
    """Addresses differ on every page; each was matched against all selectors again."""
    bits = Compiled()
    fields = bits.fields({"pictures": Field("*img[src]@src"), "map": Field("iframe[src*=maps]@src"), "chosen": Field("*a[href*=x]@href"), "named": Field("#n7")})
    met, real = [], bits.met
    bits.met = lambda tag: met.append(tag) or real(tag)
    for i in range(50):
        html = f'<div id="n{i}">t{i}</div><img src="/{i}.jpg"><iframe2 src="maps{i}"></iframe2><a href="/{"x" if i % 2 else "y"}{i}">l</a>'
        page = flat(html, bits)
        wanted = {k: v for k, f in (("pictures", "*img[src]@src"), ("map", "iframe[src*=maps]@src"), ("chosen", "*a[href*=x]@href"), ("named", "#n7")) if (v := Field(f).read(parse(html))) is not None}
        assert dict(page.found(fields, 0)) == wanted
    assert sum(tag.tag == "img" for tag in met) == 1 and sum(tag.tag == "a" for tag in met) == 51
