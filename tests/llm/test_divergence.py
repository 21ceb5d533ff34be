import random
import re
from collections import Counter, defaultdict

from hearthlake.llm.divergence import source_divergence, term_counts
from tests.llm.helpers import EDGES, clashing_docs, edge_docs, no_docs, rows


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, least_docs, top=50):
    """docs: (lang, source, text)."""
    docs = [(lang or "", source or "", terms(text)) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least_docs)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if w in set(kept))
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = share(total)
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            marks = sorted(((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]))[:top]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(marks, 1)]
    return sorted(out, key=repr)


def some_docs(rng, n):
    words = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "ß", "日本", "Ab", "aB"]
    return [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None]), " ".join(rng.choices(words, k=rng.randrange(0, 60))) + rng.choice(["", "-x.Y_z", "12ab"])) for _ in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    docs = some_docs(rng, 300)
    table = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    for least_docs, top in ((1, 5), (8, 50), (1000, 50)):
        assert rows(source_divergence(table, least_docs, top)) == brute(docs, least_docs, top)


def test_counts_are_the_same_however_few_terms_are_held(spark):
    docs = [("en", "a", "one two " * 40 + "Two"), ("en", "a", None), ("de", "b", "x")]
    table = spark.createDataFrame(docs, "lang string, source string, text string").coalesce(1)
    wanted = [("de", "b", "x", 1, 1), ("en", "a", "one", 40, 1), ("en", "a", "two", 41, 1)]
    for held, block in ((1000, 1 << 20), (1, 16), (1000, 64)):
        found = term_counts(table, held, block).groupBy("lang", "source", "term").sum("n", "docs").where("term is not null")
        assert rows(found) == wanted


def test_edges(spark):
    wanted = brute([(lang, source, text) for _, text, lang, source in EDGES], 2)
    assert rows(source_divergence(edge_docs(spark), 2)) == wanted == rows(source_divergence(clashing_docs(spark), 2))
    assert source_divergence(no_docs(spark)).count() == 0
