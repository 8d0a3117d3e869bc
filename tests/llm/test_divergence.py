"""The divergence of sources, against SQL and against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from compare import assert_same

from codonflow.llm import divergence, queries

TOP = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    rows = [tuple("" if v is None else v for v in r) for r in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))) for text, lang, source in rows]
    docs, groups, out = defaultdict(Counter), defaultdict(dict), []
    for lang, source, w in words:
        docs[lang].update(set(w))
        groups[lang].setdefault(source, Counter()).update(w)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, ps = len(kept), {}
        whole = sum(sources.values(), Counter())
        for source, count in [*sources.items(), (None, whole)]:
            n = sum(count[t] for t in kept)
            ps[source] = {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}
        for source, count in sources.items():
            pairs = [(-sum(apart(ps[source][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != source]
            likelier = [(-apart(ps[source][t], ps[None][t]), t.encode(), t) for t in kept if count[t] and ps[source][t] > ps[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(likelier)[:top])):
                out += [(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


def diverging(df, **options):
    return sorted(tuple(r) for r in divergence.source_divergence(df, **options).collect())


def test_divergence_equals_sql(spark, duck):
    assert_same(queries.op13_source_divergence(spark, TOP), duck, queries.OP13_SQL)


@pytest.mark.parametrize("run_postings", [300_000, 50])
def test_divergence_equals_brute_force(spark, run_postings):
    """Runs of 50 postings spill many times; one source holds most documents, one no kept term."""
    rng = random.Random(3)
    words = ["the", "The", "café", "CAFÉ", "x1y", "日本", "o'clock", "a-b", "\x7fdel", "é", "Z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for _ in range(400):
        source = rng.choice(["hot", "hot", "hot", "b", "c", "d", None, "é"])
        low = {"b": 0, "c": 20, "d": 40}.get(source, 0)
        rows.append((" ".join(rng.choice(words[low:]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "en", "de", None]), source))
    rows += [("zz zz yy", "en", "lone"), ("", "en", "empty"), (None, "fr", "a"), ("one two", "fr", "b"), ("only", "xx", "single")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert diverging(df, run_postings=run_postings) == brute(rows)
    assert diverging(df, least_docs=3, top=4, run_postings=run_postings) == brute(rows, 3, 4)


def test_divergence_of_odd_rows(odd, none):
    clash = lambda df: df.selectExpr("*", "key AS lang", "1 AS term", "2 AS p", "3 AS v", "'r' AS rank", "4 AS value")
    rows = [(r["text"], r["key"], r["source"]) for r in odd.collect()]
    assert diverging(clash(odd)) == brute(rows) and diverging(clash(odd), least_docs=1) == brute(rows, 1)
    assert diverging(clash(none)) == []
