"""The rounds of the n-gram join after the first comparison in each list."""

import random

from test_repeats import brute_components, near

from codonflow.llm import ngram_join


def test_full_round_runs_while_lists_hold_several_components(spark, monkeypatch):
    """A round of nearest members that offers nothing does not end the search."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"n{rng.randrange(10**9)}" if i in cut else w for i, w in enumerate(base)) for cut in (set(range(0, 150, 30)) if k % 2 else {7 * k} for k in range(12))]
    rows = list(enumerate(texts))
    whole, asked = ngram_join._list_pairs, []

    def offered(postings, percent, light, nearest):
        asked.append(nearest)
        found = whole(postings, percent, light, nearest)
        return found if nearest is None else found.limit(0)

    monkeypatch.setattr(ngram_join, "_list_pairs", offered)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, words=3, percent=90) == brute_components(rows, 3, 90, True)
    assert asked == [4, None]


def test_pair_comes_out_of_few_of_its_lists(spark):
    """Members just too different to be linked share hundreds of lists; a pair does not come out of each of them."""
    rng = random.Random(5)
    members, tokens = range(1, 31), [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    held = {t: [r for r in members if rng.random() < 0.9] for t in tokens}
    rows = [(t, len(held[t]), 100, r, r, bytes(32)) for t in tokens for r in held[t]]
    opened = spark.createDataFrame(rows, "token long, members long, n int, rid long, comp long, sketch binary")
    expect = {(a, b) for own in held.values() for a in own for b in own if a < b}
    for nearest in (None, 4):
        found = ngram_join._meetings(ngram_join._with_lists(opened, False), 80, 0, nearest).collect()
        pairs = {(r["a"], r["b"]) for r in found}
        assert pairs == expect if nearest is None else pairs <= expect
        assert len(found) <= 2 * len(expect), len(found)  # without the names of lists 104,000
