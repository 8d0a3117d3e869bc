"""The n-gram join and the repeated passages, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from compare import assert_same

from codonflow.llm import minhash, ngram_join, queries, suffix_dedup
from codonflow.llm.components import components

TOP = "/root/testdata/sf0.001"


def brute_components(rows, words, percent, lower):
    sets = []
    for _, text in rows:
        w = ((text or "").encode().lower() if lower else (text or "").encode()).split()
        sets.append(set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near(df, **options):
    return sorted((tuple(r) for r in ngram_join.near_duplicates(df, **options).collect()), key=str)


def family(rng, n, base_words, edits, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_join_equals_sql(spark, duck):
    assert_same(queries.op3_ngram_join(spark, TOP), duck, queries.OP3_SQL)


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (2, 60)])
def test_join_equals_brute_force_near_the_threshold(spark, words, percent):
    rng = random.Random(percent)
    texts = family(rng, 40, 150, 6) + family(rng, 30, 24, 2) + family(rng, 20, 14, 1) + family(rng, 25, 12, 3, 6) + family(rng, 15, 3, 1, 4)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, words=words, percent=percent) == brute_components(rows, words, percent, True)


def test_light_sets_alone_and_lists_alone_agree(spark, monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 30, 22, 2) + family(rng, 30, 16, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expect = brute_components(rows, 3, 90, True)
    for x in (0, 14, 40):
        monkeypatch.setattr(ngram_join, "boundary", lambda *a, x=x: x)
        assert near(df, words=3, percent=90) == expect


def test_long_lists_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = list(enumerate(family(rng, 60, 120, 5)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = ngram_join._list_pairs
    monkeypatch.setattr(ngram_join, "_list_pairs", lambda *a: whole(*a, block=16))
    assert near(df, words=3, percent=90) == brute_components(rows, 3, 90, True)


def test_join_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert near(odd, words=3, percent=90) == brute_components(rows, 3, 90, True)
    assert near(odd, words=3, percent=90, lower=False) == brute_components(rows, 3, 90, False)
    assert near(none) == []
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, None} and ngram_join.drop_near_duplicates(none).count() == 0


def test_sets_whose_ids_agree_in_their_low_bits_are_linked(spark):
    """Two linked sets that meet nobody else, with ids equal in the low 16 bits."""
    words, seen, pair = [f"w{i}" for i in range(60)], {}, None
    for i in range(5000):
        text = " ".join([*words[:-1], f"x{i}"])
        low = ngram_join.set_id(ngram_join.gram_set(text, 3, True)) & 0xFFFF
        if low in seen:
            pair = (seen[low], text)
            break
        seen[low] = text
    df = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert [r[2] for r in near(df, words=3, percent=90)] == [0, 0]


def test_recall_on_many_linked_pairs(spark):
    """Families far apart from one another; within one, all pairs are looked at by brute force."""
    rng, rows, want, pairs = random.Random(8), [], [], 0
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(60)]
        texts = []
        for _ in range(90):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own))
        family_rows = [(len(rows) + i, t) for i, t in enumerate(texts)]
        sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for t in texts]
        pairs += sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        want += brute_components(family_rows, 3, 80, True)
        rows += family_rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs > 100_000
    assert near(df, words=3, percent=80) == sorted(want, key=str) == minmax(df, words=3, percent=80)


def minmax(df, **options):
    out = minhash.minmax_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted((tuple(r)[:3] for r in out), key=str)


def test_minmax_equals_sql(spark, duck):
    assert_same(queries.op11_minmax_dedup(spark, TOP), duck, queries.OP11_SQL)


@pytest.mark.parametrize("words", [4, 1])
def test_minmax_equals_brute_force_near_the_threshold(spark, words):
    rng = random.Random(words)
    texts = family(rng, 40, 150, 12) + family(rng, 30, 24, 3) + family(rng, 20, 14, 2) + family(rng, 25, 12, 3, 6) + family(rng, 15, 3, 1, 4)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert minmax(df, words=words, percent=80) == brute_components(rows, words, 80, True)


def test_minmax_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert minmax(odd, words=4, percent=80) == brute_components(rows, 4, 80, True)
    assert minmax(none) == []


def test_both_ends_of_a_permutation_estimate_similarity():
    """Minima and maxima of 256 permutations are as good as 512 minima, and hardly depend on one another."""
    rng = np.random.default_rng(5)
    a, c = minhash.permutations(256)
    by_two, by_min = [], []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        same = minhash.signature(x[:110], a, c) == minhash.signature(x[10:], a, c)
        by_two.append(same.mean())
        by_min.append(same[:, 0].mean())
    want = 100 / 120
    assert abs(np.mean(by_two) - want) < 0.01 and np.var(by_two) < 0.7 * np.var(by_min)
    assert not minhash.signature(x, a, c).tobytes() == minhash.signature(x[1:], a, c).tobytes()


def test_subset_sizes_and_boundary():
    assert ngram_join.overlap(10, 9, 90) == 9 and ngram_join.overlap(20, 20, 90) == 19 and ngram_join.prefix_length(10, 90, 1) == 2
    assert list(ngram_join.partners(10, 90)) == [9, 10, 11]
    assert ngram_join.boundary({12: 5, 30: 5}, {12: 10**6, 30: 10**6}, 90) == 30 > ngram_join.boundary({12: 5, 30: 5}, {12: 40, 30: 40}, 90) == 0


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 97])
def test_linked_sets_share_a_list(percent):
    """Prefixes are long enough for every partner, and random linked sets have a key in common."""
    chain, rng = ngram_join.chain_length(percent), random.Random(percent)
    for n in range(1, 300):
        need = [chain + (chain - 1) * (n + b - 2 * c) + n - c for b in ngram_join.partners(n, percent) for c in [ngram_join.overlap(n, b, percent)]]
        assert ngram_join.prefix_length(n, percent, chain) == (0 if ngram_join.alone(n, percent) else min(n, max(need)))
    rarity = np.array([rng.randrange(8) for _ in range(1 << ngram_join.COUNT_BITS)], dtype=np.uint64)
    for _ in range(2000):
        a = rng.randint(1, 80)
        b = rng.choice(ngram_join.partners(a, percent))
        common = ngram_join.overlap(a, b, percent)
        if ngram_join.alone(a, percent) or common > min(a, b):
            continue
        pool = np.array(rng.sample(range(1 << 62), a + b - common), dtype=np.uint64) * ngram_join.K1
        keys = [ngram_join.list_keys(np.sort(x), rarity, percent, chain) for x in (pool[:a], np.concatenate([pool[:common], pool[a:]]))]
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_subsets_make_links_at_the_boundary_that_cost_chooses(spark, monkeypatch):
    rng = random.Random(3)
    rows = list(enumerate(text for base in range(12) for text in family(rng, 12, 16, 1, 30)))
    whole, chosen, made = ngram_join._subset_links, [], []
    real = ngram_join.boundary
    monkeypatch.setattr(ngram_join, "boundary", lambda *a: chosen.append(real(*a)) or chosen[-1])

    def counted(light, percent):
        out = whole(light, percent)
        made.append(out.filter("a != b").count())
        return out

    monkeypatch.setattr(ngram_join, "_subset_links", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, words=1, percent=90) == brute_components(rows, 1, 90, True)
    assert chosen[0] >= 10 and made[0] > 0, (chosen, made)


def test_link_that_ranks_behind_nearer_looking_pairs(spark):
    """x and y are linked, and each has four partners just below the threshold."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(44)]
    change = lambda words, places: [f"n{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]
    x, y = base, change(base, {43})
    texts = [x, y, *(change(x, {0, 43 - k}) for k in range(4)), *(change(y, {1, 20 + k}) for k in range(4))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, words=3, percent=90) == brute_components(rows, 3, 90, True)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200 + i, 200 + i // 2) for i in range(1, 60)] + [(7, 7)]
    links = [rng.choice([(a, b), (b, a)]) for a, b in links]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(200, 260), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length):
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc, t in rows:
        kept, spans, end, last = bytearray(), 0, 0, False
        for p in range(len(t)):
            if p + length <= len(t) and count[t[p : p + length]] > 1:
                end = p + length
            spans += p < end and not last
            last = p < end
            if not last:
                kept.append(t[p])
        out.append((doc, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(df, **options):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, **options).select(*cols).collect()), key=str)


def test_repeats_of_documents(docs, small):
    assert repeats(docs) == brute_repeats([(i, t.encode()) for i, t in small], 400)


@pytest.mark.parametrize("hot", [1 << 24, 1])
def test_repeats_with_shared_passages(spark, hot):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(n) for n in (129, 150, 400)]
    texts = [make(rng.randint(0, 90)) + rng.choice(passages) + make(rng.randint(0, 90)) + rng.choice(passages)[: rng.randint(60, 400)] for _ in range(40)]
    texts += ["x" * 500, "xy" * 100, passages[0], passages[0], "z" * 128, "z" * 128, "short", ""]
    rows = list(enumerate(texts))
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=128, hot=hot)
    assert got == brute_repeats([(i, t.encode()) for i, t in rows], 128)


@pytest.mark.parametrize("hot", [1 << 24, 1])
def test_repeats_in_periodic_text(spark, hot):
    rng = random.Random(5)
    noise = "".join(rng.choice("abcdefgh") for _ in range(300))
    texts = ["a" * 3000, noise + "xyz" * 900, "b" * 128, "b" * 129, noise[:100] + "xyz" * 60 + noise, "".join(rng.choice("ab") for _ in range(100)) * 5, ("p" * 90 + "q" * 90) * 6]
    rows = list(enumerate(texts))
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=128, hot=hot)
    assert got == brute_repeats([(i, t.encode()) for i, t in rows], 128)


def test_a_megabyte_of_one_character(spark):
    df = spark.createDataFrame([(1, "a" * 1_000_000), (2, "ab" * 500)], "doc_id long, text string")
    gram, first, n, own = suffix_dedup.anchors(np.full(3_000_000, 97, dtype=np.uint8), 400)
    assert len(gram) == len(set(zip(gram, first, strict=True))) < 800 and int(n.sum()) == 3_000_000 - 399 and own.sum() >= len(own) - 3
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["trimmed"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: (1_000_000, 1, True), 2: (1000, 1, True)}


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 123, 9000), np.full(9000, 97), np.tile([97, 98, 99], 700), rng.integers(97, 100, 500)]).astype(np.uint8)
    for chunk in (1 << 20, 1000):
        suffix_dedup.CHUNK, before = chunk, suffix_dedup.CHUNK
        gram, first, n, _ = suffix_dedup.anchors(data, 400)
        suffix_dedup.CHUNK = before
        assert (first == np.concatenate([[0], np.cumsum(n)[:-1]])).all() and first[-1] + n[-1] == len(data) - 399 and n.max() <= suffix_dedup.RECORD
        least = np.lib.stride_tricks.sliding_window_view(suffix_dedup.rolling(data, 64) >> suffix_dedup.POSITION_BITS, 337).min(1)
        assert (np.repeat(gram.view(np.uint64) >> suffix_dedup.POSITION_BITS, n) == least).all()


@pytest.mark.parametrize("hot", [1 << 24, 1])
def test_words_in_repeated_passages(spark, hot):
    """Passages of 51 words and more are counted, however short the words are and whatever white space is between them."""
    rng = random.Random(13)
    make = lambda n: [rng.choice(["a", "be", "sea", "deed", f"w{rng.randrange(99)}"]) for _ in range(n)]
    passages = [make(n) for n in (50, 51, 60, 120)]
    texts = [make(rng.randint(0, 40)) + rng.choice(passages) + make(rng.randint(0, 40)) for _ in range(30)] + [["x"] * 200, passages[1], passages[1], passages[0], []]
    texts = [rng.choice([" ", "\n", "  "]).join(t) for t in texts]
    count = Counter(tuple(t.split()[i : i + 51]) for t in texts for i in range(len(t.split()) - 50))
    want = {}
    for k, t in enumerate(texts):
        w = t.split()
        want[k] = len({j for i in range(len(w) - 50) if count[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_passage_words"] for r in suffix_dedup.remove_repeats(df, passage_words=51, hot=hot).collect()}
    assert got == want and 0 in want.values() and len(set(want.values())) > 5


def test_repeats_of_odd_rows(odd, none):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    out = suffix_dedup.remove_repeats(odd, with_text=True).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out), key=str) == brute_repeats(rows, 400)
    assert repeats(none) == [] and suffix_dedup.remove_repeats(none, passage_words=51).count() == 0
    assert {r["doc_id"]: r["n_passage_words"] for r in suffix_dedup.remove_repeats(odd, passage_words=51).collect() if r["doc_id"] in (1, 6, 7)} == {1: 0, 6: 12_000, 7: 12_000}


@pytest.mark.parametrize("mask", [0, 3])
def test_equal_groups_are_told_by_content(monkeypatch, mask):
    """With hashes that hardly tell anything apart, groups still hold equal windows only."""
    rng, good = np.random.default_rng(8), suffix_dedup.rolling
    monkeypatch.setattr(suffix_dedup, "rolling", lambda data, width: good(data, width) & np.uint64(mask))
    passage = rng.integers(97, 99, 300)
    data = np.concatenate([np.full(200, 97), passage, rng.integers(97, 99, 50), np.append(passage[:299], 99), passage[20:290], np.tile([97, 97, 98], 90)]).astype(np.uint8)
    for items in (data, data.astype(np.uint64)):
        starts = np.arange(len(items) - 128 + 1)
        group = items[starts] % 2
        count = Counter(items[at : at + 128].tobytes() for at in starts)
        want = [count[items[at : at + 128].tobytes()] > 1 for at in starts]
        assert suffix_dedup.repeated(items, starts, group.astype(np.int64), 128).tolist() == want and 0 < sum(want) < len(want)
    assert suffix_dedup.repeated(data, starts[:0], group[:0].astype(np.int64), 128).tolist() == []


def test_rolling_hashes_depend_on_content_only():
    data = np.frombuffer(b"abcdefgh" * 60, dtype=np.uint8)
    for width in (1, 7, 64, 200, 400):
        h = suffix_dedup.rolling(data, width)
        assert len(h) == len(data) - width + 1 and (h[8:] == h[:-8]).all()
        assert len(set(h.tolist())) == 8 or width == 1
