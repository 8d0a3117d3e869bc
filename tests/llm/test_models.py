"""Classifiers, tokens, search, archives and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import assert_same
from pyspark.sql import functions as F

from codonflow.llm import bpe, quality, queries, topk, toxicity, warc

TOP = "/root/testdata/sf0.001"


def held_out(spark, module, column, folds, held):
    top = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet")
    out = module.classify(d, labels)
    rows = out.join(labels.select("doc_id", column), "doc_id").collect()
    assert out.count() == d.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    return [r for r in rows if r["held_out"]]


def test_quality_on_held_out_labels(spark):
    rows = held_out(spark, quality, "quality", 3, 1)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.98


def test_toxicity_on_held_out_labels(spark):
    rows = held_out(spark, toxicity, "toxic", 5, 0)
    bad, good = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([s >= 0.5 for s in bad]) > 0.75 and np.mean([s >= 0.5 for s in good]) < 0.01


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, odd, none, module, column):
    schema = f"doc_id long, {column} int"
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (6, 1), (7, 1), (None, 1), (8, None)], schema)
    for labels in (some, some.filter(f"{column} = 1"), some.limit(0)):
        rows = module.classify(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.classify(none, labels).count() == 0
    if module is quality:
        kept = quality.keep_good(odd, some)
        assert kept.columns == odd.columns and quality.keep_good(none, some).count() == 0


def plain_quality(model, text):
    """The additive model's score, feature by feature and bin by bin."""
    x = quality.features(text)
    at = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
    margin = model.intercept + sum(t[i] for t, i in zip(model.tables, at, strict=True)) + sum(t[at[i]][at[j]] for (i, j), t in model.pairs.items())
    return 1 / (1 + np.exp(-margin))


def test_op9_query_against_brute_force(spark):
    d, labels = spark.read.parquet(f"{TOP}/documents.parquet"), spark.read.parquet(f"{TOP}/labels.parquet")
    learnt = {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    model = quality.train(d, labels.filter(labels["doc_id"].isin(learnt)))
    text = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    rows = queries.op9_quality(spark, TOP).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        assert r["score"] == pytest.approx(plain_quality(model, text[r["doc_id"]]), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def plain_cells(text):
    """Hashed features written out one by one."""
    from xxhash import xxh3_64_intdigest

    mask, mix, words = (1 << 64) - 1, [int(m) for m in toxicity.MIX], text.lower().split()
    h = lambda s: xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    bare = [w.strip(toxicity.EDGES) or w for w in words]
    codes = [h(b) * mix[0] for b in bare] + [h(f"{b[:k]}~") * mix[0] for b in bare for k in (3, 4, 5, 7)]
    codes += [(h(a) * mix[0] & mask) ^ ((h(b) * mix[k] & mask) * mix[1] & mask) for k in (1, 2, 3) for a, b in zip(bare, bare[k:], strict=False)]
    return {((((c & mask) ^ ((c & mask) >> 29)) * mix[2]) & mask) >> (64 - toxicity.BITS) for c in codes}


def plain_toxicity(weights, text):
    """The logistic score over such features."""
    margin = sum(weights.get(c, 0.0) for c in plain_cells(text)) + weights.get(1 << toxicity.BITS, 0.0)
    return 1 / (1 + np.exp(-max(-35, min(35, margin))))


def plain_ftrl(rows, alpha=1.0, beta=1.0, l1=3.0, l2=1.0):
    """FTRL-proximal, coordinate by coordinate; nonzero weights."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for text, y in rows:
        cells = [*plain_cells(text), 1 << toxicity.BITS]
        w = [weight(i) for i in cells]
        g = 1 / (1 + math.exp(-max(-35, min(35, sum(w))))) - y
        for i, x in zip(cells, w, strict=True):
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * x
            n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_training_equals_plain_ftrl(spark):
    d, labels = spark.read.parquet(f"{TOP}/documents.parquet"), spark.read.parquet(f"{TOP}/labels.parquet")
    order = labels.join(d, "doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "toxic").select("text", "toxic")
    want = plain_ftrl([(r["text"] or "", r["toxic"]) for r in order.collect()], l1=0.5)
    got = dict(zip(*(x.tolist() for x in toxicity.train(d, labels, shards=1, rounds=1, l1=0.5)), strict=True))
    assert len(want) > 100
    for i in want.keys() | got.keys():
        assert got.get(i, 0.0) == pytest.approx(want.get(i, 0.0), abs=1e-5)


def test_op4_query_against_brute_force(spark):
    d, labels = spark.read.parquet(f"{TOP}/documents.parquet"), spark.read.parquet(f"{TOP}/labels.parquet")
    learnt = {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0}
    at, w = toxicity.train(d, labels.filter(labels["doc_id"].isin(learnt)))
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    text = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    rows = queries.op4_toxicity(spark, TOP).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        assert r["score"] == pytest.approx(plain_toxicity(weights, text[r["doc_id"]]), abs=1e-9)


def test_weights_are_sparse(spark):
    top = "/root/testdata/sf0.01"
    at, w = toxicity.train(spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet"))
    assert 0 < len(at) < 5000 and np.isfinite(w).all()


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, cache_size=500)


@pytest.fixture(scope="module")
def official(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_encoding_of_random_texts(coder, official):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aaabcd  \n\t'sét1²½.,!漢字\x1c\x85\xa0 I'll😀́") for _ in range(rng.randint(0, 40)))
        assert coder.encode(text) == official.encode_ordinary(text)


def test_another_pattern_goes_through_the_expression(coder):
    """Pieces of two characters: what the short cuts assume does not hold."""
    pattern = r"\S\S?|\s"
    other = bpe.Bpe(coder.ranks, pattern)
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    for text in ("hello, world. some words", "a b  c", "straße 12.5", ""):
        assert other.encode(text) == own.encode_ordinary(text)
    assert bpe.WORDS_PATTERN == public_tokenizers.PATTERN


def test_joins_far_from_the_boundary(coder, official):
    rng = random.Random(2)
    for text in ["a" * 3001, "ab" * 900, "=-" * 1200, " " * 999, "\n" * 77 + "x", "".join(rng.choice("abcdefgh") for _ in range(6000))]:
        assert coder.encode(text) == official.encode_ordinary(text)


def test_encoding_of_documents(spark, docs, small, official):
    got = {r["doc_id"]: r for r in queries.op6_byte_bpe(spark, TOP).collect()}
    for i, t in small:
        ids = official.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_tokens_of_odd_rows(odd, none):
    enc = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    got = sorted(bytes(r["decoded"]).decode() for r in bpe.decode(enc, RANKS, public_tokenizers.PATTERN).collect())
    assert got == sorted(r["text"] or "" for r in odd.collect())
    assert bpe.digests(bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)).count() == 0


def test_search_equals_sql(spark, duck):
    assert_same(queries.op7_top_k(spark, TOP), duck, queries.OP7_SQL)


def test_search_with_ties_nulls_and_shards(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5]) for _ in range(3)]) for i in range(200)]
    rows += [(200, None), (201, [None, 1.0, 1.0]), (202, [float("nan")] * 3), (203, [float("inf")] * 3), (None, [1.0] * 3), (205, []), (206, [2.0]), (50, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS qrow", "2 AS block")
    got = topk.top_k(df, shard_rows=40, block_rows=2).collect()
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expect = []
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:5]
            expect += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert sorted(tuple(r) for r in got) == sorted(expect)
    assert topk.top_k(df.limit(0)).count() == 0


def test_search_beyond_doubles(spark):
    big = [(0, [1e7, 3.0]), (1, [1e7, 5.0]), (2, [1e7, 4.0]), (3, [1e30, 0.0]), (4, [-1e30, 0.0])]
    got = {r["rank"]: r for r in topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    assert [got[k]["vec_id"] for k in (1, 2, 3, 4)] == [3, 1, 2, 4] and got[1]["score"] == 2**63 - 1 and got[2]["score"] == 2560000000**2 + 768 * 1280


def test_archives_equal_sql(spark, duck):
    assert_same(queries.op10_warc(spark, TOP), duck, queries.OP10_SQL)


def test_archives_of_odd_rows(spark):
    rows = [(3, "u", "x"), (1, "b", "x"), (1, "b", "x"), (1, None, "x"), (None, "z", "x"), (5, "q\r\nbad", None), (6, "q", ""), (None, None, None), (7, "l", "<p>" * 90_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' AS sha", "1 AS place")
    got = warc.archive_round_trip(df).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got if r["page_id"]) == sorted((i, len(h or "")) for i, _, h in rows if i)
    for text, first in (("x", 1), ("", 5), ("<p>" * 90_000, 7)):
        own = [r for r in got if r["payload_digest"] == warc.digest(text.encode())]
        head = [r for r in own if r["record_type"] == "response"]
        assert len(own) == sum((h or "") == text for *_, h in rows)
        assert [(r["page_id"], r["refers_to"], bytes(r["payload"])) for r in head] == [(first, None, text.encode())]
        assert all(r["refers_to"] == first and r["payload"] is None for r in own if r not in head)
    assert next(r["target_uri"] for r in got if r["page_id"] == 5) == "q%0D%0Abad"
    long_only = warc.archive_round_trip(df, min_revisit_bytes=5).collect()
    assert {r["record_type"] for r in long_only} == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_begin_with_their_dictionary(spark, tmp_path):
    pages = spark.read.parquet(f"{TOP}/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("part-*"):
        raw = f.read_bytes()
        assert int.from_bytes(raw[:4], "little") == warc.DICT_MAGIC
        assert all(x.startswith(b"WARC/1.1\r\n") for x in warc.frames_of(raw))
        with pytest.raises(ValueError, match="ends within"):
            list(warc.frames_of(raw[:-20]))


def test_archives_roll(spark, tmp_path):
    """Small archives: each begins with the dictionary, and together they hold every record once."""
    pages = spark.read.parquet(f"{TOP}/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=40_000)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 4 and all(int.from_bytes(f.read_bytes()[:4], "little") == warc.DICT_MAGIC for f in files)
    got, whole = ((sorted(tuple(r)[:5] for r in x.collect())) for x in (warc.read_archives(spark, str(tmp_path / "w")), warc.archive_round_trip(pages)))
    assert [str(r) for r in got] == [str(r) for r in whole] and len(got) == pages.count()


def test_no_archive_is_larger_than_its_bound_and_one_record(spark, tmp_path):
    rng = random.Random(4)
    noise = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n // 3))
    rows = [(i, f"http://x/{i}" if i % 3 else None, f"<p>{i}</p>" * 20) for i in range(3000)] + [(3000 + i, "u", noise(400_000)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    bound = 400_000
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=bound, date="2024-05-06T07:08:09Z")
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < bound + 420_000 and sum(s > bound for s in sizes) <= 6
    for f in (tmp_path / "w").glob("part-*"):
        for x in warc.frames_of(f.read_bytes()):
            head = x.split(b"\r\n\r\n")[0]
            assert b"WARC-Date: 2024-05-06T07:08:09Z" in head and b"WARC-Target-URI: " in head
    got = sorted((r["page_id"], r["target_uri"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [(i, u) for i, u, _ in rows]


def test_dictionary_is_made_of_records(spark):
    pages = spark.read.parquet(f"{TOP}/pages.parquet")
    words = warc.train_dictionary(pages)
    assert words == warc.train_dictionary(pages.repartition(3)) and b"WARC-Payload-Digest: sha1:" in words
    long = warc.sample_record(1, "u", b"x" * 50_000, 17, 8192)
    assert len(long) == 8192 and long.startswith(b"WARC/1.1")


def test_pipeline_stages(spark, official):
    """Each stage against a plain form on what it was given."""
    import corpus_pipeline as p
    from test_repeats import brute_components
    from test_rows import plain_mix

    table = spark.read.parquet(f"{TOP}/documents.parquet")
    outs = []
    for _, stage in p.STAGES:
        outs.append(stage(spark, table if not outs else outs[-1], TOP).cache())
        if len(outs) < len(p.STAGES):
            assert outs[-1].columns == table.columns
    first, exact, near, mixed, tokens = ([r.asDict() for r in o.collect()] for o in outs)
    labels = spark.read.parquet(f"{TOP}/labels.parquet")
    model = quality.train(table, labels.filter(labels["doc_id"].isin([r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1])))
    assert sorted(r["doc_id"] for r in first) == sorted(r["doc_id"] for r in table.collect() if plain_quality(model, r["text"] or "") >= 0.5)
    assert 0 < len(first) < table.count()
    best = {}
    for r in first:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())
    groups = brute_components([(r["doc_id"], r["text"]) for r in exact], 5, 80, True)
    assert sorted(r["doc_id"] for r in near) == sorted({c for *_, c in groups})
    plan = plain_mix(outs[2])
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, n in plan.items() for _ in range(n))
    text = {r["doc_id"]: r["text"] for r in near}
    for r in tokens:
        assert r["ids"] == official.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert len(tokens) == len(mixed) == p.run(spark, TOP).count()


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Nulls, empties, repeats and clashing names go through every stage without loss of columns."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        for table in (odd, none):
            out = stage(spark, table, TOP)
            rows = out.collect()
            if name == "tokens":
                assert len(rows) == table.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
            else:
                assert out.columns == odd.columns and {str(r) for r in rows} <= {str(r) for r in table.collect()}
