"""Sharding, mixing and exact deduplication."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from codonflow.llm import exact_dedup, mixing, queries, sharding

TOP = "/root/testdata/sf0.001"


def check_shards(rows, texts, shards):
    by, group = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r["shard"]].append(r)
        group[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts)
    assert all(len(s) == 1 for s in group.values())
    for got in by.values():
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
    return [sum(r["size"] for r in by[s]) for s in range(shards)]


def test_shards_of_documents(docs, small):
    rows = sharding.histogram_shards(docs, 10).collect()
    sizes = check_shards(rows, [t for _, t in small], 10)
    groups = defaultdict(int)
    for r in rows:
        groups[r["text_crc32"]] += r["size"]
    assert max(abs(s - sum(sizes) / 10) for s in sizes) <= max(groups.values()) + 1
    again = sharding.histogram_shards(docs, 10).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_a_group_larger_than_a_shard_stays_whole(spark):
    texts = ["hot"] * 60 + [f"text {i}" for i in range(60)]
    rows = sharding.histogram_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6).collect()
    check_shards(rows, texts, 6)


def test_shards_of_odd_rows(odd, none):
    rows = sharding.histogram_shards(odd, 4, payload=("source", "h", "shard")).collect()
    check_shards(rows, [r["text"] or "" for r in odd.collect()], 4)
    assert sharding.histogram_shards(none, 4).count() == 0


def test_targets():
    assert mixing.targets([("b", 60), ("a", 60), (None, 60)]) == [("a", 60, 30.0), ("b", 60, 60.0), (None, 60, 90.0)]
    got = mixing.targets([("a", 1), ("b", 500), ("c", 2), ("d", 97)])
    assert got[0][2] == 3 and got[2][2] == 6 and sum(t for *_, t in got) == pytest.approx(600)
    assert got[3][2] == pytest.approx(197) and got[1][2] == pytest.approx(394)
    assert mixing.targets([("a", 0)]) == [("a", 0, 0.0)] and mixing.targets([]) == []


def test_mix_meets_targets(docs, small):
    rows = mixing.mix(docs, carry=("source",)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in small)
    sizes = {i: len(t.encode().split()) for i, t in small}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    plan = mixing.targets([(s, sum(r["size"] for r in x)) for s, x in by.items()])
    for s, n, t in plan:
        got = by[s]
        assert {(r["source_size"], r["target"]) for r in got} == {(n, t)}
        assert abs(sum(r["taken"] for r in got) - t) <= max(r["size"] for r in got) / 2 + 1
        assert len({r["epochs"] for r in got}) <= 2
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs, carry=("source",)).collect()), key=str)


def test_mixed_documents_follow_the_mix(odd, none):
    plan = mixing.mix(odd, carry=("source", "text")).collect()
    got = mixing.mixed(odd)
    assert got.columns == odd.columns and got.count() == sum(r["epochs"] for r in plan)
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_exact_dedup_equals_sql(spark, duck):
    assert_same(queries.op8_exact_dedup(spark, TOP), duck, queries.OP8_SQL)


def test_exact_dedup_of_odd_rows(odd, none):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    for r in exact_dedup.exact_dedup(odd).collect():
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert (r["group_size"], r["keep_id"]) == (len(groups[text]), max(ids, default=None)) and r["kept"] == (r["doc_id"] == r["keep_id"])
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r["text"] or "" for r in kept.collect()) == sorted(groups)
    assert {r["_row"] for r in kept.collect()} == {"w"}
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_content_table_tells_colliding_hashes_apart():
    t = exact_dedup.ContentTable(4)
    for i in range(50):
        t.add(7, f"text {i % 10}".encode(), i, 1, 1)
    assert len(t) == 10 and sorted(t.keep) == list(range(40, 50)) and set(t.size) == {5}


def test_buckets_are_partitioned_again_until_they_fit(spark, monkeypatch):
    """A table of 2 kB, texts of up to 3 kB, and one text on a third of all rows."""
    texts = [f"{i % 40} " * (10 + 20 * (i % 40)) for i in range(160)] + ["hot " * 100] * 80 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels, whole = [], exact_dedup.stored
    monkeypatch.setattr(exact_dedup, "stored", lambda *a: levels.append(1) or whole(*a))
    got = {bytes(r["sha"]).hex(): (r["keep_id"], r["keep_rows"], r["group_size"]) for r in exact_dedup.exact_classes(df, table_bytes=2000).collect()}
    expect = {}
    for i, t in enumerate(texts):
        h = hashlib.sha256((t or "").encode()).hexdigest()
        expect[h] = (i, 1, expect.get(h, (0, 0, 0))[2] + 1)
    assert got == expect and len(levels) > 1


def test_op1_query_against_brute_force(spark):
    """Shards of the registered query cut the texts, in the order of their hash, into 40 runs of equal bytes."""
    rows = queries.op1_histogram_shards(spark, TOP).collect()
    plain = spark.read.parquet(f"{TOP}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    sizes = check_shards(rows, [r["text"] for r in plain], 40)
    shard = {r["doc_id"]: r["shard"] for r in rows}
    group = defaultdict(int)
    for r in plain:
        group[r["h"]] += len(r["text"].encode()) + 16
    order = sorted((r["h"], shard[r["doc_id"]]) for r in plain)
    assert [s for _, s in order] == sorted(s for _, s in order)
    below, total, cuts = 0, sum(sizes), {}
    for h in sorted(group):  # brute force: the boundary nearest to each target
        for k in range(1, 40):
            for at in (below, below + group[h]):
                cuts[k] = min(cuts.get(k, total), abs(at - k * total / 40))
        below += group[h]
    edge = 0
    for k in range(1, 40):
        edge += sizes[k - 1]
        assert abs(edge - k * total / 40) <= cuts[k] + 0.001 * total / 40 + 1


def plain_targets(sizes):
    """Pour all words by weight, a little at a time, into sources that stop at three times their size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    while left > 1e-6:
        room = [s for s in order if target[s] < 3 * sizes[s] - 1e-9]
        share = left / sum(weight[s] for s in room)
        share = min(share, min((3 * sizes[s] - target[s]) / weight[s] for s in room))
        for s in room:
            target[s] += share * weight[s]
        left -= share * sum(weight[s] for s in room)
    return target


def plain_mix(df):
    """Epochs of each document: whole epochs, then a walk in key order up to the budget of its source."""
    key = F.xxhash64(F.lit(17), F.col("doc_id").cast("long"), "source", "text")
    rows = [(r["source"], r["key"] % (1 << 64) >> 33, r["key"], r["doc_id"], len((r["text"] or "").encode().split())) for r in df.select("doc_id", "source", "text", key.alias("key")).collect()]
    sizes = defaultdict(int)
    for source, *_, n in rows:
        sizes[source] += n
    target, at, out = plain_targets(sizes), defaultdict(int), {}
    for source, _, _, doc, n in sorted(rows, key=lambda r: r[1:]):
        full = int(target[source] / sizes[source] + 1e-9) if sizes[source] else 0
        budget = target[source] - full * sizes[source]
        out[doc] = full + (budget > 1e-6 and at[source] + n / 2 <= budget)
        at[source] += n
    return out


def test_mix_cuts_where_a_plain_walk_does(spark, docs):
    got = {r["doc_id"]: r["epochs"] for r in mixing.mix(docs).collect()}
    assert got == plain_mix(docs) and len(set(got.values())) > 1


def test_op2_query_against_plain_targets(spark):
    rows = queries.op2_source_mix(spark, TOP).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{TOP}/documents.parquet").collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.values():
        n = len((r["text"] or "").encode().split())
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in rows:
        source, n = docs[r["doc_id"]]["source"], len((docs[r["doc_id"]]["text"] or "").encode().split())
        assert r["size"] == n and r["taken"] in (0, n, 2 * n, 3 * n) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(plain_targets(sizes)[source])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in plain_targets(sizes).items())


def test_reruns_of_the_mix_agree_however_the_table_is_split(spark):
    rows = [(i % 7 if i % 3 else None, f"word{i} " * (i % 9), "ab"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(map(str, mixing.mix(x, carry=("text",)).collect())) for x in (df.coalesce(1), df.repartition(5, "text")))
    assert one == other
