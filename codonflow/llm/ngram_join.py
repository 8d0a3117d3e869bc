"""Near-duplicate groups by a size-aware Jaccard join of word n-gram sets.

Light sets (small ones) enumerate their subsets of each size that a partner of a given size must share;
two that meet on one are linked without any further look. Heavy sets scan inverted lists. The boundary
between the two is the set size for which the measured cost of both is least.

A list belongs to two grams that follow each other when a set is sorted from rare to frequent grams: two
sets that differ little have such a pair in common near the rare end, and two that only share a passage or
some frequent words hardly ever do, so the lists hold little but near duplicates and grow in proportion to
the input. Most lists have one member and are told by a filter before anything is written. In a list all
members are first compared with one of them, and what passes is linked; only lists that still have members
in different components are compared further, nearest ones first, and at last in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from codonflow.llm.common import bucketed, discard, pack, parts, stored, tidy, to_arrow
from codonflow.llm.components import components

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COUNT_BITS, COUNT_SLICES = 18, 64
#: Least and most bits of a broadcast filter: 8 kB to 32 MB. Beyond what the largest can tell apart it lets more through.
FILTER_BITS = (16, 28)
#: Members of a list that are compared with the same one, and rows of a block in which a list is compared in full.
BLOCK = 2048
#: Lists that a member of open ones names where it may be in many. Near duplicates share most of theirs, so few pairs meet in none of these.
LEAST_LISTS = 16
#: Least and most cells of a set's histogram.
CELLS = (32, 1024)
FIRST, SECOND = np.array([0]), np.array([1])


def gram_set(text: str | None, words: int, lower: bool) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``words``-word shingles; of the whole sequence if it is shorter."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = (raw.lower() if lower else raw).split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) < words:
        return np.array([xxh3_64_intdigest(b" ".join(w), len(w))], dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    n = len(h) - words + 1
    out = h[:n] * K1
    for i in range(1, words):
        out ^= out >> np.uint64(31)
        out = (out + h[i : i + n]) * K2
    out ^= out >> np.uint64(29)
    return np.unique(out * K1)


def histogram(grams: np.ndarray, percent: int) -> bytes:
    """Elements in each cell of the hash space: two sets differ in at least as many elements as their histograms do.

    There are as many cells as it takes to tell unrelated sets of this size apart; a coarser histogram is
    got by adding neighbours. A set too large for one byte a cell has none, and is never discarded.
    """
    n = len(grams)
    gap = 2 * (100 - percent) / (100 + percent)
    cells = CELLS[0]
    while cells < CELLS[1] and cells < max(min(n / 2, 128), 2 * gap * gap * n):
        cells *= 2
    count = np.bincount(((grams * K2) >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else b""


def _differences(sketches: list[bytes]):
    """A function of two index arrays: least possible symmetric differences of those pairs of sets."""
    cells = np.array([len(x) for x in sketches])
    data = {c: np.frombuffer(b"".join(x for x in sketches if len(x) == c), dtype=np.uint8).reshape(-1, c).astype(np.int16) for c in set(cells.tolist()) if c}
    place = np.zeros(len(cells), dtype=np.int64)
    for c in data:
        place[cells == c] = np.arange(int((cells == c).sum()))

    def rows(i: np.ndarray, c: int, level: int) -> np.ndarray:
        x = data[c][place[i]]
        return x if c == level else x.reshape(len(x), level, -1).sum(2, dtype=np.int16)

    def pairs(r: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r), dtype=np.int64)
        for a in data:
            for b in data:
                at = np.flatnonzero((cells[r] == a) & (cells[k] == b))
                for j in range(0, len(at), 20_000):
                    q = at[j : j + 20_000]
                    level = min(a, b)
                    out[q] = np.abs(rows(r[q], a, level) - rows(k[q], b, level)).sum(1)
        return out

    return pairs


@lru_cache(maxsize=100_000)
def overlap(a: int, b: int, percent: int) -> int:
    """Common elements that sets of sizes a and b must have: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def partners(a: int, percent: int) -> range:
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def alone(n: int, percent: int) -> bool:
    """Whether a set of ``n`` elements can be linked with equal sets only."""
    return partners(n, percent) == range(n, n + 1) and overlap(n, n, percent) == n


def chain_length(percent: int) -> int:
    """Grams that make a list's key: two where any linked sets have two that follow each other in both, else one.

    Of c common grams, c - 1 gaps lie between neighbours, and each of the D grams that only one set has
    spoils at most one; so two are enough where c >= D + 2.
    """
    enough = all(3 * overlap(a, b, percent) >= a + b + 2 for a in range(1, 200) if not alone(a, percent) for b in partners(a, percent))
    return 2 if enough else 1


@lru_cache(maxsize=100_000)
def prefix_length(n: int, percent: int, chain: int) -> int:
    """Grams, from the rarest, among which a set of ``n`` has a chain in common with any partner.

    Up to the first unspoiled gap lie at most D + 2 common grams and the n - c grams that the partner lacks.
    The most is needed for one of the smallest partners.
    """
    if not n or alone(n, percent):
        return 0
    common = ((b, overlap(n, b, percent)) for b in partners(n, percent)[:8])
    return min(n, max(chain + (chain - 1) * (n + b - 2 * c) + n - c for b, c in common))


def n_keys(n: int, percent: int, chain: int) -> int:
    return max(0, prefix_length(n, percent, chain) - chain + 1)


def list_keys(grams: np.ndarray, rarity: np.ndarray, percent: int, chain: int) -> np.ndarray:
    """The lists that a set is in. ``rarity``: a class from rare to frequent for each cell of the gram's first bits."""
    take = prefix_length(len(grams), percent, chain)
    if not take:
        return grams[:0]
    rank = (rarity[grams >> np.uint64(64 - COUNT_BITS)] << np.uint64(56)) | (grams >> np.uint64(8))
    if take < len(rank):
        rank = np.partition(rank, take - 1)[:take]
    rank.sort()
    x = rank * K1
    x ^= x >> np.uint64(31)
    if chain == 2:
        x = (x[:-1] + rank[1:]) * K2
    x ^= x >> np.uint64(29)
    return x * K1


def subset_cost(a: int, percent: int) -> int:
    return sum(comb(a, overlap(a, b, percent)) for b in partners(a, percent))


def boundary(sets: dict[int, int], lists: dict[int, int], percent: int) -> int:
    """The largest light size: least total of subsets that light sets write and of what heavy ones cost.

    ``sets``: sets of each size; ``lists``: what lists cost the sets of each size, entries read and elements
    moved to compare candidates. A subset, an entry and an element count alike.
    """
    light, heavy = 0, sum(lists.values())
    best = (heavy, 0)
    for n in sorted(sets):
        light += 0 if alone(n, percent) else sets[n] * subset_cost(n, percent)
        heavy -= lists.get(n, 0)
        if light >= best[0]:  # it only grows
            break
        best = min(best, (light + heavy, n), key=lambda v: v[0])
    return best[1]


def _summaries(docs: DataFrame, words: int, lower: bool, percent: int, chain: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, rid (the set's hash), n, keys and sketch of every row; and how rare the grams of each of 2**18 hash cells are in the corpus."""
    schema = "doc_id long, rid long, n int, keys int, sketch binary, slice int, cells binary"
    arrow, packed = to_arrow(schema), to_arrow("slice int, cells binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, grams = b.column(0).slice(at, 512), [gram_set(t, words, lower) for t in b.column(1).slice(at, 512).to_pylist()]
                total += np.bincount((np.concatenate(grams) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
                none = [None] * len(grams)
                yield pack({"doc_id": ids, "rid": [set_id(g) for g in grams], "n": [len(g) for g in grams], "keys": [n_keys(len(g), percent, chain) for g in grams], "sketch": [histogram(g, percent) for g in grams], "slice": none, "cells": none}, arrow)
        some = [(i, x.astype(np.uint32).tobytes()) for i, x in enumerate(np.split(total, COUNT_SLICES)) if x.any()]
        none = [None] * len(some)
        yield pack({"doc_id": none, "rid": none, "n": none, "keys": none, "sketch": none, "slice": [i for i, _ in some], "cells": [x for _, x in some]}, arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(x, dtype=np.uint32).astype(np.int64)
        yield pack({"slice": list(total), "cells": [x.tobytes() for x in total.values()]}, packed)

    found = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "sets")
    slices = found.filter("slice is not null").select("slice", "cells").repartitionById(COUNT_SLICES, F.col("slice")).mapInArrow(add, "slice int, cells binary")
    counts = np.zeros((COUNT_SLICES, (1 << COUNT_BITS) // COUNT_SLICES), dtype=np.int64)
    for r in slices.collect():  # 2**18 counts in all, whatever the input
        counts[r["slice"]] = np.frombuffer(r["cells"], dtype=np.int64)
    return found, np.minimum(4 * np.log2(1 + counts.ravel()), 255).astype(np.uint64)


def set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _filter(slices: DataFrame, n_slices: int, bits: int, twice: bool) -> np.ndarray:
    """A filter of 2**bits bits, put together slice by slice in tasks and collected packed: 2**bits / 8 bytes.

    ``slices``: slice, cells (packed 32-bit hashes), owners (packed 64-bit ids of what has the hash). With
    ``twice`` only hashes that have two different owners are set.
    """
    own = bits - n_slices.bit_length() + 1
    schema = to_arrow("slice int, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for i, cells, owners in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                have.setdefault(i, []).append((np.frombuffer(cells, dtype=np.uint32), np.frombuffer(owners, dtype=np.int64)))
        for i in list(have):
            x, owner = (np.concatenate(v) for v in zip(*have.pop(i), strict=True))
            if twice:
                order = np.argsort(x, kind="stable")
                x, owner = x[order], owner[order]
                x = x[1:][(x[1:] == x[:-1]) & (owner[1:] != owner[:-1])]  # of different owners some two are neighbours
            on = np.zeros(1 << own, dtype=bool)
            on[(x >> np.uint32(32 - own)).astype(np.int64)] = True
            yield pack({"slice": [i], "bits": [np.packbits(on, bitorder="little").tobytes()]}, schema)

    out = np.zeros((n_slices, (1 << own) // 8), dtype=np.uint8)
    for r in slices.repartitionById(n_slices, F.col("slice")).mapInArrow(run, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _hits(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    cell = (hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


SLICES = "slice int, cells binary, owners binary"


def _sliced(hashes: np.ndarray, owners: np.ndarray, n_slices: int, arrow: pa.Schema) -> pa.RecordBatch:
    """64-bit hashes dealt to slices by their first bits; the next 32 bits of each are kept. ``owners`` may be empty."""
    bits = n_slices.bit_length() - 1
    where = (hashes >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(where, kind="stable")
    cells, owners = (hashes[order] >> np.uint64(32 - bits)).astype(np.uint32), owners[order] if len(owners) else owners
    ends = np.searchsorted(where[order], np.arange(n_slices + 1))
    some = np.flatnonzero(np.diff(ends))
    return pack({"slice": some.astype(np.int32), "cells": [cells[ends[i] : ends[i + 1]].tobytes() for i in some], "owners": [owners[ends[i] : ends[i + 1]].tobytes() for i in some]}, arrow)


def _slices(spark) -> int:
    """A power of two, as many slices as there are shuffle partitions or a little more."""
    return 1 << min(13, max(4, (parts(spark) - 1).bit_length()))


def _filter_bits(n: int, n_slices: int) -> int:
    return max(n_slices.bit_length() + 2, min(FILTER_BITS[1], max(FILTER_BITS[0], n.bit_length())))


#: Keys of some sets together, with the id and the size of the set of each.
Keys = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def postings(source: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Keys], total: int) -> DataFrame:
    """token, rid, n, members of the lists that have two members or more; ``total`` keys in all, which ``keys`` makes of ``source``.

    Near duplicates meet in many lists: of lists with the same members one stays.
    """
    spark = source.sparkSession
    n_slices = _slices(spark)
    sliced, listed = to_arrow(SLICES), to_arrow("token long, rid long, n int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for k, rid, _ in keys(batches):
            held.append((k, rid))
            if sum(len(x) for x, _ in held) > 1 << 19:
                yield _sliced(*(np.concatenate(x) for x in zip(*held, strict=True)), n_slices, sliced)
                held = []
        if held:
            yield _sliced(*(np.concatenate(x) for x in zip(*held, strict=True)), n_slices, sliced)

    bits = _filter_bits(total, n_slices)
    shared = spark.sparkContext.broadcast(_filter(source.mapInArrow(count, SLICES), n_slices, bits, twice=True))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rid, n in keys(batches):
            hit = _hits(k, shared.value)
            yield pack({"token": k[hit].view(np.int64), "rid": rid[hit], "n": n[hit].astype(np.int32)}, listed)

    entries = stored(source.mapInArrow(write, "token long, rid long, n int").distinct(), "entries")
    shared.destroy()
    lists = entries.groupBy("token").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rid")).alias("who")).filter("members > 1")
    lists = stored(lists.groupBy("members", "who").agg(F.min("token").alias("token")).drop("who"), "lists")
    out = stored(entries.join(lists, "token"), "postings")
    discard(entries, lists)
    return out


def _prefix_keys(spark, words: int, lower: bool, percent: int, chain: int, rarity: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Keys]:
    """Keys of the lists that each text's set is in."""
    order = spark.sparkContext.broadcast(rarity)

    def keys(batches: Iterator[pa.RecordBatch]) -> Keys:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = [gram_set(t, words, lower) for t in b.column(0).slice(at, 512).to_pylist()]
                found = [list_keys(g, order.value, percent, chain) for g in sets]
                size = [len(x) for x in found]
                ids = np.array([set_id(g) if k else 0 for g, k in zip(sets, size, strict=True)], dtype=np.int64)
                yield np.concatenate(found), np.repeat(ids, size), np.repeat([len(g) for g in sets], size)

    return keys


def _first_pairs(postings: DataFrame) -> DataFrame:
    """Each member of a list with one other: with the first of its block, and the first of a block with the first of all."""
    member = F.struct("rid", "n")
    dealt = postings.withColumn("block", F.pmod(F.xxhash64("rid"), F.ceil(F.col("members") / BLOCK).cast("long")))
    firsts = stored(dealt.groupBy("token", "block").agg(F.min(member).alias("first")), "firsts")
    tops = stored(firsts.groupBy("token").agg(F.min("first").alias("top"), F.count("*").alias("blocks")).filter("blocks > 1"), "tops")
    inner = dealt.join(firsts, ["token", "block"]).select(F.col("first").alias("x"), member.alias("y"))
    outer = firsts.join(tops, "token").select(F.col("top").alias("x"), F.col("first").alias("y"))
    pairs = inner.union(outer).filter("x.rid != y.rid").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = stored(pairs.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), F.least("x.n", "y.n").alias("small"), F.greatest("x.n", "y.n").alias("large")).distinct(), "pairs")
    discard(firsts, tops)
    return pairs


def _whole_sets(docs: DataFrame, words: int, lower: bool, wanted: DataFrame) -> DataFrame:
    """rid, n and all grams of the ``wanted`` sets (rid, least), read again from the row with the least id.

    A filter over those ids spares hashing most other rows; what it lets through besides does no harm.
    """
    spark = docs.sparkSession
    n_slices, sliced = _slices(spark), to_arrow(SLICES)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(x):
                yield _sliced(x, FIRST[:0], n_slices, sliced)

    bits = _filter_bits(8 * wanted.count(), n_slices)
    schema = "rid long, n int, grams binary"
    arrow = to_arrow(schema)
    shared = spark.sparkContext.broadcast(_filter(wanted.select(F.xxhash64("least")).mapInArrow(cells, SLICES), n_slices, bits, twice=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                h, texts = (whole.column(i).slice(at, 512) for i in range(2))
                hit = _hits(h.to_numpy(zero_copy_only=False).view(np.uint64), shared.value)
                new = {set_id(g): g for g in (gram_set(t, words, lower) for t in texts.filter(pa.array(hit)).to_pylist())}
                out = [(i, len(g), g.tobytes()) for i, g in new.items() if i not in seen]
                if len(seen) > 100_000:
                    seen.clear()
                seen.update(new)
                if out:
                    yield pack(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)

    found = docs.select(F.xxhash64("doc_id"), "text").mapInArrow(run, schema).join(wanted.select("rid"), "rid", "left_semi")
    # The exchange of the grouping deals the rows to the buckets.
    out = bucketed(found.groupBy("rid").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "grams", "rid")
    shared.destroy()
    return out


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, small, large) without those whose histograms say that the sets differ too much."""
    schema = "a long, b long, small int, large int"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x, y = (b.column(i).to_pylist() for i in (4, 5))
                n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
                places = np.arange(b.num_rows)
                apart = _differences(x + y)(places, b.num_rows + places)
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array((100 + percent) * apart <= (100 - percent) * n)) for i in range(4)], schema=arrow)

    left, right = (classes.select(F.col("rid").alias(k), F.col("sketch").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "small", "large", "x", "y").mapInArrow(run, schema)


def _subset_links(light: DataFrame, percent: int) -> DataFrame:
    """Links among light classes (rid, n, grams): those that share a subset of the size that their two sizes ask for."""
    schema = "high long, low long, small int, large int, n int, rid long"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                out = []
                for rid, n, raw in zip(*whole.slice(at, 16).to_pydict().values(), strict=True):
                    g = np.frombuffer(raw, dtype=np.uint64)
                    x, y = (g * K1) ^ ((g * K1) >> np.uint64(32)), (g * K2) ^ ((g * K2) >> np.uint64(30))
                    for b in partners(n, percent):
                        c = overlap(n, b, percent)
                        left = np.array(list(combinations(range(n), n - c)), dtype=np.int64).reshape(comb(n, c), n - c)
                        h, k = (v.sum() - v[left].sum(1) if n - c else np.array([v.sum()]) for v in (x, y))
                        out.append((h.view(np.int64), k.view(np.int64), min(n, b), max(n, b), n, rid))
                if out:
                    size = [len(o[0]) for o in out]
                    yield pack({"high": np.concatenate([o[0] for o in out]), "low": np.concatenate([o[1] for o in out])} | {k: np.repeat([o[i] for o in out], size) for i, k in ((2, "small"), (3, "large"), (4, "n"), (5, "rid"))}, arrow)

    subsets = light.select("rid", "n", "grams").mapInArrow(run, schema)
    keys = ["high", "low", "small", "large"]
    met = subsets.groupBy(*keys).agg(F.min("rid").alias("a"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.count("*").alias("m")).filter("m > 1 and (small = large or n0 != n1)")
    return subsets.join(met.select(*keys, "a"), keys).filter("rid != a").select("a", F.col("rid").alias("b"))


def _meetings(postings: DataFrame, percent: int, light: int, nearest: int | None, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, apart) that meet in a list, may be similar, and are in different components: each member's ``nearest`` ones in each list.

    ``postings``: token, members, n, rid, comp, sketch, lists. Lists of more than ``block`` members are
    compared block against block, each two in a group of their own. ``lists`` has the tokens of lists that a
    member is in, all or the least: a pair does not come out of a list if they tell that it meets in an
    earlier one too. It always comes out of the first, which no token before it can hide.
    """
    spark = postings.sparkSession
    schema = "a long, b long, apart int"
    arrow = to_arrow(schema)

    def solve(token: int, rows: list[tuple]) -> tuple[np.ndarray, ...]:
        first = first_meeting(token, rows)
        n, rid, comp, tag = (np.array([r[i] for r in rows]) for i in (0, 1, 2, 4))
        differences = _differences([r[3] for r in rows])
        out = []
        for at in range(0, len(rows), 256):
            i = slice(at, at + 256)
            total = n[i, None] + n[None, :]
            low, high = np.minimum(n[i, None], n[None, :]), np.maximum(n[i, None], n[None, :])
            ok = (100 * low >= percent * high) & (high > light) & (comp[i, None] != comp[None, :])
            if (tag != tag[0]).any():
                ok &= tag[i, None] != tag[None, :]
            if nearest is None:  # each pair once
                ok = np.triu(ok, at + 1)
            r, c = np.nonzero(ok)
            apart = differences(at + r, c)
            fits = (100 + percent) * apart <= (100 - percent) * total[r, c]
            if first:
                fits[fits] = [first(at + i, j) for i, j in zip(r[fits].tolist(), c[fits].tolist(), strict=True)]
            r, c, apart = r[fits], c[fits], apart[fits]
            if nearest is not None:
                order = np.lexsort((rid[c], apart, r))
                r, c, apart = r[order], c[order], apart[order]
                near = np.arange(len(r)) - np.searchsorted(r, r) < nearest
                r, c, apart = r[near], c[near], apart[near]
            out.append((rid[at + r], rid[c], apart))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def solve_few(token: int, rows: list[tuple]) -> tuple[np.ndarray, ...]:
        """The same for a handful of members, all their pairs."""
        out, first = [], first_meeting(token, rows)
        for (i, (n, r, c, x, t, _)), (j, (m, s, d, y, u, _)) in combinations(enumerate(rows), 2):
            if c != d and (not first or first(i, j)) and max(n, m) > light and 100 * min(n, m) >= percent * max(n, m) and (t != u or not mixed(rows)):
                apart = int(_differences([x, y])(FIRST, SECOND)[0]) if len(x) != len(y) else int(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).sum())
                if (100 + percent) * apart <= (100 - percent) * (n + m):
                    out.append((r, s, apart))
        return tuple(np.array(v) for v in zip(*out, strict=True)) if out else tuple(np.zeros(0, int) for _ in range(3))

    def first_meeting(token: int, rows: list[tuple]) -> Callable[[int, int], bool] | None:
        if rows[0][5] is None:
            return None
        before = [{t for t in np.frombuffer(r[5], dtype=np.int64).tolist() if t < token} for r in rows]
        return lambda i, j: before[i].isdisjoint(before[j])

    def mixed(rows: list[tuple]) -> bool:
        return any(r[4] != rows[0][4] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, out, size = [], None, [], 0

        def pairs() -> pa.RecordBatch:
            a, b, apart = (np.concatenate(x) for x in zip(*out, strict=True))
            return pack({"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": apart.astype(np.int32)}, arrow)

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                for token, cell, *row in zip(*whole.slice(at, 2048).to_pydict().values(), strict=True):
                    if (token, cell) != key:
                        if len(group) > 1:
                            out.append((solve_few if len(group) <= 6 else solve)(key[0], group))
                            size += len(out[-1][0])
                        if size > 50_000:
                            yield pairs()
                            out, size = [], 0
                        group, key = [], (token, cell)
                    group.append(row)
        if len(group) > 1:
            out.append((solve_few if len(group) <= 6 else solve)(key[0], group))
        if out:
            yield pairs()

    blocks = F.ceil(F.col("members") / block).cast("long")
    dealt = postings.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    dealt = dealt.select("token", "cell", "n", "rid", "comp", "sketch", F.col("own").alias("tag"), "lists")
    dealt = dealt.repartition(parts(spark), "token", "cell").sortWithinPartitions("token", "cell", "rid")
    return dealt.mapInArrow(run, schema)


def _list_pairs(postings: DataFrame, percent: int, light: int, nearest: int | None, block: int = BLOCK) -> DataFrame:
    """Different pairs of ``_meetings``: each class's ``nearest`` ones over all lists, or all."""
    pairs = _meetings(postings, percent, light, nearest, block).groupBy("a", "b").agg(F.min("apart").alias("apart"))
    if nearest is None:
        return pairs.drop("apart")
    # The nearest over all lists.
    ends = pairs.select("a", "b", "apart", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    place = F.row_number().over(Window.partitionBy("e.x").orderBy("apart", "e.y"))
    return ends.withColumn("place", place).filter(F.col("place") <= nearest).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose sets (rid, grams) pass the threshold exactly."""
    schema = "a long, b long"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for a, b, x, y in zip(*whole.slice(at, 256).to_pydict().values(), strict=True):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((a, b))
                if out:
                    yield pack(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)

    left = sets.select(F.col("rid").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("rid").alias("b"), F.col("grams").alias("y"))
    # The sets are bucketed by rid, so that each is read in place and moves once for each pair.
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def _open_lists(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """``postings`` with comp, of the lists whose members are not all in one component. Those of two members have been compared."""
    now = postings.filter("members > 2").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")
    several = stored(now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("token"), "open")
    return now.join(several, "token", "left_semi")


def _with_lists(opened: DataFrame, few_lists: bool) -> DataFrame:
    """``opened`` with the packed tokens of its lists that a member is in: of all if those are few, else of the least."""
    schema = "rid long, lists binary"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pack({"rid": b.column(0), "lists": [np.array(x, dtype=np.int64).tobytes() for x in b.column(1).to_pylist()]}, arrow)

    tokens = F.collect_list("token")
    lists = opened.groupBy("rid").agg((tokens if few_lists else F.slice(F.array_sort(tokens), 1, LEAST_LISTS)).alias("lists")).mapInArrow(run, schema)
    return opened.join(lists, "rid")


def group_lists(docs: DataFrame, words: int, lower: bool, percent: int, sets: DataFrame, posted: DataFrame, rounds: tuple[int | None, ...], keys_of: Callable[[int], int] | None = None, few_lists: bool = False) -> DataFrame:
    """doc_id, n and component_id of ``sets`` (doc_id, rid, n, sketch), from the lists in which linked sets meet.

    Every pair is confirmed on the full sets, which are hashed again from the texts. ``keys_of``, the lists
    of a set by its size, is given where small sets may enumerate subsets; else only lists are scanned.
    ``few_lists`` says that no set is in many lists, so that each can name all of them.
    """
    classes = stored(sets.filter("n > 0").groupBy("rid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    first = _first_pairs(posted)
    pairs = stored(_alike(first.filter(100 * F.col("small") >= percent * F.col("large")), classes, percent), "pairs")
    light, by_subset = _light_sizes(classes, posted, pairs, percent, keys_of) if keys_of else (0, [])

    heavy = stored(pairs.filter(F.col("large") > light).select("a", "b"), "heavy")
    ids = heavy.select(F.col("a").alias("rid")).union(heavy.select("b")).union(classes.filter(F.col("n").isin(by_subset)).select("rid")).distinct()
    wanted = stored(classes.join(ids, "rid", "left_semi").select("rid", "least"), "wanted")
    grams = _whole_sets(docs, words, lower, wanted)
    links = _verified(heavy, grams, percent)
    if by_subset:
        links = links.union(_subset_links(grams.filter(F.col("n").isin(by_subset)), percent))
    links = stored(links, "near")
    roots = stored(components(links), "roots")
    tried = stored(first.select("a", "b"), "tried")
    scratch = [first, pairs, heavy, wanted, links, tried, grams]
    for nearest in rounds:
        opened = stored(_open_lists(posted, roots), "opened")
        left = stored(_with_lists(opened, few_lists).join(classes.select("rid", "sketch"), "rid"), "open-lists")
        scratch.append(opened)
        if left.isEmpty():
            break
        pairs = stored(_list_pairs(left, percent, light, nearest).join(tried, ["a", "b"], "left_anti"), "pairs")
        wanted = stored(classes.join(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "rid", "left_semi").select("rid", "least"), "wanted")
        grams = _whole_sets(docs, words, lower, wanted)
        near = stored(_verified(pairs, grams, percent), "near")
        tried = tried.union(pairs)
        scratch += [left, pairs, wanted, grams, near]
        if not near.isEmpty():
            roots = stored(components(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(near)), "roots")
    ends = roots.withColumnRenamed("node", "rid").join(classes.select("rid", "least"), "rid")
    least = ends.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.withColumnRenamed("node", "rid").join(least, "root")
    labels = stored(classes.join(named, "rid", "left").select("rid", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "labels")
    discard(posted, classes, *scratch)
    out = sets.drop("sketch").join(labels, "rid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _light_sizes(classes: DataFrame, posted: DataFrame, pairs: DataFrame, percent: int, keys_of: Callable[[int], int]) -> tuple[int, list[int]]:
    """The boundary by measured cost, and the sizes up to it that enumerate subsets."""
    reach = 600 // (100 - percent) + 1 if percent < 100 else 0  # six elements less than that are more subsets than any list has entries
    small = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= reach).groupBy("n").count().collect()}
    cost = {n: k * keys_of(n) for n, k in small.items()}
    read = posted.filter(F.col("n") <= reach).groupBy("n").agg(F.sum("members").alias("k"))
    moved = pairs.filter(F.col("large") <= reach).groupBy(F.col("large").alias("n")).agg(F.sum(F.col("small") + F.col("large")).alias("k"))
    for r in read.union(moved).collect():
        cost[r["n"]] = cost.get(r["n"], 0) + r["k"]
    light = boundary(small, cost, percent)
    return light, [n for n in small if n <= light and not alone(n, percent)]


@tidy
def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", rounds: tuple[int | None, ...] = (4, None)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; its other columns, whatever their names, play no part.

    A set is the distinct ``words``-word shingles of the whole text (A-Z lower-cased if ``lower``), or the
    whole word sequence if it has fewer words. Two rows are linked when 100 * intersection >= ``percent`` *
    union; component_id is the smallest id reachable by links. Rows without words or text have no shingles,
    are linked with nothing and are their own component. Rows with a null id link others, and take the
    smallest id of their component, null if it has none. Repeated rows are equal sets. A very long text is
    one set like any other. An empty table gives no rows.

    Equal sets are one class. After all members of a list are compared with one of them, lists whose members
    are in different components go through ``rounds``: the nearest members outside the own component, then
    (None) all; a round that leaves no such list is the last.
    """
    chain = chain_length(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, rarity = _summaries(docs, words, lower, percent, chain)
    total = found.agg(F.sum("keys")).first()[0] or 0
    posted = postings(docs.select("text"), _prefix_keys(docs.sparkSession, words, lower, percent, chain, rarity), total)
    sets = found.filter("slice is null").select("doc_id", "rid", "n", "sketch")
    return group_lists(docs, words, lower, percent, sets, posted, rounds, lambda n: n_keys(n, percent, chain))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest id; all columns stay.

    Rows that share their id stay together if it is kept; rows with a null id stay only where their group
    has no other id. Rows without words stay.
    """
    groups = near_duplicates(docs, id_col=id_col, **options)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
