"""How the sources of each language differ in their words, by single-pass in-memory indexing.

A task reads whole texts once and adds up postings (term, source: occurrences, documents) in memory. When
they reach a bound it spills them as a run, sorted by term, and begins anew. Runs go to hash shards of
(language, term), where the exchange's external sort merges them and equal postings are added up as they
stream by; a frequent word arrives as one posting a run and source, not one an occurrence.

The divergence of two sources is a sum over all terms. It is taken in closed form as if neither had any
term, plus corrections: for how often one has its terms, by the histogram of its counts, and for the terms
that both have, streamed from the merged postings. All figures are exact: probabilities are whole billionths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonflow.llm.common import discard, pack, parts, stored, tidy, to_arrow

#: Postings that a task holds before it spills a run.
RUN_POSTINGS = 600_000
#: Terms of a batch in which a run is written.
BLOCK_TERMS = 20_000
SCALE = 1_000_000_000
#: Letters of A-Z in lower case; every byte that is neither a letter nor part of a character beyond ASCII ends a term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUN = "lang string, term string, docs long, sources array<string>, counts array<long>"
KEPT = "lang string, term string, source string, n long, lang_n long, head int"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Postings:
    """Occurrences of each term in each source of a language, and its documents in the language."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: str) -> None:
        words = terms(text)
        count = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before = len(count)
        count.update(words)
        self.size += len(count) - before
        self.docs.setdefault(lang, Counter()).update(set(words))

    def spill(self) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
        """For each language its sorted terms, their documents, where the postings of each end, and the postings' sources (by number) and counts; the memory is free again."""
        docs, counts = self.docs, self.counts
        self.__init__()
        for lang in sorted(docs):
            found = sorted(docs[lang])
            place = {t: i for i, t in enumerate(found)}
            names, own = list(counts[lang]), list(counts[lang].values())
            at = np.array([place[t] for c in own for t in c], dtype=np.int64)
            source = np.repeat(np.arange(len(own)), [len(c) for c in own])
            n = np.fromiter((v for c in own for v in c.values()), dtype=np.int64, count=len(at))
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(found)))
            yield lang, found, np.array([docs[lang][t] for t in found], dtype=np.int64), ends, source[order], n[order], names


def _lists(ends: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values).cast(kind)


def _runs(docs: DataFrame, run_postings: int) -> DataFrame:
    """Spilled runs: a row for each term of a run, sorted by language and term."""
    arrow = to_arrow(RUN)

    def rows(held: Postings) -> Iterator[pa.RecordBatch]:
        for lang, found, n_docs, ends, source, n, names in held.spill():
            for at in range(0, len(found), BLOCK_TERMS):
                here = slice(at, at + BLOCK_TERMS)
                first = int(ends[at - 1]) if at else 0
                own = slice(first, int(ends[here][-1]))
                texts = pa.array([t.decode("utf-8", "surrogatepass") for t in found[here]], pa.string())
                lists = (_lists(ends[here] - first, v, arrow.field(c).type) for c, v in (("sources", pa.array(names, pa.string()).take(pa.array(source[own]))), ("counts", pa.array(n[own]))))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), texts, pa.array(n_docs[here]), *lists], schema=arrow)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for row in zip(*whole.slice(at, 256).to_pydict().values(), strict=True):
                    held.add(*row)
                    if held.size >= run_postings:
                        yield from rows(held)
        yield from rows(held)

    return docs.select("lang", "source", "text").mapInArrow(index, RUN)


def _starts(lang: pa.Array, term: pa.Array) -> np.ndarray:
    """The rows at which another term begins."""
    if len(term) < 2:
        return np.arange(len(term))
    other = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
    return np.concatenate([[0], 1 + np.flatnonzero(other.to_numpy(zero_copy_only=False))])


def add_up(rows: pa.RecordBatch, least_docs: int, schema: pa.Schema) -> pa.RecordBatch:
    """The sorted rows of runs, whole terms only, as frequencies of the terms with enough documents."""
    starts = _starts(rows.column(0), rows.column(1))
    size = np.diff(np.append(starts, rows.num_rows))
    kept = np.add.reduceat(rows.column(2).to_numpy(), starts) >= least_docs
    rows = rows.filter(pa.array(np.repeat(kept, size)))
    if not rows.num_rows:
        return pa.RecordBatch.from_pylist([], schema=schema)
    size = size[kept]
    lists = rows.column(3)
    term = np.repeat(np.repeat(np.arange(len(size)), size), lists.value_lengths().to_numpy())
    names = lists.flatten().dictionary_encode()
    code, n = term * len(names.dictionary) + names.indices.to_numpy(), rows.column(4).flatten().to_numpy()
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    term, n, source = code[first] // len(names.dictionary), np.add.reduceat(n, first), code[first] % len(names.dictionary)
    head = np.concatenate([[True], term[1:] != term[:-1]])
    total = np.add.reduceat(n, np.flatnonzero(head))[term]
    at = pa.array((np.cumsum(size) - size)[term])
    return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), names.dictionary.take(pa.array(source)), pa.array(n), pa.array(total), pa.array(head.astype(np.int32))], schema=schema)


def _frequencies(runs: DataFrame, least_docs: int) -> DataFrame:
    """Postings (lang, term, source, n) of the terms in at least ``least_docs`` documents of a language, with lang_n, the term's count in the language, and head, 1 at one posting of each term.

    A shard's runs arrive merged by language and term; a task holds the rows of a batch and of one term.
    """
    arrow = to_arrow(KEPT)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the term that the last batch ended with
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b.column(0), b.column(1))
            same = bool(held) and b.column(0)[0] == held[0].column(0)[0] and b.column(1)[0] == held[0].column(1)[0]
            if same and len(starts) == 1:
                held.append(b)
                continue
            whole = pa.concat_batches([*held, b.slice(0, starts[-1])])
            if whole.num_rows:
                yield add_up(whole, least_docs, arrow)
            held = [b.slice(starts[-1])]
        if held:
            yield add_up(pa.concat_batches(held), least_docs, arrow)

    shards = runs.repartition(parts(runs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return stored(shards.mapInArrow(merged, KEPT), "frequencies")


def probability(count: Column, total: Column, v: Column) -> Column:
    """Whole billionths of ``count`` with two added to each of ``v`` terms, and one; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    below = whole(F.when(v > 0, total + 2 * v))
    return F.call_function("div", whole(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), below) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_corrections(group: np.ndarray, p: np.ndarray, p0: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group pairs (a < b) and what the terms that both have add to the sums of their single corrections.

    Rows are postings of consecutive terms; ``ends`` has the end of each row's term.
    """
    rows = np.arange(len(group))
    size = ends - rows - 1
    left = np.repeat(rows, size)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
    add = _apart(p[left], p[right]) - _apart(p[left], p0[right]) - _apart(p0[left], p[right]) + _apart(p0[left], p0[right])
    a, b = np.minimum(group[left], group[right]), np.maximum(group[left], group[right])
    order = np.lexsort((b, a))
    a, b, add = a[order], b[order], add[order]
    if not len(a):
        return a, b, add
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[new], b[new], np.add.reduceat(add, new)


def _shared(postings: DataFrame) -> DataFrame:
    """a, b, extra: partial sums of the corrections of group pairs, from the postings of each term together."""
    schema = "a long, b long, extra long"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            names, group, p, p0 = (list(c) for c in zip(*rows, strict=True))
            new = np.array([True] + [x != y for x, y in zip(names[1:], names, strict=False)])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(rows))[np.cumsum(new) - 1]
            a, b, add = shared_corrections(*(np.array(c, dtype=np.int64) for c in (group, p, p0)), ends)
            return pack({"a": a, "b": b, "extra": add}, arrow)

        held: list[tuple] = []
        for b in batches:
            for lang, term, *row in zip(*b.to_pydict().values(), strict=True):
                if len(held) > 50_000 and held[-1][0] != (lang, term):
                    yield solve(held)
                    held = []
                held.append(((lang, term), *row))
        if held:
            yield solve(held)

    dealt = postings.select("lang", "term", "id", "p", "p0").repartition(parts(postings.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, schema)


@tidy
def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, run_postings: int = RUN_POSTINGS) -> DataFrame:
    """lang, source, part, item, value and rank: how each source of a language differs from the others.

    Terms are runs of ASCII letters and characters beyond ASCII of the whole text, A-Z lower-cased; a
    language keeps those in at least ``least_docs`` of its documents. In a group with N occurrences of the V
    kept terms a term has p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); two groups differ there by
    floor((p - q)**2 / (p + q)). Part ``pair`` has the sum over all kept terms (0 if there are none) for each
    other source of the language; part ``term`` the ``top`` terms that the source has and that are likelier
    in it than in its language. Ranks are by value, then by the item's bytes.

    Null lang, source and text are empty strings; a source without terms counts like any other. Repeated
    rows are documents of their own. Further columns, whatever their names, play no part. Very long texts
    count as a whole. An empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = _frequencies(_runs(docs, run_postings), least_docs)
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = kept.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("n").alias("n_lang"))
    zero = F.lit(0).cast("long")
    named = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    named = named.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n_group", "v", "n_lang")])
    groups = stored(named.withColumn("p0", probability(zero, F.col("n_group"), F.col("v"))).withColumn("id", F.monotonically_increasing_id()), "groups")
    p, q = (probability(F.col(n), F.col(total), F.col("v")) for n, total in (("n", "n_group"), ("lang_n", "n_lang")))
    likely = stored(kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "id", "p0", p.alias("p"), q.alias("q")), "likely")

    def part(name: str, rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", place.alias("rank"))

    differ = likely.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = stored(part("term", differ).filter(F.col("rank") <= top), "terms")

    shared = stored(_shared(likely).groupBy("a", "b").agg(F.sum("extra").alias("extra")), "shared")
    other = groups.select("lang", F.col("id").alias("other"), F.col("p0").alias("other_p0"))
    counts = likely.groupBy("lang", "id", "p0", "p").agg(F.count("*").alias("k"))
    change = divergence(F.col("p"), F.col("other_p0")) - divergence(F.col("p0"), F.col("other_p0"))
    single = stored(counts.join(other, "lang").filter("id != other").groupBy("id", "other").agg(F.sum(F.col("k") * change).alias("change")), "single")

    left = groups.select("lang", "source", "id", "p0", "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("other"), F.col("p0").alias("other_p0"))
    pairs = left.join(right, "lang").filter("id != other")
    pairs = pairs.join(single, ["id", "other"], "left")
    pairs = pairs.join(single.select(F.col("id").alias("other"), F.col("other").alias("id"), F.col("change").alias("back")), ["id", "other"], "left")
    pairs = pairs.join(shared, (F.least("id", "other") == F.col("a")) & (F.greatest("id", "other") == F.col("b")), "left")
    value = F.when(F.col("v") > 0, F.col("v") * divergence(F.col("p0"), F.col("other_p0"))).otherwise(zero)
    pairs = pairs.withColumn("value", value + F.coalesce("change", zero) + F.coalesce("back", zero) + F.coalesce("extra", zero))
    out = stored(part("pair", pairs).unionByName(best), "divergence")
    discard(kept, groups, likely, best, shared, single)
    return out
