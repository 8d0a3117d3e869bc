"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold length, most significant digit first, and a suffix leaves
as soon as it is alone in its group; what is left in equal groups after the last digit are exactly the
windows that occur more than once.

The first pass is the exchange. Its digit is not the window's first bytes but the window's least 64-byte
gram (by hash): equal windows have equal grams there, and neighbouring windows mostly share it, so one
record with its context stands for all windows of a run, about one record for 170 bytes. Grams that occur
once in the corpus leave at once. Inside tasks the next digit is the window's first eight bytes themselves,
then each half by its hash, and groups that stay equal are compared by content: they are exact whatever the
hashes. For the windows of very frequent grams the halves' hashes (128 bits) are the keys of exchanges.

The same passes over words instead of bytes tell which texts hold a passage of so many words that occurs
elsewhere, however short its words are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from codonflow.llm.common import bucketed, discard, pack, parts, stored, tidy, to_arrow

GRAM = 64
POSITION_BITS = np.uint64(31)
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A fixed random-looking 64-bit value for each byte.
BYTES = (np.arange(1, 257, dtype=np.uint64) * K1) ^ ((np.arange(1, 257, dtype=np.uint64) * K2) >> np.uint64(23))
#: Windows of a record, and windows that are looked at together: both bound memory, whatever the text.
RECORD, CHUNK = 4096, 1 << 20
ANCHORS = "gram long, key binary, first int, n int, own boolean"
CONTEXTS = "gram long, key binary, first int, n int, context binary"
RUNS = "key binary, start int, stop int"


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)


def _words(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


@dataclass(frozen=True)
class Unit:
    """What windows are made of: a text's items, and how many of them make a gram."""

    items: Callable[[bytes], np.ndarray]
    size: int
    gram: int


BYTE, WORD = Unit(_bytes, 1, GRAM), Unit(_words, 8, 8)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * K1
    x ^= x >> np.uint64(29)
    x *= K2
    x += b
    return x


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes (or of as many hashes of words), by doubling."""
    level, size, out, done = BYTES[data] if data.dtype == np.uint8 else data, 1, None, 0
    while True:
        if width & size:
            # Blocks are joined in a fixed order, the smallest first.
            out = level if out is None else _join(out[: max(0, len(data) - done - size + 1)], level[done:])
            done += size
        if done == width:
            out ^= out >> np.uint64(31)
            return (out * K2)[: max(0, len(data) - width + 1)]
        level = _join(level[: max(0, len(level) - size)], level[size:])
        size *= 2


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same least gram: the gram's hash, the run's first window, its number of windows, and
    whether windows of the run can be equal to one another (only if the gram is there twice).

    A run ends where the least hash changes, not its place, so periodic text makes no more records than other text.
    """
    found = [_anchors(data[s : s + CHUNK + length - 1], length, gram, s) for s in range(0, len(data) - length + 1, CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (*(np.zeros(0, dtype=np.int64),) * 3, np.zeros(0, dtype=bool))


def _anchors(data: np.ndarray, length: int, gram: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    g = rolling(data, gram)
    low = (g >> POSITION_BITS << POSITION_BITS) | np.arange(len(g), dtype=np.uint64)  # ties: the leftmost
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
    moved = np.flatnonzero(np.diff(at)) + 1
    place = np.concatenate([[0], moved])
    value = g[at[place]]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    first = place[new]
    n, own = np.diff(np.append(first, len(at))), np.diff(np.append(np.flatnonzero(new), len(place))) > 1
    pieces = -(-n // RECORD)
    value, own = np.repeat(value[new], pieces), np.repeat(own, pieces)
    within = RECORD * (np.arange(len(value)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return value.view(np.int64), offset + np.repeat(first, pieces) + within, np.minimum(np.repeat(n, pieces) - within, RECORD), own


def _head(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first digit of the windows at ``starts``: their first eight bytes as a number, or the first word's hash."""
    if data.dtype != np.uint8:
        return data[starts]
    out = data[starts].astype(np.uint64)
    for k in range(1, 8):
        out = out << np.uint64(8) | data[starts + k]
    return out


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which windows at ``a`` may have other items than those at ``b``; never silent where they have.

    Where both go on by one item from the pair before, only the last item is new. A run of such pairs is
    marked as a whole.
    """
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])) if len(a) else np.zeros(0, dtype=np.int64)
    differ = data[a + length - 1] != data[b + length - 1]
    every = np.lib.stride_tricks.sliding_window_view(data, length)
    for at in range(0, len(begin), 8192):
        some = begin[at : at + 8192]
        differ[some] |= (every[a[some]] != every[b[some]]).any(axis=1)
    if len(begin):
        differ = np.repeat(np.logical_or.reduceat(differ, begin), np.diff(np.append(begin, len(a))))
    out = np.zeros(len(a), dtype=bool)
    out[order] = differ
    return out


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``starts`` are equal to another of their ``group`` (equal windows have equal groups).

    Most significant digit first: eight bytes as they are, then the two halves by hash. Windows that are alone
    in their group leave after each pass. What is left is compared by content with the first of its group, and a
    group in which anything differs is told apart by its contents.
    """
    step = _step(length)
    hashes = rolling(data, step)
    alive, rank = np.arange(len(starts)), group
    for digit in (lambda at: _head(data, at), lambda at: hashes[at], lambda at: hashes[at + length - step]):
        d = digit(starts[alive])
        order = np.lexsort((d, rank))
        d, r = d[order], rank[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])]) if len(d) else np.zeros(0, dtype=bool)
        single = new & np.append(new[1:], True)[: len(new)]
        alive, rank = alive[order][~single], np.cumsum(new)[~single]
    out = np.zeros(len(starts), dtype=bool)
    out[alive] = True
    if len(alive):
        new = np.concatenate([[True], rank[1:] != rank[:-1]])
        first = np.repeat(alive[new], np.diff(np.append(np.flatnonzero(new), len(alive))))
        differ = _differ(data, starts[alive[~new]], starts[first[~new]], length)
        unsure = alive[np.isin(rank, rank[~new][differ])]
        contents = [data[at : at + length].tobytes() for at in starts[unsure]]
        count = Counter(contents)
        out[unsure] = [count[c] > 1 for c in contents]
    return out


def _windows(b: dict[str, list], unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All contexts in one array, and for each window: its start there, its row, its place in the document."""
    data = np.frombuffer(b"".join(b["context"]), dtype=np.uint8 if unit.size == 1 else np.uint64)
    size = np.array([len(x) for x in b["context"]]) // unit.size
    n = np.array(b["n"])
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return data, (np.cumsum(size) - size)[row] + within, row, np.array(b["first"])[row] + within


@tidy
def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = 16 << 20, passage_words: int | None = None) -> DataFrame:
    """What is left of each text when every byte in a repeated ``length``-byte string is removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, trimmed (anything was removed); with
    ``passage_words`` also n_passage_words, the words covered by passages of so many words that occur anywhere
    else (they are counted, not removed); and, if ``with_text``, the kept bytes (binary, since a span can end
    inside a character). A string counts as repeated if it also starts anywhere else,
    in another row or the same one, overlaps included; all strings are judged on the input. Null texts are
    empty; texts shorter than ``length`` lose nothing; equal texts in two rows, if long enough, go whole.
    Null ids and repeated rows are rows like any other; very long texts are looked at in chunks. An empty
    table gives no rows.

    Grams whose records have more than ``hot`` bytes are not gathered in a task: the passes over their
    windows are exchanges. The windows are the same ones, and so is the result.
    """
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), key.alias("key"))
    distinct = docs.select(key.alias("key"), text.cast("binary").alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # As many buckets as shuffle partitions: the aggregation's exchange already puts each bucket into one task.
    texts = bucketed(distinct, "texts", "key")

    spans, scratch = _spans(texts, length, BYTE, hot)
    found = texts.join(spans, "key", "left")
    if passage_words:
        passages, more = _spans(texts, passage_words, WORD, hot)
        found, scratch = found.join(passages.withColumnRenamed("spans", "passages"), "key", "left"), scratch + more
    else:
        found = found.withColumn("passages", F.lit(None))
    found = found.select("key", "text", "copies", "spans", F.col("passages").cast("array<struct<start:int,stop:int>>").alias("passages"))
    schema = "key binary, n_removed long, n_spans long, kept_sha256 string" + (", n_passage_words long" if passage_words else "") + (", kept binary" if with_text else "")
    out_arrow = to_arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512).to_pydict()
                out: dict[str, list] = {f.name: [] for f in out_arrow}
                for k, t, copies, spans, passages in zip(*(b[c] for c in ("key", "text", "copies", "spans", "passages")), strict=True):
                    kept, n = _kept(t, spans if copies == 1 or len(t) < length else [{"start": 0, "stop": len(t) - length + 1}], length)
                    for name, x in (("key", k), ("n_removed", len(t) - len(kept)), ("n_spans", n), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                        if name in out:
                            out[name].append(x)
                    if passage_words:
                        n_words = len(t.split()) if copies > 1 else 0
                        out["n_passage_words"].append(n_words if n_words >= passage_words else _covered(passages, passage_words))
                yield pack(out, out_arrow)

    done = stored(found.mapInArrow(cut, schema), "trimmed")
    discard(texts, *scratch)
    more = [*(["n_passage_words"] if passage_words else []), *(["kept"] if with_text else [])]
    return rows.join(done, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("trimmed"), *more)


def _spans(texts: DataFrame, length: int, unit: Unit, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """The spans of window starts that are repeated, a list for each text that has any; and the stored tables they are read from."""
    arrow = to_arrow(ANCHORS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                keys, out = [], []
                for k, t in zip(b.column(0).slice(at, 512).to_pylist(), b.column(1).slice(at, 512).to_pylist(), strict=True):
                    found = anchors(unit.items(t), length, unit.gram)
                    keys += [k] * len(found[0])
                    out.append(found)
                gram, first, n, own = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pack({"gram": gram, "key": keys, "first": first.astype(np.int32), "n": n.astype(np.int32), "own": own}, arrow)

    found = stored(texts.filter(F.octet_length("text") >= length).select("key", "text").mapInArrow(find, ANCHORS), "anchors")
    n_bytes = F.sum((F.col("n") + (length - 1)).cast("long") * unit.size)
    live = stored(found.groupBy("gram").agg(F.count("*").alias("members"), n_bytes.alias("bytes"), F.bool_or("own").alias("own")).filter("members > 1 or own").select("gram", "bytes"), "live-grams")
    records = stored(found.drop("own").join(live, "gram"), "live-anchors")
    discard(found, live)
    used = [records]
    runs = _runs(texts, records.filter(F.col("bytes") <= hot).drop("bytes"), length, unit)
    if not records.filter(F.col("bytes") > hot).isEmpty():
        hot_runs, more = _hot_runs(texts, records.filter(F.col("bytes") > hot).drop("bytes"), length, unit)
        runs, used = runs.union(hot_runs), used + more
    return runs.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).hint("shuffle_hash"), used


def _covered(spans: list[dict] | None, length: int) -> int:
    """Items inside any window that starts in ``spans``."""
    n = at = 0
    for start, stop in sorted((s["start"], s["stop"] - 1 + length) for s in spans or ()):
        n += max(0, stop - max(at, start))
        at = max(at, stop)
    return n


def _kept(text: bytes, spans: list[dict] | None, length: int) -> tuple[bytes, int]:
    """The bytes outside all windows that start in ``spans``, and the number of maximal removed runs."""
    out, at, n = [], 0, 0
    for start, stop in sorted((s["start"], s["stop"] - 1 + length) for s in spans or ()):
        if start > at or not n:
            out.append(text[at:start])
            n += 1
        at = max(at, stop)
    return b"".join(out) + text[at:], n


def _contexts(texts: DataFrame, found: DataFrame, length: int, unit: Unit) -> DataFrame:
    """Each record with the items of all its windows, cut from its text."""
    lists = found.groupBy("key").agg(F.collect_list(F.struct("gram", "first", "n")).alias("places")).hint("shuffle_hash")
    arrow = to_arrow(CONTEXTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128).to_pydict()
                texts_of = zip(b["key"], map(unit.items, b["text"]), b["places"], strict=True)
                every = [(p["gram"], k, p["first"], p["n"], t[p["first"] : p["first"] + p["n"] - 1 + length].tobytes()) for k, t, places in texts_of for p in places]
                yield pack(dict(zip(arrow.names, zip(*every, strict=True), strict=True)), arrow)

    return texts.join(lists, "key").select("key", "text", "places").mapInArrow(cut, CONTEXTS)


def _step(length: int) -> int:
    return -(-length // 2)


def _runs(texts: DataFrame, found: DataFrame, length: int, unit: Unit, batch_bytes: int = 8 << 20) -> DataFrame:
    """Runs of repeated windows, group by group of equal grams."""
    arrow, names = to_arrow(RUNS), to_arrow(CONTEXTS).names

    def solve(b: dict[str, list]) -> pa.RecordBatch:
        data, starts, row, place = _windows(b, unit)
        same = repeated(data, starts, np.unique(b["gram"], return_inverse=True)[1][row], length)
        edge = np.concatenate([[True], (row[1:] != row[:-1]) | (same[1:] != same[:-1])])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(same)) - 1
        first, last = first[same[first]], last[same[first]]
        return pack({"key": [b["key"][i] for i in row[first]], "start": place[first].astype(np.int32), "stop": (place[last] + 1).astype(np.int32)}, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list] = {n: [] for n in names}
        n_bytes, gram = 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048).to_pydict()
                for x in zip(*b.values(), strict=True):
                    if n_bytes >= batch_bytes and x[0] != gram:  # only whole groups
                        yield solve(have)
                        have, n_bytes = {n: [] for n in have}, 0
                    gram = x[0]
                    n_bytes += len(x[4])
                    for n, v in zip(have, x, strict=True):
                        have[n].append(v)
        if have["gram"]:
            yield solve(have)

    spark = texts.sparkSession
    return _contexts(texts, found, length, unit).repartition(parts(spark), "gram").sortWithinPartitions("gram").mapInArrow(run, RUNS)


def _hot_runs(texts: DataFrame, found: DataFrame, length: int, unit: Unit) -> tuple[DataFrame, list[DataFrame]]:
    """Repeated windows of very frequent grams, and the stored tables they are read from.

    Each pass deals the windows by one more digit and drops those that are alone with it. Windows that are
    equal within one record are known to be repeated; one row stands for them.
    """
    schema, step = "high long, low long, key binary, start int, stop int, n int", _step(length)
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024).to_pydict()
                data, starts, row, place = _windows(b, unit)
                d = rolling(data, step).view(np.int64)
                high, low = d[starts], d[starts + length - step]
                order = np.lexsort((low, high, row))
                first = np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)])
                size = np.diff(np.append(np.flatnonzero(first), len(order)))
                single, again = order[first][size == 1], order[first][size > 1]
                known = np.zeros(len(order), dtype=bool)
                known[order] = np.repeat(size > 1, size)
                begin = np.flatnonzero(known & np.concatenate([[True], ~known[:-1] | (np.diff(row) != 0)]))
                end = np.flatnonzero(known & np.append(~known[1:] | (np.diff(row) != 0), True))
                asked, none = np.concatenate([single, again]), [None] * len(begin)
                yield pack({
                    "high": high[asked].tolist() + none, "low": low[asked].tolist() + none, "key": [b["key"][i] for i in np.concatenate([row[asked], row[begin]])],
                    "start": np.concatenate([place[asked], place[begin]]).astype(np.int32), "stop": np.concatenate([place[asked], place[end]]).astype(np.int32) + 1,
                    "n": np.concatenate([np.ones(len(single)), np.full(len(again), 2), np.zeros(len(begin))]).astype(np.int32),
                }, arrow)

    windows = stored(_contexts(texts, found, length, unit).mapInArrow(run, schema), "hot-windows")
    used, alive = [windows], windows.filter("n > 0")
    for digits in (["high"], ["high", "low"]):
        several = stored(alive.groupBy(*digits).agg(F.sum("n").alias("k")).filter("k > 1").drop("k"), "digit-groups")
        alive = stored(alive.join(several, digits), "digit-pass")
        used += [several, alive]
    return windows.filter("n = 0").union(alive.select(windows.columns)).select("key", "start", "stop"), used
