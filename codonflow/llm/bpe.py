"""Byte-level BPE by monoid tree reduction.

A piece is encoded by halves. Two neighbouring encodings are joined by re-encoding a window around the
boundary, growing it until the tokens just outside provably stay: a token sequence is the encoding of its
bytes exactly if every adjacent pair of tokens is the encoding of its own bytes, so it is enough that the
two pairs at the window's edges are stable. Decoding is concatenation.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.llm.common import to_arrow

ENCODED = "doc_id long, ids array<int>"
#: Bytes up to which the merge loop goes over a plain list, and up to which the tree is not split further.
SHORT, LEAF, NONE = 32, 8, 1 << 62
DECODED = "doc_id long, ids array<int>, decoded binary"
#: Fixed value: the published pattern for which the short cuts of ``Bpe.encode`` hold. Others go through the expression alone.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Bpe:
    """Encoder for one vocabulary; caches are bounded and only save time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 500_000) -> None:
        import regex

        self.ranks, self.cache_size = ranks, cache_size
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.stable: dict[tuple[int, int], bool] = {}
        self.short: dict[bytes, list[int]] = {}
        self.plain, self.spaced = _Cache(self, ""), _Cache(self, " ")
        # A space before a non-space always begins a match of that pattern, so texts are cut there first.
        self.cut = re.compile(r" (?=\S)").split if pattern == WORDS_PATTERN else None

    def greedy(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        if len(data) <= SHORT:
            return self._greedy_short(data)
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (p := before[i]) >= 0 and (r := ranks.get(part[p] + part[i])) is not None:
                heapq.heappush(heap, (r, p, len(part[p]) + len(part[i])))
        return [ranks[x] for x in part if x is not None]

    def _greedy_short(self, data: bytes) -> list[int]:
        known = self.short.get(data)
        if known is not None:
            return known
        get, part = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pair = [get(a + b, NONE) for a, b in zip(part, part[1:], strict=False)]
        while pair and (low := min(pair)) != NONE:
            i = pair.index(low)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(part[i] + part[i + 1], NONE)
            if i:
                pair[i - 1] = get(part[i - 1] + part[i], NONE)
        out = [self.ranks[x] for x in part]
        if len(data) <= 2 * LEAF:
            if len(self.short) > self.cache_size:
                self.short.clear()
            self.short[data] = out
        return out

    def pair_is_stable(self, a: int, b: int) -> bool:
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) > self.cache_size:
                self.stable.clear()
            found = self.stable[a, b] = self.greedy(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the concatenation of what ``a`` and ``b`` encode."""
        if not a or not b or self.pair_is_stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.greedy(self.bytes_of(a[len(a) - i :] + b[:j]))
            left = i == len(a) or self.pair_is_stable(a[-i - 1], window[0])
            right = j == len(b) or self.pair_is_stable(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= LEAF:
            return self._greedy_short(data)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode(self, text: str) -> list[int]:
        """Ids of every match of the pattern, one after another."""
        if self.cut is None:
            return list(chain.from_iterable(self.encode_piece(p.encode()) for p in self.find(text)))
        first, *rest = self.cut(text)
        out = list(chain(self.plain[first], chain.from_iterable(map(self.spaced.__getitem__, rest))))
        for cache in (self.plain, self.spaced):
            if len(cache) > self.cache_size:
                cache.clear()
        return out

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Cache(dict):
    """Ids of ``prefix + key``."""

    def __init__(self, bpe: Bpe, prefix: str) -> None:
        super().__init__()
        self.bpe, self.prefix = bpe, prefix

    def __missing__(self, key: str) -> tuple[int, ...]:
        bpe, text = self.bpe, self.prefix + key
        if key.isalpha():
            pieces = [text]
        elif key[-1:] in (",", ".") and key[:-1].isalpha():
            pieces = [text[:-1], key[-1]]
        else:
            pieces = bpe.find(text)
        out = tuple(chain.from_iterable(bpe.encode_piece(p.encode()) for p in pieces))
        if len(key) <= 64:
            self[key] = out
        return out


_loaded: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, rows: int = 256) -> DataFrame:
    """doc_id and the token ids of the whole text, for every row; with ``decoded`` also the bytes that the ids decode to.

    Null texts count as empty and have no ids. Null ids, repeated rows and empty tables pass through;
    other columns are ignored. ``ranks_path`` is a file of the vocabulary at the same place on each
    executor. Rows are independent: no shuffle.
    """
    schema = DECODED if decoded else ENCODED
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                found = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
                texts = [pa.array([bpe.bytes_of(x) for x in found], type=pa.binary())] if decoded else []
                ids = [np.array(x, dtype=np.int32) for x in found]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), lists.cast(arrow.field("ids").type), *texts], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, rows: int = 256) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes of the ids; null ids give no bytes."""
    arrow = to_arrow(DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array(_bpe(ranks_path, pattern).tokens, dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                lists = b.column(1)
                texts = [b"".join(tokens[x.values.to_numpy(zero_copy_only=False)].tolist()) if x.is_valid else b"" for x in lists]
                yield pa.RecordBatch.from_arrays([b.column(0), lists.cast(arrow.field("ids").type), pa.array(texts, type=pa.binary())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def digests(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token count and SHA-256 of the ids (decimal, one space between) and of the decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *keep)
