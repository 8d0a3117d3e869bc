"""Near-duplicate groups by min-max hashing of word n-gram sets.

Each permutation of the hash space gives two values of a set: its least and its greatest element. Both agree
for two sets with a probability of about their Jaccard similarity, and hardly depend on one another, so a
signature takes half the hash evaluations that minima alone would take. Values are banded; sets that agree
on a whole band meet in a list, and links are confirmed on the full sets.

With ``BANDS`` bands of ``WIDTH`` permutations two sets at a similarity of 0.8 miss one another in all bands
with a probability below 1e-9 (5e-9 where they have five elements); more alike ones with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.llm.common import pack, stored, tidy, to_arrow
from codonflow.llm.ngram_join import K1, K2, Keys, gram_set, group_lists, histogram, postings, set_id

BANDS, WIDTH = 80, 3
#: Elements that are hashed at a time, so that a step stays in the processor's cache.
CHUNK = 512


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """``n`` permutations x -> (x ^ c) * a of 32-bit numbers; a is odd."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def signature(grams: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Least and greatest value of the set under each permutation: uint32 [permutations, 2]."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(a), 2), dtype=np.uint32)
    out[:, 0], out[:, 1] = 0xFFFFFFFF, 0
    for at in range(0, len(x), CHUNK):
        y = x[None, at : at + CHUNK] ^ c
        y *= a
        np.minimum(out[:, 0], y.min(1), out=out[:, 0])
        np.maximum(out[:, 1], y.max(1), out=out[:, 1])
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band, of all its least and greatest values and of its number."""
    v = values.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * K2
    for i in range(v.shape[1]):
        key = (key ^ v[:, i]) * K1
        key ^= key >> np.uint64(29)
    return key * K2


def _signed(docs: DataFrame, words: int, lower: bool, percent: int, bands: int, width: int) -> DataFrame:
    """doc_id, rid (the set's hash), n, sketch and the packed band keys of every row, in one pass over the texts."""
    schema = "doc_id long, rid long, n int, sketch binary, bands binary"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = permutations(bands * width)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, grams = b.column(0).slice(at, 512), [gram_set(t, words, lower) for t in b.column(1).slice(at, 512).to_pylist()]
                keys = [band_keys(signature(g, a, c), bands).tobytes() if len(g) else b"" for g in grams]
                yield pack({"doc_id": ids, "rid": [set_id(g) for g in grams], "n": [len(g) for g in grams], "sketch": [histogram(g, percent) for g in grams], "bands": keys}, arrow)

    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "signatures")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Keys:
    """The keys of rows (rid, n, bands)."""
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            rid, n, bands = b.slice(at, 4096).columns
            size = bands.binary_length().to_numpy(zero_copy_only=False) // 8 if hasattr(bands, "binary_length") else np.array([len(x) // 8 for x in bands.to_pylist()])
            keys = np.frombuffer(b"".join(bands.to_pylist()), dtype=np.uint64)
            yield keys, np.repeat(rid.to_numpy(), size), np.repeat(n.to_numpy(), size)


@tidy
def minmax_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, width: int = WIDTH, rounds: tuple[int | None, ...] = (4, None)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of its component) of every row of ``docs``; its other columns, whatever their names, play no part.

    A set is the distinct ``words``-word shingles of the whole text (A-Z lower-cased if ``lower``), or the
    whole word sequence if it has fewer words. Two rows are linked when 100 * intersection >= ``percent`` *
    union of their full sets; component_id is the smallest id reachable by links. Rows without words or text
    have no shingles, are linked with nothing and are their own component. Rows with a null id link others,
    take the smallest id of their component, and are kept only where it has none. Repeated rows are equal
    sets and are all kept or all dropped. A very long text is one set like any other. An empty table gives
    no rows.

    Equal sets are one class. A list holds the classes that agree on a band; those with the same members
    are one. However long it is, its members are compared with one of them, and as long as they are in
    different components also with one another: no cap on candidates.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _signed(docs, words, lower, percent, bands, width)
    total = found.filter("n > 0").count() * bands
    posted = postings(found.select("rid", "n", "bands"), _unpacked, total)
    out = group_lists(docs, words, lower, percent, found.select("doc_id", "rid", "n", "sketch"), posted, rounds, few_lists=True)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
