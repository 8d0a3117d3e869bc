"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from codonflow.llm.common import crc_fold, pack, to_arrow

BITS = 20
SCORED = "doc_id long, score double"
#: Odd 64-bit multipliers, one for each place in a gram.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
EDGES = ".,;:!?\"'()[]{}<>*#%&$|_-"


#: Lengths of the word prefixes that are features beside the word, since insults are inflected.
PREFIXES = (3, 4, 5, 7)


class _Words(dict):
    """A word's row in ``table``: 64-bit hashes of the word and of its prefixes. Bounded, it only saves time."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.table = np.zeros((limit, 1 + len(PREFIXES)), dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        bare = word.strip(EDGES) or word
        for j, part in enumerate((bare, *(f"{bare[:k]}~" for k in PREFIXES))):
            raw = part.encode("utf-8", "surrogatepass")
            self.table[at, j] = xxh3_64_intdigest(raw)
        return at

    def hashes(self, words: list[str]) -> np.ndarray:
        out = []
        for i in range(0, max(1, len(words)), 50_000):
            if len(self) > len(self.table) - 50_000:
                self.clear()
            out.append(self.table[np.fromiter(map(self.__getitem__, words[i : i + 50_000]), dtype=np.int64)])
        return np.concatenate(out)


_words = _Words()


def hashed(text: str, bits: int = BITS) -> np.ndarray:
    """Features of the whole text: words, their prefixes, word pairs, and pairs with one or two words between them."""
    all_h = _words.hashes(text.lower().split())
    if not len(all_h):
        return np.zeros(0, dtype=np.int32)
    h = all_h[:, 0]
    out = [all_h.ravel() * MIX[0]]
    out += [(h[:-k] * MIX[0]) ^ (h[k:] * MIX[k]) * MIX[1] for k in (1, 2, 3) if len(h) > k]
    x = np.concatenate(out)
    x ^= x >> np.uint64(29)
    return (x * MIX[2] >> np.uint64(64 - bits)).astype(np.int32)


def grams(text: str) -> np.ndarray:
    """The distinct features, sorted."""
    return np.unique(hashed(text))


class Ftrl:
    """Per-coordinate state z and n; weights follow in closed form, zero where L1 holds."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 16_000, shards: int = 4, rounds: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Nonzero coordinates and their weights; coordinate 2**BITS is the intercept.

    Learns from at most ``max_rows`` labelled rows, those with the smallest hash of the id (a bounded
    sample; the bound is this parameter). In each round ``shards`` tasks go on from the averaged state
    with their own rows, and their states are averaged by coordinate. Rows with a null id or label are
    not learnt from; without labels there are no weights and every score is 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, y double, x array<int>"
    arrow = to_arrow(schema)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield pack({"doc_id": b.column(0), "y": b.column(1), "x": [grams(t or "") for t in b.column(2).to_pylist()]}, arrow)

    rows = text.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(featured, schema)
    shard = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "y").cache()
    size, z, n = (1 << BITS) + 1, np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    state = to_arrow("at binary, z binary, n binary")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((z, n))  # 2**BITS coordinates, whatever the input

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = Ftrl(size, alpha, beta, l1, l2)
            model.z, model.n = shared.value[0].copy(), shared.value[1].copy()
            seen = 0
            for b in batches:
                for y, x in zip(b.column("y").to_pylist(), b.column("x"), strict=True):
                    model.learn(np.append(x.values.to_numpy(), size - 1), y)
                    seen += 1
            if seen:
                at = np.flatnonzero((model.z != shared.value[0]) | (model.n != shared.value[1]))
                moved = (model.z[at] - shared.value[0][at], model.n[at] - shared.value[1][at])
                yield pack({"at": [at.astype(np.int32).tobytes()]} | {k: [v.astype(np.float32).tobytes()] for k, v in zip("zn", moved, strict=True)}, state)

        states = rows.mapInArrow(learn, "at binary, z binary, n binary").cache()
        states.count()  # all shards learn at once; their states then come to the driver one after another
        for r in states.toLocalIterator():  # one packed state a shard, 12 bytes a coordinate at most
            at = np.frombuffer(r["at"], dtype=np.int32)
            z[at] += np.frombuffer(r["z"], dtype=np.float32) / shards
            n[at] += np.frombuffer(r["n"], dtype=np.float32) / shards
        states.unpersist(blocking=True)
        shared.destroy()  # the driver's copy as well
    rows.unpersist()
    model = Ftrl(size, alpha, beta, l1, l2)
    model.z, model.n = z, n
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at]


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null texts score as empty ones. No shuffle."""
    arrow, shared = to_arrow(SCORED), docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[shared.value[0]] = shared.value[1]
        used = w != 0

        def margin(text: str) -> float:
            x = hashed(text)
            return w[np.unique(x[used[x]])].sum() + w[-1]  # few coordinates have a weight

        for b in batches:
            m = np.array([margin(t or "") for t in b.column(1).to_pylist()])
            yield pack({"doc_id": b.column(0), "score": 1 / (1 + np.exp(-np.clip(m, -35, 35)))}, arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only labels of ids whose crc32 is not ``held`` modulo ``folds`` are learnt. Null ids are hashed as the
    empty text and scored like others; repeated rows and equal texts are scored each, alike; a very long text
    counts with every word; an empty table gives no rows.
    """
    out = score(docs, train(docs, labels.filter(crc_fold("doc_id", folds) != held), **options))
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
