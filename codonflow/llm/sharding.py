"""Sharding by histogram sort.

Rows are ordered by a 64-bit hash of their text. Candidate key boundaries (probes) are counted exactly,
in parallel, round after round: the tasks count bytes below each probe, and the gaps that hold a wanted
splitter get finer probes, until every splitter is within tolerance or cannot be moved because one key
holds the whole gap. Then the rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.llm.common import pack, parts, stored, tidy, to_arrow

LOW, HIGH = -(1 << 63), 1 << 63
OVERHEAD = 16


def histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) in each of the len(probes) + 1 gaps between the sorted probes."""
    shared = keys.sparkSession.sparkContext.broadcast(np.array(probes, dtype=np.int64))
    arrow = to_arrow("gap int, bytes long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bytes, n_rows = np.zeros(len(shared.value) + 1, dtype=np.int64), np.zeros(len(shared.value) + 1, dtype=np.int64)
        for b in batches:
            gap = np.searchsorted(shared.value, b.column("h").to_numpy(), side="right")
            np.add.at(n_bytes, gap, b.column("size").to_numpy())
            np.add.at(n_rows, gap, 1)
        full = np.flatnonzero(n_rows)
        yield pack({"gap": full.astype(np.int32), "bytes": n_bytes[full], "n": n_rows[full]}, arrow)

    out = [(0, 0)] * (len(probes) + 1)
    for r in keys.select("h", "size").mapInArrow(count, "gap int, bytes long, n long").groupBy("gap").agg(F.sum("bytes"), F.sum("n")).collect():  # one row a gap
        out[r[0]] = (r[1], r[2])
    return out


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, fan: int = 16, max_rounds: int = 24) -> list[int]:
    """The shards - 1 keys at which the shards begin, none more than ``tolerance`` of a shard from its target unless one key's rows are larger than that."""
    probes = [LOW + (HIGH - LOW) * i // (shards * fan) for i in range(1, shards * fan)]
    gaps = histogram(keys, probes)
    total = sum(b for b, _ in gaps)
    edges = [LOW, *probes, HIGH]
    below = np.concatenate([[0], np.cumsum([b for b, _ in gaps])]).tolist()
    wanted = [total * i / shards for i in range(1, shards)]
    slack = tolerance * total / shards
    for _ in range(max_rounds):
        finer: set[int] = set()
        for t in wanted:
            i = int(np.searchsorted(below, t, side="right")) - 1
            i = min(max(i, 0), len(edges) - 2)
            if min(t - below[i], below[i + 1] - t) > slack and edges[i + 1] - edges[i] > 1:
                finer.update(edges[i] + (edges[i + 1] - edges[i]) * j // fan for j in range(1, fan))
        finer -= set(edges)
        if not finer:
            break
        known = dict(zip(edges, below, strict=True))
        probes = sorted(finer | set(edges[1:-1]))
        counts = histogram(keys, probes)
        edges = [LOW, *probes, HIGH]
        below = np.concatenate([[0], np.cumsum([b for b, _ in counts])]).tolist()
        keep = {LOW, HIGH} | finer | {e for t in wanted for e in _around(edges, below, t)} | set(known)
        below, edges = zip(*[(b, e) for e, b in zip(edges, below, strict=True) if e in keep], strict=True)
        below, edges = list(below), list(edges)
    out = []
    for t in wanted:
        lo, hi = _around(edges, below, t)
        at = dict(zip(edges, below, strict=True))
        out.append(lo if t - at[lo] <= at[hi] - t else hi)
    return out


def _around(edges: list[int], below: list[int], target: float) -> tuple[int, int]:
    i = min(max(int(np.searchsorted(below, target, side="right")) - 1, 0), len(edges) - 2)
    return edges[i], edges[i + 1]


@tidy
def histogram_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = (), tolerance: float = 0.001) -> DataFrame:
    """Shards of nearly equal bytes in which equal texts stay together.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32 (null: of the empty
    text), law, shard, slot, grown_shard and the ``payload`` columns (one that clashes with these names
    is left out). A group of equal texts is never split over shards, so a shard can miss its target by up
    to the largest group at its two ends; a group larger than a shard fills one by itself and may leave a
    neighbour empty. Null ids and repeated rows are rows like any other. Slots number a shard's rows from
    0 without gaps. An empty table gives an empty result. Rows of one shard travel in several partitions
    dealt by the id, so a group of copies of any size never meets in one task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    extra = {f"_p{i}": c for i, c in enumerate(payload) if c not in own}  # under names that cannot clash
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(p) for p, c in extra.items()])
    keys = stored(keys, "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    starts = [s for s in splitters if LOW < s < HIGH]
    shift = sum(s <= LOW for s in splitters)
    sizes = histogram(keys, starts)
    n_rows = [0] * shift + [n for _, n in sizes]
    per_part = max(1, sum(n_rows) // max(1, parts(spark)))
    pieces = [max(1, -(-n // per_part)) for n in n_rows]
    first = np.concatenate([[0], np.cumsum(pieces)]).astype(int).tolist()
    bounds = spark.sparkContext.broadcast((np.array(starts, dtype=np.int64), shift))

    @F.pandas_udf("int")
    def shard_of(h):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds.value[0], h.to_numpy(), side="right") + bounds.value[1]).astype("int32")

    dealt = keys.withColumn("shard", shard_of("h"))
    base, spread = F.array(*map(F.lit, first)), F.array(*map(F.lit, pieces))
    part = F.element_at(base, F.col("shard") + 1) + F.pmod(F.xxhash64("doc_id", "_row"), F.element_at(spread, F.col("shard") + 1)).cast("int")
    dealt = dealt.withColumn("_part", part).repartitionById(int(first[-1]), F.col("_part")).sortWithinPartitions("h", "doc_id", "_row")
    dealt = stored(dealt.withColumn("_pos", F.monotonically_increasing_id()), "shards")
    runs = dealt.groupBy("shard", "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))  # one row an exchange partition
    before = []
    at: dict[int, int] = {}
    for r in sorted(runs.collect()):
        before.append((r["_part"], r["_first"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["_n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _first long, _before long"))
    slot = F.col("_pos") - F.col("_first") + F.col("_before")
    return dealt.join(offsets, "_part").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(p).alias(c) for p, c in extra.items()])
