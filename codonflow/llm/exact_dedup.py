"""Exact deduplication by Grace hashing.

Records are combined where they are read (an open-addressing table that compares complete texts) and
partitioned by hash into buckets, a task each. A bucket whose distinct texts outgrow the table is spilled
to the shared folder and partitioned again by another hash, until every bucket fits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.llm.common import pack, parts, stored, tidy, to_arrow

PARTIAL = "h long, text binary, keep_id long, keep_rows long, group_size long"
#: A class has no text; a spilled record has no sha.
FITTED = "sha binary, h long, text binary, keep_id long, keep_rows long, group_size long"


#: What an entry of the table takes beside its text: objects, slots and list places (measured: 180 bytes).
ENTRY_BYTES = 200


class ContentTable:
    """Open addressing with linear probing; a slot matches only if its complete content is equal."""

    def __init__(self, slots: int = 1024) -> None:
        self.clear(slots)

    def clear(self, slots: int = 1024) -> None:
        self.slot = [-1] * slots
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.keep: list[int | None] = []
        self.rows: list[int] = []
        self.size: list[int] = []
        self.n_bytes = 0

    def __len__(self) -> int:
        return len(self.texts)

    def _grow(self) -> None:
        n = 2 * len(self.slot)
        self.slot = [-1] * n
        for at, h in enumerate(self.hashes):
            i = h & (n - 1)
            while self.slot[i] >= 0:
                i = (i + 1) & (n - 1)
            self.slot[i] = at

    def add(self, h: int, text: bytes, keep: int | None, rows: int, size: int) -> None:
        """Count ``size`` rows of a text, of which ``rows`` have the id ``keep``, the largest."""
        if 2 * len(self.texts) >= len(self.slot):
            self._grow()
        mask = len(self.slot) - 1
        i = h & mask
        while (at := self.slot[i]) >= 0:
            if self.hashes[at] == h and self.texts[at] == text:
                if keep == self.keep[at]:
                    self.rows[at] += rows
                elif keep is not None and (self.keep[at] is None or keep > self.keep[at]):
                    self.keep[at], self.rows[at] = keep, rows
                self.size[at] += size
                return
            i = (i + 1) & mask
        self.slot[i] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.keep.append(keep)
        self.rows.append(rows)
        self.size.append(size)
        self.n_bytes += len(text) + ENTRY_BYTES


def _columns(t: ContentTable) -> dict[str, list]:
    return {"keep_id": t.keep, "keep_rows": t.rows, "group_size": t.size}


def _combine(table_bytes: int):
    """Combine equal contents as far as a table reaches; a full one is written out and begun again."""
    arrow = to_arrow(PARTIAL)

    def flush(t: ContentTable) -> pa.RecordBatch:
        out = pack({"h": t.hashes, "text": t.texts} | _columns(t), arrow)
        t.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("h", "text", "keep_id", "keep_rows", "group_size")), strict=True):
                table.add(*row)
                if table.n_bytes >= table_bytes:
                    yield flush(table)
        if len(table):
            yield flush(table)

    return run


def _fit(table_bytes: int):
    """A bucket's classes, or all its records again if its distinct texts outgrow the table.

    Texts of one hash value are not spilled, since no hash could part them.
    """
    arrow = to_arrow(FITTED)

    def write(t: ContentTable, spill: bool) -> pa.RecordBatch:
        none = [None] * len(t)
        out = {"sha": none, "h": t.hashes, "text": t.texts} if spill else {"sha": [hashlib.sha256(x).digest() for x in t.texts], "h": none, "text": none}
        out = pack(out | _columns(t), arrow)
        t.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, spill = ContentTable(), False
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("h", "text", "keep_id", "keep_rows", "group_size")), strict=True):
                table.add(*row)
                if table.n_bytes > table_bytes and (spill or len(set(table.hashes)) > 1):
                    spill = True
                    yield write(table, True)
        if len(table):
            yield write(table, spill)

    return run


@tidy
def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 64 << 20) -> DataFrame:
    """One row for each distinct text: SHA-256, largest id, rows with that id, all rows. Null texts count as empty.

    ``table_bytes`` is what a task's table may hold; four times as many buckets are made as that needs on
    the average, so that few are partitioned again.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = F.lit(1).cast("long")
    rows = docs.select(F.xxhash64(text).alias("h"), text.cast("binary").alias("text"), F.col(id_col).cast("long").alias("keep_id"), one.alias("keep_rows"), one.alias("group_size"))
    todo, total, classes, level = rows, docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0, None, 0
    while True:
        buckets = max(parts(spark), -(-4 * total // table_bytes))
        bucket = F.pmod(F.xxhash64(F.lit(level), F.col("h")), F.lit(buckets)).cast("int")
        dealt = todo.mapInArrow(_combine(table_bytes), PARTIAL).withColumn("bucket", bucket).repartitionById(buckets, F.col("bucket"))
        fitted = stored(dealt.drop("bucket").mapInArrow(_fit(table_bytes), FITTED), "buckets")
        done = fitted.filter("sha is not null").select("sha", "keep_id", "keep_rows", "group_size")
        classes = done if classes is None else classes.union(done)
        todo, level = fitted.filter("sha is null").select("h", "text", "keep_id", "keep_rows", "group_size"), level + 1
        total = todo.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
        if total is None:
            return classes


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the class of its complete text.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the largest id
    stays. Null texts count as empty texts. Rows with a null id count in their group, and stay only if
    no row of the group has an id (keep_id is then null). If the kept id itself occurs on several equal
    rows, all of these are marked kept, since the id does not tell them apart; ``drop_copies`` leaves one.
    A very long text is a record like any other. An empty table gives an empty result; other columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    classes = exact_classes(docs, id_col, text_col)
    return rows.join(classes, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each distinct text, the one with the largest id; all columns stay.

    Of rows with equal id and text any one stays. Null texts count as empty ones; a row with a null id stays
    only if no equal text has an id. An empty table stays empty.
    """
    renamed = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, renamed, strict=True))
    docs = docs.toDF(*renamed)
    text = F.coalesce(F.col(own[text_col]).cast("string"), F.lit(""))
    keys = exact_classes(docs, own[id_col], own[text_col]).select(F.col("sha").alias("key"), "keep_id", "keep_rows")
    rows = docs.withColumn("sha", F.unhex(F.sha2(text.cast("binary"), 256)))
    kept = lambda k: rows.join(k, (F.col("sha") == F.col("key")) & F.col(own[id_col]).cast("long").eqNullSafe(F.col("keep_id")), "left_semi")
    best, twice = kept(keys.filter("keep_rows = 1")), keys.filter("keep_rows > 1")
    if not twice.isEmpty():
        best = best.unionByName(kept(twice).dropDuplicates(["sha"]))
    return best.select(*[F.col(r).alias(c) for c, r in own.items()])
