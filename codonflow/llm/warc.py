"""WARC archives compressed record by record with a shared Zstandard dictionary.

Each archive is a file of Zstandard frames: first a skippable frame that holds the dictionary, then one
frame for each record. The files are written by Spark's text sink, whose line separator is here an empty
skippable frame; so a file system that Spark can write is enough, and task retries and commits are Spark's.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonflow.llm.common import new_path, pack, stored, tidy, to_arrow

#: Fixed values of the format: magic of the dictionary's skippable frame, of an empty one, of a frame.
DICT_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
EPOCH = "1970-01-01T00:00:00Z"
#: Rows of the text sink that make an archive, and bytes of a row: more than half of the rows are left when an archive is full.
ARCHIVE_ROWS, ROW_SHARE = 1_024, 500
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str) -> str:
    """A header value in one line: control characters and '%' are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _number(value: int | None) -> str:
    return "" if value is None else str(value)


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, payload_digest: str, refers_to: int | None, date: str = EPOCH) -> bytes:
    """One WARC/1.1 record; a revisit (without payload) has no block of its own, and a page without url its name as URI."""
    revisit, block = payload is None, payload or b""
    name = f"urn:page:{_number(page_id)}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {length}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {name}", "X-No-Url: 1"] if url is None else [f"WARC-Target-URI: {_header_text(url)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{_number(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The columns of one record; a response's digest and length are taken from its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    name = lambda x: int(t) if (t := x[len("<urn:page:") : -1]) else None
    kind, revisit = fields["WARC-Type"], fields["WARC-Type"] == "revisit"
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest(block) != told:
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload doesn't have the digest {told}")
    return {"page_id": name(fields["WARC-Record-ID"]), "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(block), "payload_digest": told, "record_type": kind, "refers_to": name(fields["WARC-Refers-To"]) if revisit else None, "target_uri": None if "X-No-Url" in fields else fields["WARC-Target-URI"], "payload": None if revisit else block}


def sample_record(page_id: int | None, url: str | None, payload: bytes, h: int, most: int) -> bytes:
    """A page's record for training, some as revisits; of a longer one its head and a piece at a hashed place."""
    one = record(page_id, url, None if h % 8 == 0 else payload, len(payload), digest(payload), page_id)
    if len(one) <= most:
        return one
    at = most // 2 + h // 8 % (len(one) - most + 1)
    return one[: most // 2] + one[at : at + most // 2]


def train_dictionary(pages: DataFrame, sample_rows: int = 2000, sample_bytes: int = 8192, size: int = 112_640) -> bytes:
    """A Zstandard dictionary from the records of at most ``sample_rows`` pages (smallest hash of the row), at most ``sample_bytes`` of each (both bounds are these parameters).

    Where the samples are too few to train on, their joined text is a raw-content dictionary; without any text it is empty.
    """
    h = F.xxhash64("page_id", "html")
    texts = pages.filter(F.length("html") > 0).select(F.shiftrightunsigned(h, 11).alias("h"), "page_id", "url", F.col("html").cast("binary").alias("html"))
    share = min(1.0, 1.5 * sample_rows / max(1, texts.count()))  # so that the tasks send little more than the sample
    schema = "h long, x binary"
    arrow = to_arrow(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pack({"h": b.column(0), "x": [sample_record(i, u, x, h, sample_bytes) for h, i, u, x in zip(*b.to_pydict().values(), strict=True)]}, arrow)

    chosen = texts.filter(F.col("h") < int(share * (1 << 53))).mapInArrow(build, schema).orderBy("h", "x").limit(sample_rows)
    samples = [bytes(r["x"]) for r in chosen.collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


@tidy
def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = 64 << 20, date: str | None = None) -> None:
    """Write one record for each row of ``pages`` to compressed archives under ``path``.

    Null payloads count as empty. Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the smallest id is a response and the others revisit it; rows with a null id come last, equal
    ids go by url, and of rows that are equal throughout one is the response. An empty table writes
    archives without records.

    The payloads are exchanged once, to meet the first row of their group. A new archive, with a dictionary
    of its own in front, is begun as soon as one has ``archive_bytes``, before or after compression, so
    none has more than that and one record. A very long payload is one record like any other. ``date`` is the WARC-Date of all records, by
    default the time of writing. Further columns, whatever their names, play no part.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    words = train_dictionary(rows)
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = rows.withColumn("place", F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNull().alias("bare")))
    equal = rows.groupBy("sha", "place").agg(F.count("*").alias("n"))
    first = stored(equal.groupBy("sha").agg(F.min(F.struct("place", "n")).alias("first")), "first-pages")
    linked = rows.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary")))).join(first, "sha").withColumn("revisit", (F.col("place") != F.col("first.place")) & (F.octet_length("html") >= min_revisit_bytes))
    twice = F.col("first.n") > 1
    if not first.filter(twice).isEmpty():
        again = (F.col("place") == F.col("first.place")) & twice & (F.octet_length("html") >= min_revisit_bytes)
        copies = linked.filter(again).dropDuplicates(["sha"]).withColumn("revisit", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("first.n")), lambda i: i > 1)))
        linked = linked.filter(~again).unionByName(copies)
    linked = linked.select("page_id", "url", F.when(~F.col("revisit"), F.col("html").cast("binary")).alias("html"), F.octet_length("html").alias("n"), "sha1", F.when(F.col("revisit"), F.col("first.place.id")).alias("refers_to"))
    arrow = to_arrow("frame binary")
    shared = spark.sparkContext.broadcast(words)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        known = zstandard.ZstdCompressionDict(words) if words else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
        lead = struct.pack("<II", DICT_MAGIC, len(words)) + words
        held, size, rows, full, told, begun = [lead], len(lead), 0, 0, 0, False  # of the next row; and what the archive has already, told: before compression
        for b in batches:
            out = []
            for i, u, x, n, sha1, r in zip(*b.to_pydict().values(), strict=True):
                one = record(i, u, x, n, base64.b32encode(sha1).decode(), r, date)
                frame = packer.compress(one)
                held.append(frame)
                size += len(frame)
                told += len(one)
                over = max(full + size + 8 * ARCHIVE_ROWS, told) >= archive_bytes
                if over or size >= archive_bytes // ROW_SHARE:
                    out.append(b"".join(held))
                    held, size, rows, full = [], 0, rows + 1, full + size
                if over:  # the sink begins a new file after ARCHIVE_ROWS rows
                    out += [b""] * (ARCHIVE_ROWS - rows)
                    held, size, rows, full, told = [lead], len(lead), 0, 0, 0
            if out:
                yield pack({"frame": out}, arrow)
                begun = True
        if held and held != [lead] or not begun:
            yield pack({"frame": [b"".join(held)]}, arrow)

    frames = linked.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME).option("compression", "none").option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


def frames_of(raw: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one by one."""
    at, packer = 0, zstandard.ZstdDecompressor()
    while at < len(raw):
        magic, size = struct.unpack_from("<II", raw, at)
        if magic == DICT_MAGIC and size:
            packer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[at + 8 : at + 8 + size]))
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            at += 8 + size
            continue
        one, out = packer.decompressobj(), []
        while not one.eof:
            chunk = raw[at : at + 16_384]
            if not chunk:
                raise ValueError("the archive ends within a record")
            out.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri and payload (null for revisits) of every record."""
    arrow = to_arrow(RECORDS)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                rows: list[dict] = []
                for x in frames_of(raw.as_py()):
                    rows.append(parse(x))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(unpack, RECORDS)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` written to new archives in the shared folder and read back; odd rows are as in ``write_archives``."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return read_archives(spark, path)
