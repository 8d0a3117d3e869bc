"""Sequence files and genome tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codonflow.functions.labels import reverse_complement
from codonflow.operators.keys import keyed, read_lines, shared

TILE = 65_536


def read_fasta(spark: SparkSession, paths: str | list[str], root: str | None = None) -> DataFrame:
    """tx_id (header up to the first white space) and seq; bodies of several lines are joined, the last of equal ids wins.

    Files in ``species=<name>`` folders (under ``root``) have the species as a column, and ids are told
    apart by it.
    """
    raw = read_lines(spark, paths, root, lineSep="\n>")
    raw = raw.select(*keyed(raw, "value"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    record = F.regexp_replace("value", "^>", "")
    rows = raw.withColumn("_r", record).filter(F.trim(F.regexp_replace("_r", r"[\r\n]", "")) != "")
    rows = rows.select(*keyed(raw), F.regexp_extract("_r", r"^[ \t]*(\S*)", 1).alias("tx_id"), F.regexp_replace(F.regexp_replace("_r", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"), "_at")
    return rows.groupBy(*keyed(rows, "tx_id")).agg(F.max_by("seq", "_at").alias("seq"))


def _line_pieces(raw: DataFrame, width: int) -> DataFrame:
    """Bases of FASTA lines (value, path, block) as pieces of at most ``width`` or one line, with their place since the last header.

    ``record`` counts the headers of a block of a file; 0 goes on with the contig of an earlier block. A row
    without bases stands for each header and for each block that begins without one. A block's lines follow
    one another in a task, so nothing is exchanged.
    """
    carried = [c for c in raw.columns if c != "value"]
    schema = T.StructType([*[raw.schema[c] for c in carried], *T.StructType.fromDDL("record int, contig string, place long, bases string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, record, contig, place, held, size, out = None, 0, None, 0, [], 0, []

        def flush() -> None:
            nonlocal place, held, size
            if held:
                out.append((*source, record, contig, place, "".join(held)))
            place, held, size = place + size, [], 0

        for b in batches:
            for *at, line in zip(*(b.column(c).to_pylist() for c in (*carried, "value")), strict=True):
                if at != source:
                    flush()
                    source, record, contig, place = at, 0, None, 0
                    out.append((*source, 0, None, 0, ""))
                if line.startswith(">"):
                    flush()
                    record, contig, place = record + 1, (line[1:].split() or [""])[0], 0
                    out.append((*source, record, contig, 0, ""))
                    continue
                bases = "".join(line.split())
                if held and size + len(bases) > width:
                    flush()
                if bases:
                    held.append(bases)
                    size += len(bases)
            if out:
                yield _rows(out, arrow)
                out = []
        flush()
        if out:
            yield _rows(out, arrow)

    return raw.mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fasta_tiles(spark: SparkSession, paths: str | list[str], width: int = TILE, root: str | None = None) -> DataFrame:
    """(species,) contig, tile, seq of FASTA files of any size: the tiles that ``genome_tiles`` cuts, without a row that holds a contig.

    Files are read by lines in as many blocks as the file source splits them into. A contig that goes on in
    a block begins there at the sum of what earlier blocks have of it, which takes one row a block. Pieces
    are cut where tiles begin, and a tile joins its pieces. Of equal ids the last record wins, as in
    ``read_fasta``; a record without bases has no tiles. No row is longer than a line or a tile.
    """
    raw = read_lines(spark, paths, root)
    raw = raw.select(*keyed(raw, "value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    pieces = _line_pieces(raw, width)
    file = keyed(pieces, "path")
    records = pieces.groupBy(*file, "block", "record").agg(F.max("contig").alias("contig"), F.sum(F.length("bases")).alias("n"))
    ends = records.groupBy(*file, "block").agg(F.max_by(F.struct("record", "contig", "n"), "record").alias("last"))
    # A run of blocks in which no header comes after the first one: its contig goes on through them.
    begun = ends.withColumn("_new", (F.col("last.record") > 0).cast("long"))
    order = Window.partitionBy(*file).orderBy("block")
    runs = begun.withColumn("_run", F.sum("_new").over(order))
    inside = Window.partitionBy(*file, "_run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(*file, "block", F.struct(F.first("last.contig").over(inside).alias("contig"), F.first("block").over(inside).alias("first"), F.first("last.record").over(inside).alias("record"), F.sum("last.n").over(inside).alias("base")).alias("before"))
    carry = runs.select(*file, "block", F.lag("before").over(order).alias("before"))
    first = F.col("record") == 0
    known = pieces.join(carry, [*file, "block"], "left").select(
        *file, F.when(first, F.col("before.contig")).otherwise(F.col("contig")).alias("contig"),
        F.when(first, F.col("before.first")).otherwise(F.col("block")).alias("block"), F.when(first, F.col("before.record")).otherwise(F.col("record")).alias("record"),
        (F.col("place") + F.when(first, F.col("before.base")).otherwise(0)).alias("at"), "bases",
    ).filter("contig is not null")
    start = ["path", "block", "record"]
    names = keyed(pieces, "contig")
    wins = records.filter("record > 0").groupBy(*names).agg(F.max(F.struct(*start)).alias("w")).select(*names, "w.*")
    own = known.filter("bases != ''").join(wins, [*names, *start], "left_semi")
    return _joined_tiles(own.select(*names, "at", F.col("bases").alias("seq")), names, width)


def _joined_tiles(pieces: DataFrame, names: list[str], width: int) -> DataFrame:
    """``pieces`` (at, seq) of contigs, cut where tiles begin and joined to tiles."""
    first = (width - F.col("at") % width).cast("int")
    cuts = F.concat(F.array(F.substring(F.col("seq"), F.lit(1), first)), F.regexp_extract_all(F.substring(F.col("seq"), first + 1, F.length("seq")), F.lit(f"(?s).{{1,{width}}}"), F.lit(0)))
    cut = pieces.select(*names, "at", F.posexplode(cuts).alias("k", "piece"))
    cut = cut.select(*names, (F.floor(F.col("at") / width) + F.col("k")).alias("tile"), F.struct(F.when(F.col("k") == 0, F.col("at") % width).otherwise(0).alias("place"), "piece").alias("p"))
    whole = cut.groupBy(*names, "tile").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select(*names, "tile", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))


def fasta_records(sequences: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """tx_id and record of each sequence; only of the ids in ``kept`` if given."""
    rows = sequences
    if kept is not None:
        keys = shared(sequences, kept, "tx_id")
        rows = sequences.join(kept.select(*keys), keys, "left_semi")
    return rows.select(*keyed(rows, "tx_id"), F.concat(F.lit(">"), "tx_id", F.lit("\n"), "seq").alias("record"))


def write_fasta(sequences: DataFrame, path: str, kept: DataFrame | None = None) -> int:
    """Write one record a sequence, only of the ids in ``kept`` if given; the number of records written."""
    seen = Observation()
    fasta_records(sequences, kept).select(F.col("record").alias("value")).observe(seen, F.count("*").alias("n")).write.text(path)
    return seen.get["n"]


def genome_tiles(genome: DataFrame, width: int = TILE) -> DataFrame:
    """(contig, seq) to fixed-width tiles (contig, tile, seq), so that later rows stay small."""
    n = F.length("seq")
    tiles = genome.filter(n > 0).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / width))))
    return tiles.select(*keyed(genome, "contig"), "tile", F.substring(F.col("seq"), (F.col("tile") * width + 1).cast("int"), F.lit(width)).alias("seq"))


def document_tiles(documents: DataFrame, width: int = TILE, ids_a_range: int = 25_000) -> DataFrame:
    """(contig, d, seq) to the tiles of contigs made by joining each contig's sequences in the order of d; no row holds a contig.

    A sequence's offset in its contig is the length of all earlier ranges of d plus that of the rows before
    it in its own range. Sequences are cut where tiles begin, and each tile joins its pieces.
    """
    rows = documents.select("contig", "d", "seq", F.length("seq").cast("long").alias("n"), F.floor(F.col("d") / ids_a_range).alias("range")).filter("n > 0")
    totals = rows.groupBy("contig", "range").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("contig").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("contig", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("contig", "range").orderBy("d", "seq").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, ["contig", "range"]).withColumn("at", F.col("base") + F.col("inner"))
    return _joined_tiles(at, ["contig"], width)


def splice(tx_exon: DataFrame, tiles: DataFrame, width: int = TILE) -> DataFrame:
    """tid and the spliced sequence of its exons, reverse-complemented unless the strand is '+'."""
    cut = tx_exon.filter("start < end").withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    low, high = F.greatest(F.col("start"), F.col("tile") * width), F.least(F.col("end"), (F.col("tile") + 1) * width)
    own = keyed(tx_exon, "tid")
    pieces = cut.join(tiles, shared(cut, tiles, "contig", "tile")).select(*own, "strand", low.alias("at"), F.substring(F.col("seq"), (low - F.col("tile") * width + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    whole = pieces.groupBy(*own).agg(F.first("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return whole.select(*own, F.when(F.col("strand") == "+", seq).otherwise(reverse_complement(seq)).alias("seq"))
