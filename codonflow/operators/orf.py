"""Reading frames in label sequences, and their way back to the genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonflow.functions.labels import START, STOP, TRANSITIONS, shift_out
from codonflow.operators.intervals import exon_offsets
from codonflow.operators.keys import keyed, shared


def explode_labels(dense: DataFrame, key: str = "tx_id", labels: str = "labels") -> DataFrame:
    return dense.select(*keyed(dense, key), F.posexplode(labels).alias("pos", "label")).withColumn("pos", F.col("pos").cast("long"))


def extract_orfs(rows: DataFrame, key: str = "seq_id") -> DataFrame:
    """Half-open ORFs of label rows (key, pos, label): a START, any coding labels, a STOP.

    Coding labels may be missing or out of order; another START begins again. Only the rows that are not
    coding are sorted.
    """
    marks = rows.filter(~F.col("label").isin(2, 3, 4))
    before = F.lag(F.struct("label", "pos")).over(Window.partitionBy(*keyed(rows, key)).orderBy("pos"))
    found = marks.withColumn("_b", before).filter((F.col("label") == STOP) & (F.col("_b.label") == START))
    return found.select(*keyed(rows, key), F.col("_b.pos").alias("orf_start"), (F.col("pos") + 1).alias("orf_end"))


#: An ORF in a string of labels: a START, any coding labels, a STOP.
FRAME = "1[234]*5"


def find_orfs(packed: DataFrame, key: str = "tx_id", labels: str = "labels") -> DataFrame:
    """The ORFs that ``extract_orfs`` finds, from one string of label digits a sequence.

    They are found run by run inside the row: nothing is exchanged, and no row stands for a base. A null
    string has none.
    """
    hits = F.regexp_extract_all(F.col(labels), F.lit(FRAME), F.lit(0))
    sizes = packed.select(*keyed(packed, key), F.transform(F.split(F.col(labels), FRAME, -1), F.length).alias("gaps"), F.transform(hits, F.length).alias("hits"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        found = F.struct(start.alias("orf_start"), (start + x["hit"]).alias("orf_end"))
        return F.struct((start + x["hit"]).alias("at"), F.concat(done["found"], F.array(found)).alias("found"))

    pairs = F.zip_with(F.slice("gaps", F.lit(1), F.size("hits")), "hits", lambda g, h: F.struct(g.cast("long").alias("gap"), h.cast("long").alias("hit")))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<orf_start:bigint,orf_end:bigint>>").alias("found"))
    return sizes.filter(F.size("hits") > 0).select(*keyed(packed, key), F.inline(F.aggregate(pairs, none, step)["found"]))


def transition_audit(rows: DataFrame, transitions: str = "reference", key: str = "seq_id") -> DataFrame:
    """Counts of adjacent label pairs that the transition table forbids."""
    w = Window.partitionBy(*keyed(rows, key)).orderBy("pos")
    pairs = rows.withColumn("from_label", F.lag("label").over(w)).filter(F.col("from_label").isNotNull()).withColumnRenamed("label", "to_label")
    allowed = rows.sparkSession.createDataFrame(TRANSITIONS[transitions], "from_label int, to_label int")
    bad = pairs.join(F.broadcast(allowed), ["from_label", "to_label"], "left_anti")
    return bad.groupBy("from_label", "to_label").agg(F.count("*").alias("n"))


def orf_segments(orfs: DataFrame, tx_exon: DataFrame) -> DataFrame:
    """Genomic segments of transcript ORFs (tid, orf_start, orf_end), for transcripts with exons.

    ``frame`` is the distance of the segment's first base from the ORF's start modulo 3, ``phase`` the
    bases until the next codon begins.
    """
    both = exon_offsets(tx_exon).join(orfs, shared(tx_exon, orfs, "tid"))
    low, high = F.greatest("orf_start", "tx_offset"), F.least(F.col("orf_end"), F.col("tx_offset") + F.col("end") - F.col("start"))
    first, last = low - F.col("tx_offset"), high - F.col("tx_offset")
    forward = F.col("strand") == "+"
    out = both.filter(low < high).select(
        *keyed(both, "tid"), "contig", "strand", "orf_start", "orf_end",
        F.when(forward, F.col("start") + first).otherwise(F.col("end") - last).alias("start"),
        F.when(forward, F.col("start") + last).otherwise(F.col("end") - first).alias("end"),
        ((low - F.col("orf_start")) % 3).cast("int").alias("frame"),
    )
    return out.withColumn("phase", ((3 - F.col("frame")) % 3).cast("int"))


def gtf_lines(segments: DataFrame, source: str = "codonflow", frame_mode: str = "frame") -> DataFrame:
    """One nine-column CDS line a segment, 1-based inclusive; ``frame_mode`` is ``frame`` or ``phase``."""
    name = F.col("tid").cast("string")
    first, last = shift_out(F.col("start"), F.col("end"))
    line = F.concat_ws("\t", "contig", F.lit(source), F.lit("CDS"), first.cast("string"), last.cast("string"), F.lit("."), "strand", F.col(frame_mode).cast("string"), F.concat(F.lit('transcript_id "'), name, F.lit('"; gene_id "'), name, F.lit('";')))
    return segments.select(*keyed(segments, "tid"), "start", line.alias("line"))


def write_gtf(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Text files in the order of transcript ids, as binary strings, then position; ``spark.sql.shuffle.partitions`` of them unless told otherwise."""
    order = F.col("tid").cast("string")
    count = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(count, order).sortWithinPartitions(order, "start").select("line").write.text(path)
