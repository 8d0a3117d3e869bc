"""Annotation files (GTF, GFF3) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonflow.functions.labels import shift_in
from codonflow.operators.keys import keyed, read_lines


def read_features(spark: SparkSession, paths: str | list[str], root: str | None = None) -> DataFrame:
    """One row for each annotation line with at least nine tab-separated fields; blank and '#' lines are skipped.

    ``line_no`` orders lines as the files do: by path, then block, then place in the block. Files in
    ``species=<name>`` folders (under ``root``) have the species as a column.
    """
    raw = read_lines(spark, paths, root)
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return parse_features(raw.select(*keyed(raw, "value"), path.alias("path"), F.struct(path.alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no")))


def parse_features(raw: DataFrame) -> DataFrame:
    """The same from lines (value, line_no) with any other columns, as path or species, which stay."""
    fields = F.split(F.rtrim(F.regexp_replace("value", "\r$", "")), "\t")
    kept = [c for c in raw.columns if c != "value"]
    read = (F.trim("value") != "") & ~F.col("value").startswith("#")
    # A generator is evaluated once a line; filters on plain columns would each split the line again.
    rows = raw.select(*kept, F.explode(F.array(F.when(read, fields))).alias("_f")).filter(F.size("_f") >= 9)
    names = ["contig", "source", "feature", "start", "end", "score", "strand", "frame", "attrs"]
    out = rows.select(*[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)], *kept)
    return out.withColumns({"start": F.col("start").try_cast("long"), "end": F.col("end").try_cast("long")})


def attribute(attrs: Column, key: str) -> Column:
    """The value of ``key`` in an attribute column, the first if it comes twice; null if absent.

    A chunk with '=' and no space before it reads ``key=value``, any other ``key "value"``. One expression
    without a function over arrays, so that Spark compiles it.
    """
    tail = F.nullif(F.regexp_extract(attrs, rf"(?:^|;) *\Q{key}\E((?:=| +[^ ;])[^;]*)", 1), F.lit(""))
    return F.btrim(F.trim(F.substring(tail, 2, 1 << 30)), F.lit('"'))


def unplaced(features: DataFrame) -> DataFrame:
    """The exon, CDS and stop_codon lines whose places cannot be read, or that hold no base; no transcript or reference can have them."""
    start, end = shift_in(F.col("start"), F.col("end"))
    readable = F.coalesce((start >= 0) & (start < end), F.lit(False))
    return features.filter(F.col("feature").isin("exon", "CDS", "stop_codon") & ~readable)


def exon_table(features: DataFrame) -> DataFrame:
    """tid, contig, strand, start, end (0-based half-open), line_no of the exon lines with a transcript id."""
    out = features.filter("feature = 'exon'").withColumn("tid", attribute(F.col("attrs"), "transcript_id"))
    start, end = shift_in(F.col("start"), F.col("end"))
    return out.filter("tid is not null and tid != ''").select(*keyed(out, "tid"), "contig", "strand", start.alias("start"), end.alias("end"), "line_no")


def _reference_parts(features: DataFrame, kind: str) -> DataFrame:
    attrs = F.col("attrs")
    rid = F.coalesce(F.nullif(attribute(attrs, "transcript_id"), F.lit("")), F.nullif(attribute(attrs, "Parent"), F.lit("")))
    out = features.filter(F.col("feature") == kind).withColumn("rid", rid).filter("rid is not null")
    start, end = shift_in(F.col("start"), F.col("end"))
    return out.select(*keyed(out, "rid"), "contig", "strand", start.alias("start"), end.alias("end"), "line_no")


def ref_cds_table(features: DataFrame) -> DataFrame:
    """rid, contig, strand, start, end of the CDS lines; the id is transcript_id, else Parent."""
    return _reference_parts(features, "CDS")


def stop_codon_table(features: DataFrame) -> DataFrame:
    """The stop_codon parts of references that have CDS lines."""
    keys = keyed(features, "rid")
    return _reference_parts(features, "stop_codon").join(ref_cds_table(features).select(*keys).distinct(), keys, "left_semi")
