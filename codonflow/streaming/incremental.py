"""Incremental labelling: new species arrive as files and are each labelled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codonflow.operators.keys import keyed
from codonflow.operators.labeling import category_stats
from codonflow.sources.annotation import exon_table, read_features

ARRIVAL = "species string, tid string, contig string, strand string, start long, end long, line_no long"


def label_arrivals(spark: SparkSession, arrivals: str, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int | None = None, stats: str | None = None, manifest: str | None = None) -> StreamingQuery:
    """Label every Parquet file that arrives under ``arrivals`` (schema ARRIVAL, one species a file) into ``out``.

    ``label`` is the batch operator. A batch writes its labels to ``out`` and, where these paths are given,
    their category counts to ``stats`` and the files it labelled to ``manifest``, each to a folder of its own
    that is overwritten when the batch is repeated; so each file counts once even after a restart. The
    query processes what is there and ends.
    """
    reader = spark.readStream.schema(ARRIVAL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def once(batch: DataFrame, number: int) -> None:
        write = lambda df, path: df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        write(label(batch.drop("_file")), out)
        if stats:
            labelled = spark.read.parquet(f"{out}/batch={number}")
            write(category_stats(labelled, tuple(keyed(labelled))), stats)
        if manifest:
            write(batch.groupBy("species", F.col("_file").alias("path")).agg(F.countDistinct("tid").alias("transcripts")), manifest)

    found = reader.parquet(arrivals).withColumn("_file", F.col("_metadata.file_path"))
    return found.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The local part of a file's address, in which manifests and the file source may differ.
LOCAL = "^file:/+"


def label_manifests(spark: SparkSession, manifests: str, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int | None = None, stats: str | None = None) -> StreamingQuery:
    """Label the annotation files that arriving manifests name: text files under ``manifests`` with lines ``species<TAB>path``.

    ``label`` is the batch operator; it gets the exons of the named files with their species and keeps it.
    Labels and, if ``stats`` is given, category counts are stored by species, and a species that is sent
    again replaces itself and nothing else: a batch that is repeated after a restart changes nothing. Of
    several lines of a species in one batch those of the last manifest file count, all of its files
    together. Blank and '#' lines are skipped; a named file that does not exist is an error. The driver holds
    the file names of a batch, which ``files_per_batch`` (manifests a batch) bounds. The query processes what
    is there and ends.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def once(batch: DataFrame, number: int) -> None:
        fields = F.split(F.rtrim(F.regexp_replace("value", "\r$", "")), "\t")
        lines = batch.filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(F.get(fields, F.lit(0)).alias("species"), F.element_at(fields, -1).alias("file"), F.struct("_time", "_manifest").alias("at"))
        last = lines.groupBy("species").agg(F.max("at").alias("at"))
        named = lines.join(last, ["species", "at"], "left_semi").select("species", "file").distinct()
        files = sorted({r["file"] for r in named.select("file").collect()})
        if not files:
            return
        path = lambda c: F.regexp_replace(c, LOCAL, "/")
        exons = exon_table_with_path(spark, files).withColumn("_key", path(F.col("_path")))
        owner = named.select("species", path(F.col("file")).alias("_key"))
        labelled = label(exons.join(owner, "_key").drop("_key", "_path"))
        write = lambda df, place: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("species").parquet(place)
        write(labelled, out)
        if stats:
            stored = spark.read.parquet(out).join(named.select("species").distinct(), "species", "left_semi")
            write(category_stats(stored, ("species",)), stats)

    found = reader.text(manifests).withColumns({"_manifest": F.col("_metadata.file_path"), "_time": F.col("_metadata.file_modification_time")})
    return found.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exon_table_with_path(spark: SparkSession, files: list[str]) -> DataFrame:
    """The exons of annotation files, with the file of each as _path."""
    exons = exon_table(read_features(spark, files).drop("species"))
    return exons.withColumn("_path", F.col("line_no.path"))
