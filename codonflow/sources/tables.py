"""Lists, manifests, logs, label stores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonflow.functions.labels import dense_labels
from codonflow.operators.keys import keyed


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the header species,accession,annotation; line ends may be CRLF."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.regexp_replace(F.col(c), "\r$", "").alias(c.rstrip("\r")) for c in df.columns])


def write_species(species: DataFrame, path: str) -> None:
    """One folder of CSV a split."""
    species.select(F.col("name").alias("species"), "accession", "annotation", "split").write.partitionBy("split").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(species, path) of tab-separated lines; blank and '#' lines are skipped, the last column is the path."""
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).withColumn("_f", fields)
    return rows.select(F.when(F.size("_f") > 1, F.get("_f", F.lit(0))).alias("species"), F.element_at("_f", -1).alias("path"))


def write_manifest(stored: DataFrame, path: str) -> None:
    """``species<TAB>file`` of a table read from species folders."""
    stored.select(F.concat_ws("\t", "species", F.col("_metadata.file_path")).alias("value")).distinct().write.text(path)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated logs with a header; run is the name of the folder."""
    df = spark.read.schema("epoch int, accuracy double, loss double, val_accuracy double, val_loss double").csv(path, sep="\t", header=True)
    return df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def _kept_labels(labelled: DataFrame) -> DataFrame:
    kept = labelled.filter(F.col("category").startswith("kept") | (F.col("category") == "ir_only"))
    return kept.select(*keyed(labelled, "tid"), "length", "orf_start", "orf_end")


def write_labels(labelled: DataFrame, path: str) -> None:
    """The sparse label store: length and ORF interval of each kept transcript, with its species if there are several."""
    _kept_labels(labelled).write.parquet(path)


def read_labels(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("labels", dense_labels(F.col("length"), F.col("orf_start"), F.col("orf_end"))) if dense else df


def store_bucketed(df: DataFrame, name: str, key: str = "tx_id", buckets: int | None = None, order: tuple[str, ...] = (), path: str | None = None, mode: str = "errorifexists") -> None:
    """A table of the catalogue in buckets of (species,) ``key``, sorted by them and ``order``.

    Sequences, labels and windows stored with as many buckets each are joined and stitched bucket by bucket:
    no exchange is below the join or the grouping, however often they are read. Rows are dealt before they
    are written as the buckets deal them, so a bucket is one file of each write, not one of each task; a
    species that arrives later is added with the mode ``append``. Unless given, ``buckets`` are
    ``spark.sql.shuffle.partitions``; ``path`` puts the files outside the warehouse. Rows with a null key are
    kept in a bucket of their own hash; an empty table can be stored and read.
    """
    keys = keyed(df, key)
    count = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(count, *keys).write.mode(mode).format("parquet").bucketBy(count, *keys).sortBy(*keys, *order)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def store_labels(labelled: DataFrame, name: str, buckets: int | None = None, path: str | None = None, mode: str = "errorifexists") -> None:
    """The label store of ``write_labels`` as a bucketed table, with the id as ``tx_id``, as sequences and windows have it."""
    store_bucketed(_kept_labels(labelled).withColumnRenamed("tid", "tx_id"), name, "tx_id", buckets, (), path, mode)


def write_report(df: DataFrame, path: str, decimals: int = 6) -> None:
    """Tab-separated with a header; floating-point columns with fixed decimals."""
    cols = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.option("sep", "\t").option("header", True).csv(path)
