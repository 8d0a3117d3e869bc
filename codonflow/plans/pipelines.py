"""The composite pipelines that users call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.operators import decode, geneset, labeling, maxplus, metrics, orf, runlog, species, windows
from codonflow.operators.keys import keyed, shared
from codonflow.sources import annotation, sequences


def label(features_tx: DataFrame, features_ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotation lines of transcripts and references to labels and category counts, by species if the lines have it."""
    labelled = labeling.label_transcripts(annotation.exon_table(features_tx), annotation.ref_cds_table(features_ref), annotation.stop_codon_table(features_ref))
    return labelled, labeling.category_stats(labelled, tuple(keyed(labelled)))


def make_windows(seqs: DataFrame, labels: DataFrame, width: int = windows.WIDTH, strict: bool = True) -> DataFrame:
    """Windows of sequences and their labels, x and y as strings of digits."""
    return windows.tile_text(windows.pair_with_labels(seqs, labels, strict)[0], width)


def decode_windows(tiled: DataFrame, make_predict_fn: Callable, width: int, batch_size: int = 64, transitions: str = "reference") -> DataFrame:
    """Windows to labels of whole sequences, a string of digits each: scored and summed up in one pass, put together in order, cut to the true length."""
    transfers = maxplus.score_transfers(_text(tiled, "x"), make_predict_fn, width, batch_size, transitions)
    return maxplus.reduce_transfers(transfers, "tx_id", "chunk_idx", "real_len")


def _text(tiled: DataFrame, *columns: str) -> DataFrame:
    """``tiled`` with arrays of digits as strings."""
    arrays = [c for c in columns if dict(tiled.dtypes)[c] != "string"]
    return tiled.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "") for c in arrays}) if arrays else tiled


def _to_gtf(labels: DataFrame, tx_exon: DataFrame, source: str) -> DataFrame:
    return orf.gtf_lines(orf.orf_segments(orf.find_orfs(labels).withColumnRenamed("tx_id", "tid"), tx_exon), source)


def annotate(tx_exon: DataFrame, make_predict_fn: Callable, seqs: DataFrame | None = None, tiles: DataFrame | None = None, width: int = windows.WIDTH, tile_width: int = sequences.TILE) -> DataFrame:
    """Exons and sequences (or genome tiles to splice them from) to GTF lines."""
    if seqs is None:
        seqs = sequences.splice(tx_exon, tiles, tile_width).withColumnRenamed("tid", "tx_id")
    ids = tx_exon.withColumnRenamed("tid", "tx_id")
    keys = shared(seqs, ids, "tx_id")
    known = seqs.join(ids.select(*keys).distinct(), keys, "left_semi")
    return _to_gtf(decode_windows(windows.tile_sequences(known, width, text=True), make_predict_fn, width), tx_exon, "prediction")


def predict(tiled: DataFrame, tx_exon: DataFrame, make_predict_fn: Callable, width: int = windows.WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows with species and labels to reference lines, predicted lines, and a summary of each species.

    Where exons have a species, ids of different species are told apart; else they must be unique.
    """
    tiled = _text(tiled, "x", "y")
    truth = windows.stitch(tiled.withColumn("y", F.substring(F.col("y"), F.lit(1), F.col("real_len"))), "tx_id", "chunk_idx", "y")
    truth = truth.withColumnRenamed("y", "labels")
    owner = tiled.select(F.col("tx_id").alias("tid"), "species").distinct()
    lines = [_to_gtf(x, tx_exon, s) for x, s in ((truth, "reference"), (decode_windows(tiled, make_predict_fn, width), "prediction"))]
    return lines[0], lines[1], metrics.species_summary(owner, *lines)


def evaluate_positions(tiled: DataFrame, make_predict_fn: Callable, width: int = windows.WIDTH, batch_size: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of each class (and of each ``by``), decoding window by window; no window is dropped, and each is scored once."""
    cells = decode.confusion_cells(_text(tiled, "x", "y"), make_predict_fn, width, batch_size, by=by)
    return metrics.class_prf(metrics.expand_cells(cells, by))


def evaluate_gene_sets(sets: dict[str, DataFrame], reference: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Accuracy on each level and its average over species, optionally of asked species (name, place) only."""
    both = geneset.union_gene_sets(sets)
    if asked is not None:
        kept = geneset.species_subset(reference.select(F.col("species").alias("name")), asked)[0].select(F.col("name").alias("species"))
        reference, both = reference.join(kept, "species", "left_semi"), both.join(kept, "species", "left_semi")
    levels = geneset.all_levels(reference, both)
    return levels, geneset.accuracy_average(levels)


def species_splits(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = species.species_splits(lines)
    return found, species.split_counts(found)


def run_report(logs: DataFrame) -> DataFrame:
    """Best epoch, early-stop epoch and learning-rate steps (epoch, lr) of each run; no steps are an empty list."""
    steps = runlog.plateau_steps(logs).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "lr"))).alias("lr_steps"))
    none = F.array().cast("array<struct<epoch:bigint,lr:double>>")
    out = runlog.best_epochs(logs).join(runlog.early_stop(logs), "run", "left").join(steps, "run", "left")
    return out.withColumn("lr_steps", F.coalesce("lr_steps", none))


