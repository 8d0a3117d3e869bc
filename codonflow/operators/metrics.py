"""Per-position accuracy. Inputs are rows (logits or predicted, true_class, pad); every row that is not padding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonflow.functions.labels import LABEL_NAMES, argmax, log_softmax, ratio_epsilon, ratio_or_zero

#: The default class weights of the loss.
CLASS_WEIGHTS = (1.0, 10.0, 1.0, 1.0, 1.0, 10.0)
BOUNDARY = (1, 5)


def confusion_counts(rows: DataFrame, predicted: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn of each class for the model and for a baseline that says IR everywhere."""
    p = argmax(F.col("logits")) if predicted is None else predicted
    return expand_cells(rows.filter(~F.col("pad")).groupBy(*by, F.col("true_class").alias("t"), p.alias("p")).agg(F.count("*").alias("n")), by)


def expand_cells(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same from counts n of true class t and predicted class p; a cell may come in several rows."""
    both = F.array(F.struct(F.lit("model").alias("predictor"), F.col("p").alias("q")), F.struct(F.lit("all_ir").alias("predictor"), F.lit(0).alias("q")))
    cells = cells.select(*by, "t", "n", F.inline(both))
    classes = F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("class_name")) for i, n in enumerate(LABEL_NAMES)])
    cells = cells.select(*by, "t", "q", "n", "predictor", F.inline(classes))
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t, q, k = F.col("t"), F.col("q"), F.col("class_id")
    return cells.groupBy(*by, "predictor", "class_id", "class_name").agg(sum_if((t == k) & (q == k)).alias("tp"), sum_if((t != k) & (q == k)).alias("fp"), sum_if((t == k) & (q != k)).alias("fn"))


def class_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class; 0.0 where a denominator is 0."""
    p = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def masked_accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hit = (argmax(F.col("logits")) == F.col("true_class")).cast("int")
    return rows.filter(~F.col("pad")).groupBy(*by).agg(ratio_epsilon(F.sum(hit), F.count("*")).alias("accuracy"))


def masked_f1(rows: DataFrame) -> DataFrame:
    """F1 of each class with a small constant in each denominator."""
    c = confusion_counts(rows).filter("predictor = 'model'")
    p, r = ratio_epsilon(F.col("tp"), F.col("tp") + F.col("fp")), ratio_epsilon(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"_p": p, "_r": r}).select("class_id", ratio_epsilon(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")).alias("f1"))


def _xent(weights: tuple[float, ...]) -> Column:
    at = F.col("true_class").cast("int") + 1
    weighted = F.element_at(F.array(*map(F.lit, weights)), at) * -F.element_at(log_softmax(F.col("logits")), at)
    return ratio_epsilon(F.sum(weighted), F.count("*"))


def masked_xent(rows: DataFrame, class_weights: tuple[float, ...] = CLASS_WEIGHTS, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted cross-entropy over positions that are not padding, divided by their number, not by the weights."""
    return rows.filter(~F.col("pad")).groupBy(*by).agg(_xent(class_weights).alias("xent"))


def boundary_soft_f1(rows: DataFrame, class_weights: tuple[float, ...] = CLASS_WEIGHTS, f1_lambda: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Soft F1 of START and STOP from probabilities, the cross-entropy, and their combined loss."""
    probs = F.transform(log_softmax(F.col("logits")), F.exp)

    def soft(c: int) -> Column:
        p, y = F.col("_probs")[c], (F.col("true_class") == c).cast("double")
        tp, fp, fn = F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y)
        return 2 * tp / (2 * tp + fp + fn + F.lit(1e-8))

    out = rows.filter(~F.col("pad")).withColumn("_probs", probs).groupBy(*by).agg(soft(BOUNDARY[0]).alias("start_f1"), soft(BOUNDARY[1]).alias("stop_f1"), _xent(class_weights).alias("xent"))
    return out.withColumn("loss", F.col("xent") + f1_lambda * ((1 - F.col("start_f1")) + (1 - F.col("stop_f1"))) / 2)


def species_summary(scored: DataFrame, reference_lines: DataFrame, predicted_lines: DataFrame) -> DataFrame:
    """Transcripts scored, reference CDS lines and predicted CDS lines of each species; 0 where there are none."""
    count = lambda df, name: df.groupBy("species").agg(F.count("*").alias(name))
    out = count(scored, "transcripts").join(count(reference_lines, "reference_cds"), "species", "full").join(count(predicted_lines, "predicted_cds"), "species", "full")
    return out.fillna(0, ["transcripts", "reference_cds", "predicted_cds"])
