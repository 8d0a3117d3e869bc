"""Training-run logs (run, epoch, val_loss): best epochs, and when callbacks would act."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_epochs(log: DataFrame, accuracy: str | None = None) -> DataFrame:
    """The earliest epoch with the lowest val_loss of each run, 0-based as logged and 1-based as in file names."""
    rows = log.filter(~F.isnan("val_loss") & F.col("val_loss").isNotNull())
    out = [F.min(F.struct("val_loss", "epoch")).alias("_best")]
    if accuracy:
        out.append(F.max_by("epoch", F.struct(F.col(accuracy), -F.col("epoch"))).alias("best_accuracy_epoch"))
    return rows.groupBy("run").agg(*out).select("run", F.col("_best.epoch").alias("best_epoch"), (F.col("_best.epoch") + 1).alias("file_epoch"), F.col("_best.val_loss").alias("val_loss"), *(["best_accuracy_epoch"] if accuracy else []))


def early_stop(log: DataFrame, patience: int = 20) -> DataFrame:
    """The first epoch of each run with ``patience`` epochs since the last improvement; runs that never stop have no row."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("_row", F.row_number().over(w)).withColumn("_better", before.isNull() | (F.col("val_loss") < before))
    last = F.max(F.when(F.col("_better"), F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_wait", F.col("_row") - last).filter(F.col("_wait") >= patience).groupBy("run").agg(F.min("epoch").alias("stop_epoch"))


def plateau_steps(log: DataFrame, patience: int = 7, factor: float = 0.5, min_lr: float = 1e-6, start_lr: float = 1e-3, min_delta: float = 1e-4) -> DataFrame:
    """Epochs at which the learning rate would be reduced: run, epoch, lr.

    Whether an epoch is better depends on the last accepted best, so each run's log is folded in order;
    a run is one array, as long as it has epochs.
    """
    runs = log.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "val_loss"))).alias("log"))
    state = "struct<best:double,wait:int,lr:double,steps:array<struct<epoch:bigint,lr:double>>>"
    start = F.lit(None).cast("double")
    zero = F.struct(start.alias("best"), F.lit(0).alias("wait"), F.lit(start_lr).alias("lr"), F.array().cast("array<struct<epoch:bigint,lr:double>>").alias("steps")).cast(state)

    def fold(acc: F.Column, x: F.Column) -> F.Column:
        better = acc["best"].isNull() | (x["val_loss"] < acc["best"] - min_delta)
        due = ~better & (acc["wait"] + 1 >= patience)
        lr = F.greatest(acc["lr"] * factor, F.lit(min_lr))
        act = due & (acc["lr"] > min_lr)
        step = F.array(F.struct(x["epoch"].cast("bigint").alias("epoch"), lr.alias("lr")))
        return F.struct(
            F.when(better, x["val_loss"]).otherwise(acc["best"]).alias("best"),
            F.when(better | act, 0).otherwise(acc["wait"] + 1).alias("wait"),
            F.when(act, lr).otherwise(acc["lr"]).alias("lr"),
            F.when(act, F.concat(acc["steps"], step)).otherwise(acc["steps"]).alias("steps"),
        ).cast(state)

    return runs.select("run", F.inline(F.aggregate("log", zero, fold)["steps"]))
