"""What a training run logs, as tables: timings, means, progress, stopping, checkpoints to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_timing(rows: DataFrame, stage: str, seconds: str) -> DataFrame:
    """(stage, n, t, mean, least, most, share): of each stage, and its share of all time in percent; one scan."""
    out = rows.groupBy(stage).agg(F.count("*").alias("n"), F.sum(seconds).alias("t"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
    whole = F.sum("t").over(Window.partitionBy())  # one row for each stage
    return out.withColumn("share", F.when(whole > 0, 100 * F.col("t") / whole).otherwise(0.0))


def weighted_means(rows: DataFrame, name: str, value: str, count: str, order: str) -> DataFrame:
    """(name, mean, last): means weighted by count (0 without any), and the last weighted value over the count of all."""
    total = F.sum(count)
    of = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    return rows.groupBy(name).agg(of(F.sum(F.col(value) * F.col(count))).alias("mean"), of(F.max_by(F.col(value) * F.col(count), order)).alias("last"))


def progress(rows: DataFrame, run: str, order: str, loss: str, interval: int, total: int | None = None, seconds: str | None = None) -> DataFrame:
    """Adds step (from 1), rolling (mean loss of the last ``interval`` steps), logged (every ``interval`` steps), and with ``total`` percent, with ``seconds`` (since the start) also eta."""
    w = Window.partitionBy(run).orderBy(order)
    out = rows.withColumn("step", F.row_number().over(w)).withColumn("rolling", F.avg(loss).over(w.rowsBetween(-(interval - 1), 0))).withColumn("logged", F.col("step") % interval == 0)
    if total is not None:
        out = out.withColumn("percent", F.col("step") / total * 100)
        if seconds:
            out = out.withColumn("eta", F.when(F.col(seconds) > 0, (total - F.col("step")) * F.col(seconds) / F.col("step")).otherwise(0.0))
    return out


def early_stop(rows: DataFrame, run: str, order: str, loss: str, patience: int, least: float = 0.0) -> DataFrame:
    """Adds waited (evaluations since the loss last fell by more than ``least`` below its best) and stop."""
    w = Window.partitionBy(run).orderBy(order)
    out = rows.withColumn("_best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_nth", F.row_number().over(w))
    better = F.col("_best").isNull() | (F.col(loss) < F.col("_best") - least)
    out = out.withColumn("_at", F.max(F.when(better, F.col("_nth"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("waited", F.col("_nth") - F.col("_at"))
    return out.withColumn("stop", F.col("waited") >= patience).drop("_best", "_nth", "_at")


def newest(rows: DataFrame, run: str, order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each run."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def running_number(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds out_no: the running number of what is left, from 1."""
    return rows.withColumn("out_no", F.row_number().over(Window.partitionBy(group).orderBy(order)))
