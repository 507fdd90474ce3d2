"""Actions and contexts in ordered frame sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_actions(df: DataFrame, keys: list[str], order: list[str], action: str, counter: str) -> DataFrame:
    """Rows where an action begins: it differs from the one before, or its counter fell."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = F.lag(action).over(w).isNull() | (F.lag(action).over(w) != F.col(action)) | (F.col(counter) < F.lag(counter).over(w))
    return df.where(F.col(action).isNotNull()).withColumn("begins", begins).where("begins").drop("begins")


def contiguous(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Only sequences whose frames have no gap and no repeat; others are unmeasured, not zero."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    return df.withColumn("_ok", (F.max(frame).over(w) - F.min(frame).over(w) + 1 == n) & (F.size(F.collect_set(frame).over(w)) == n)).where("_ok").drop("_ok")


def recent_action(df: DataFrame, keys: list[str], order: list[str], frame: str, action: str, reach: int) -> DataFrame:
    """The last known action up to reach frames back, as context."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(action).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(action).alias("a"))), ignorenulls=True).over(w)
    return df.withColumn("_l", last).withColumn("context", F.when(F.col(frame) - F.col("_l.f") <= reach, F.col("_l.a"))).drop("_l")


