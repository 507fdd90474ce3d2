"""Content identity, preference order, evidence merging and versioned upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_key(ts: Column, stage: Column, players: Column) -> Column:
    """Identity of a game: time, stage and sorted player identities (array of strings)."""
    return F.concat_ws("|", ts.cast("string"), stage.cast("string"), F.array_join(F.array_sort(players), "+"))


def prefer(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def versioned_merge(stored: DataFrame, incoming: DataFrame, key: list[str], version: str, ordinal: str) -> DataFrame:
    """The higher version wins; of equal ones incoming beats stored, then the later ordinal."""
    both = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    return prefer(both, key, F.desc(version), F.desc("_in"), F.desc(ordinal)).drop("_in")


def drop_stale_partials(df: DataFrame, path: str, ts: str) -> DataFrame:
    """Rows without a time go if their path also has one with a time."""
    timed = F.max(F.col(ts).isNotNull()).over(Window.partitionBy(path))
    return df.withColumn("_t", timed).where(F.col(ts).isNotNull() | ~F.col("_t")).drop("_t")


def merge_evidence(df: DataFrame, key: list[str], order: list[Column], any_of: list[str], all_of: list[str]) -> DataFrame:
    """First row per key, with flags or-ed or and-ed over the whole key."""
    w = Window.partitionBy(*key)
    merged = df.withColumns({c: F.bool_or(c).over(w) for c in any_of} | {c: F.bool_and(c).over(w) for c in all_of})
    return prefer(merged, key, *order)


def tri_state(df: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Merged flag: the value all evidence agrees on; null on conflict or without evidence."""
    lo, hi = F.min(flag), F.max(flag)
    return df.groupBy(*key).agg(F.when(lo == hi, lo).alias(flag), F.coalesce(lo != hi, F.lit(False)).alias("conflict"))


def conflicts(df: DataFrame, key: list[str], signature: str) -> DataFrame:
    """Keys whose copies differ."""
    return df.groupBy(*key).agg(F.count("*").alias("copies"), F.count_distinct(signature).alias("variants")).where(F.col("variants") > 1)
