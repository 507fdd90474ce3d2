"""Ownership changes, observation weights, audits of deliveries, and backtest ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def other_owners(rows: DataFrame, changed: DataFrame, key: str, owner: str) -> DataFrame:
    """Owners of a changed key who are not its only changer: the least and the largest changer tell, without a self-join."""
    by = changed.groupBy(key).agg(F.min(owner).alias("_least"), F.max(owner).alias("_most"))
    return rows.join(by, key).where((F.col(owner) != F.col("_least")) | (F.col(owner) != F.col("_most"))).select(owner).distinct()


def with_set_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """weight: one over the number of games of the set, so that every set counts once."""
    return df.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(*keys)))


def in_periods(df: DataFrame, keys: list[str], ts: str, now: Column, days: list[int], aggs: dict[str, Column]) -> DataFrame:
    """Sums (aggs) per key and look-back period (null: all time) that ends now; periods are told apart after the aggregation."""
    age = F.lit(None).cast("int")
    for d in sorted(days, reverse=True):
        age = F.when(F.col(ts) >= now - F.make_dt_interval(F.lit(d)), d).otherwise(age)
    parts = df.groupBy(*keys, age.alias("_age")).agg(*(c.alias(n) for n, c in aggs.items()))
    periods = F.array(*(F.lit(d) for d in sorted(days)), F.lit(None).cast("int"))
    spread = parts.withColumn("days", F.explode(periods)).where("days IS NULL OR _age <= days")
    return spread.groupBy("days", *keys).agg(*(F.sum(n).alias(n) for n in aggs))


def page_receipts(df: DataFrame, source: str, page: Column) -> DataFrame:
    """Pages, rows and whether no page is missing between the first and the last, per source."""
    pages = df.groupBy(source, page.alias("_p")).agg(F.count("*").alias("_n"))
    whole = F.max("_p") - F.min("_p") + 1 == F.count("*")
    return pages.groupBy(source).agg(F.count("*").alias("pages"), whole.alias("gapless"), F.sum("_n").alias("rows"))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def forecast_integrity(df: DataFrame, keys: list[str], title: str, top: int = 8, tolerance: float = 1e-4) -> DataFrame:
    """Do the chances of the title sum to one, and those of a place among the top to their number?"""
    n, t = F.count("*"), F.col(title)
    places = F.sum(F.least(F.lit(1.0), top * t))
    return df.groupBy(*keys).agg(
        n.alias("players"), (F.abs(F.sum(t) - 1) <= tolerance).alias("title_ok"), (F.abs(places - F.least(F.lit(top), n)) <= tolerance).alias("top8_ok")
    )


def backtest(df: DataFrame, keys: list[str], entrant: str, score: str, result: str, top: int = 8) -> DataFrame:
    """Credit of the predicted first (shared by ties), share of the predicted top that came true, worst rank of a winner."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_predicted", F.rank().over(w.orderBy(F.desc(score)))).withColumn("_actual", F.rank().over(w.orderBy(F.desc(result))))
    r = r.withColumn("_place", F.row_number().over(w.orderBy(F.desc(score), entrant))).withColumn("_tied", F.count("*").over(Window.partitionBy(*keys, score)))
    won = F.col("_actual") == 1
    return r.groupBy(*keys).agg(
        (F.sum(F.when(won & (F.col("_predicted") == 1), F.lit(1.0) / F.col("_tied")).otherwise(0.0)) / F.count_if(won)).alias("top1"),
        (F.count_if((F.col("_actual") <= top) & (F.col("_place") <= top)) / float(top)).alias("precision8"),
        F.max(F.when(won, F.col("_predicted") + F.col("_tied") - 1)).cast("long").alias("worst_rank"),
    )


def encode_counters(df: DataFrame, keys: list[str], name: str, counters: list[str]) -> DataFrame:
    """One row per key with parallel arrays: the names, and each counter's values (null stays null, apart from zero).

    The number of names per key has to be small (a fixed dimension), as each key's arrays are one value.
    """
    cells = F.array_sort(F.collect_list(F.struct(name, *counters)))
    packed = df.groupBy(*keys).agg(cells.alias("_c"))
    return packed.select(*keys, *(F.col(f"_c.{c}").alias(c) for c in (name, *counters)))


def decode_counters(df: DataFrame, keys: list[str], name: str, counters: list[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.arrays_zip(name, *counters)))
