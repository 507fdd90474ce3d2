"""Joins with the semantics that plain equi-joins lack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_sides(df: DataFrame, one: list[str], two: list[str], names: list[str]) -> DataFrame:
    """Each row twice, oriented from either side (own_*, opp_*), without a self-join."""
    side = lambda a, b, i: F.struct(F.lit(i).alias("side"), *(F.col(c).alias(f"own_{n}") for c, n in zip(a, names, strict=True)), *(F.col(c).alias(f"opp_{n}") for c, n in zip(b, names, strict=True)))
    rest = [c for c in df.columns if c not in {*one, *two}]
    return df.select(*rest, F.explode(F.array(side(one, two, 0), side(two, one, 1))).alias("_s")).select(*rest, "_s.*")


def look_backs(df: DataFrame, ts: str, now: str, days: list[int | None]) -> DataFrame:
    """Each row once per look-back period that holds it; None is all time.

    The periods are a literal array, so this is an explode within the scan's stage: no nested-loop join.
    """
    inside = F.filter(F.array(*(F.lit(d).cast("int") for d in days)), lambda d: d.isNull() | (F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(d)))
    return df.withColumn("look_back", F.explode(inside))


def null_safe_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equality in which null equals null (null means all)."""
    renamed = b.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in b.columns))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    return a.join(renamed, same, how).drop(*(f"_r_{c}" for c in on))


def first_owner(df: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Rows of the smallest owner of each key (rank over a window, so one shuffle and no self-join)."""
    w = Window.partitionBy(*key).orderBy(owner)
    return df.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def difference(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """What a reconciliation deletes and inserts."""
    gone = old.select(*on).distinct().join(new, on, "left_anti").withColumn("change", F.lit("delete"))
    return gone.unionByName(new.select(*on).distinct().join(old, on, "left_anti").withColumn("change", F.lit("insert")))


def newer_than_stored(incoming: DataFrame, stored: DataFrame, key: list[str], version: str) -> DataFrame:
    """Incoming rows that are new or of a higher version."""
    held = stored.select(*key, F.col(version).alias("_stored"))
    return incoming.join(held, key, "left").where(F.col("_stored").isNull() | (F.col(version) > F.col("_stored"))).drop("_stored")


def priority_lookup(df: DataFrame, tables: list[tuple[DataFrame, list[str], str]], out: str) -> DataFrame:
    """The value from the first table with a row for its keys. tables: (frame, keys, value column)."""
    found: list[Column] = []
    for i, (table, keys, value) in enumerate(tables):
        df = df.join(table.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
        found.append(F.col(f"_v{i}"))
    return df.withColumn(out, F.coalesce(*found)).drop(*(f"_v{i}" for i in range(len(tables))))


def as_of(left: DataFrame, right: DataFrame, key: list[str], ts: str, value: str, out: str, strict: bool = True, tolerance: Column | None = None) -> DataFrame:
    """The right value at the last time before (or at) the left one, per key: a union and one window.

    Unlike a range join this shuffles each row once, whatever the number of matches.
    tolerance: an interval; older values count as none.
    """
    a = left.withColumn("_side", F.lit(0 if strict else 1))
    b = right.select(*key, ts, F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_value")).withColumn("_side", F.lit(1 if strict else 0))
    w = Window.partitionBy(*key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where(F.col("_value").isNull())
    got = F.col("_last.v")
    if tolerance is not None:
        got = F.when(F.col("_last.t") >= F.col(ts) - tolerance, got)
    return seen.withColumn(out, got).select(*left.columns, out)
