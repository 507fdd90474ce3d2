"""Rollups of contributed games: cohorts, executions, moves, months, and what may be shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import ratio


def eligible(games: DataFrame, consent: DataFrame, codes: DataFrame, owner: str, version: int, stages: list[int]) -> DataFrame:
    """Games of consenting owners, complete and dated, of which exactly one side is the owner's.

    codes: owner, codes (array).  games: owner, pack_version, players (array of codes), error, ts, stage, is_teams.
    """
    fine = (F.col("pack_version") >= version) & ~F.col("is_teams") & (F.size("players") == 2) & F.col("error").isNull() & F.col("ts").isNotNull() & F.col("stage").isin(stages)
    own = games.where(fine).join(consent.where("enabled").select(owner), owner, "left_semi").join(codes, owner)
    return own.where(F.size(F.filter("players", lambda p: F.array_contains("codes", p))) == 1).drop("codes")


def with_lookbacks(df: DataFrame, ts: str, end: Column, days: list[int | None]) -> DataFrame:
    """A row per look-back that reaches it (null: all time)."""
    spans = F.array(*(F.lit(d).cast("int") for d in days))
    return df.withColumn("lookback", F.explode(F.filter(spans, lambda d: d.isNull() | (F.col(ts) >= end - F.make_dt_interval(d)))))


def benchmark(df: DataFrame, by: str, keys: list[str], num: str, den: list[str], means: list[str], least: int) -> DataFrame:
    """By by and over all (-1): games, pooled percentage and means; cells of few games are left out."""
    total = sum(F.col(c) for c in den)
    kind = dict(df.dtypes)[by]
    got = df.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("games"), F.count_distinct(*keys).alias("unique_games"), (100 * ratio(F.sum(num), F.sum(total))).alias("pooled"), *(F.avg(c).alias(c) for c in means))
    return got.where(F.col("games") >= least).withColumn(by, F.when(F.col("_all") == 1, F.lit(-1).cast(kind)).otherwise(F.col(by))).drop("_all")


def executions(df: DataFrame, by: str, counts: list[str], optional: str) -> DataFrame:
    """Per look-back, by and over all (-1): sums of counts, and games that measured the optional one."""
    kind = dict(df.dtypes)[by]
    sums = [F.sum(c).cast("long").alias(c) for c in counts]
    cube = df.cube("lookback", by).agg(F.grouping_id().alias("_level"), F.count("*").alias("games"), *sums, F.count(optional).alias(f"{optional}_games"), F.sum(optional).cast("long").alias(optional))
    return cube.where(F.col("_level").isin(0, 1)).withColumn(by, F.when(F.col("_level") == 1, F.lit(-1).cast(kind)).otherwise(F.col(by))).drop("_level")


def moves_per_game(df: DataFrame, keys: list[str], move: Column, sums: list[str], attempts: str) -> DataFrame:
    """Raw moves collapsed to their group once per game; attempts null unless some raw move recorded them."""
    return df.groupBy(*keys, move.alias("move")).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums), F.sum(attempts).alias(attempts), F.max(F.col(attempts).isNotNull()).alias("has_attempts"))


def move_rollup(per_game: DataFrame, totals: DataFrame, keys: list[str], sums: list[str], attempts: str) -> DataFrame:
    """Per keys and move: games with the move out of the keys' games, sums, and games whose attempts are known."""
    got = per_game.groupBy(*keys, "move").agg(F.count("*").alias("move_games"), *(F.sum(c).alias(c) for c in sums), F.sum(F.when(F.col("has_attempts"), F.col(attempts))).alias(attempts), F.count(F.when(F.col("has_attempts"), 1)).alias("attempt_games"))
    same = [got[k].eqNullSafe(totals[k]) for k in keys]
    return got.join(totals, same).select(got["*"], totals["games"])


def count_members(sets: Column) -> Column:
    """Distinct non-empty members over an array of arrays."""
    return F.size(F.array_distinct(F.filter(F.flatten(sets), lambda x: x.isNotNull() & (x != ""))))


def reaggregate(df: DataFrame, keys: list[str], sums: list[str], optional: list[str]) -> DataFrame:
    """Sums of published cells; an optional one stays null unless some cell has it."""
    return df.groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums), *(F.sum(c).alias(c) for c in optional))


def recompute_differs(export: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side."""
    return export.exceptAll(again).withColumn("side", F.lit("export")).unionByName(again.exceptAll(export).withColumn("side", F.lit("again")))
