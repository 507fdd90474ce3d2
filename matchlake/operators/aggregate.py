"""Aggregations: profiles, matrices, move tables, cubes with coverage, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalar import ratio


def mode_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key, the smaller of equals."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return n.withColumn("_r", rank).where("_r = 1").select(*keys, F.col(value).alias(f"top_{value}"), F.col("n").alias(f"top_{value}_games"))


def unpivot(df: DataFrame, keep: list[str], measures: list[str]) -> DataFrame:
    """Long form: one row per measure, value null where unmeasured."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("_m")).select(*keep, "_m.*")


def averages(df: DataFrame, keys: list[str], measures: list[str], minutes: str) -> DataFrame:
    """Per game and per minute, each measure over the games that measured it (coverage)."""
    long = unpivot(df, [*keys, minutes], measures)
    covered = F.sum(F.when(F.col("value").isNotNull(), F.col(minutes)))
    return long.groupBy(*keys, "measure").agg(
        F.count("value").alias("coverage"),
        ratio(F.sum("value"), F.count("value")).alias("per_game"),
        F.when(F.count("value") > 0, F.coalesce(ratio(F.sum("value"), covered), F.lit(0.0))).alias("per_minute"),
    )


def move_table(moves: DataFrame, games: DataFrame, keys: list[str], game: str, group: str) -> DataFrame:
    """Per group: landed, damage, share of the whole arsenal, per covered game.

    moves: one row per game and move (landed, damage); covered games are those with any move row.
    """
    totals = moves.groupBy(*keys).agg(F.sum("landed").alias("_l"), F.sum("damage").alias("_d"), F.count_distinct(game).alias("covered"))
    all_games = games.groupBy(*keys).agg(F.count("*").alias("games"))
    got = moves.groupBy(*keys, group).agg(F.sum("landed").alias("landed"), F.sum("damage").alias("damage"))
    got = got.join(totals, keys).join(all_games, keys)
    return got.select(*keys, group, "games", "covered", "landed", "damage", ratio(F.col("landed"), F.col("_l")).alias("landed_share"), ratio(F.col("damage"), F.col("_d")).alias("damage_share"), ratio(F.col("landed"), F.col("covered")).alias("landed_per_game"))


def balanced(df: DataFrame, cohort: list[str], identity: str, num: str, den: str, least_games: int, least_den: float) -> DataFrame:
    """Equal-weight mean and quartiles over identities with enough games and attempts."""
    per = df.groupBy(*cohort, identity).agg(F.count("*").alias("g"), F.sum(num).alias("n"), F.sum(den).alias("d")).where((F.col("g") >= least_games) & (F.col("d") >= least_den))
    rate = F.col("n") / F.col("d")
    q = F.percentile(rate, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return per.groupBy(*cohort).agg(F.count("*").alias("players"), F.avg(rate).alias("mean"), q.alias("q")).select(*cohort, "players", "mean", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))


def cube(df: DataFrame, dims: list[str], sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Grouping sets; level is grouping_id, which tells "all" from a null value."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.grouping_id().cast("long").alias("level"), *aggregates)


def suppress(df: DataFrame, least: dict[str, int]) -> DataFrame:
    """Only cells with enough of everything; comes before any rounding."""
    for column, n in least.items():
        df = df.where(F.col(column) >= n)
    return df


def gap_fill(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Every integer between each key's least and greatest, absent ones as 0."""
    span = df.groupBy(*keys).agg(F.sequence(F.min(at), F.max(at)).alias("_s")).select(*keys, F.explode("_s").alias(at)) if keys else df.agg(F.sequence(F.min(at), F.max(at)).alias("_s")).select(F.explode("_s").alias(at))
    return span.join(df, [*keys, at], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def fold_other(df: DataFrame, column: str, named: list[str]) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(*named), F.col(column)).otherwise("Other"))
