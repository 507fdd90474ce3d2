"""Two-against-two games: records by partner, stocks, friendly fire, execution of both sides of a team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalar import ratio
from matchlake.metrics import record
from matchlake.operators.sequence import current_streak, islands

START_STOCKS = 4


def taken(stocks: list[Column]) -> Column:
    """Stocks taken from the given sides; null unless all are known."""
    return sum(START_STOCKS - s for s in stocks)


def team_filter(opponents: Column, wanted: Column) -> Column:
    """A duo fits if either of the two does."""
    return F.exists(opponents, lambda o: o == wanted)


def team_overview(df: DataFrame, keys: list[str], order: list[str], theirs: list[str], ours: list[str], seconds: str, mate: str, port: str) -> DataFrame:
    """Record, stocks taken and lost per game where all four are known, mean length, partners, current streak."""
    known = sum(F.col(c) for c in [*theirs, *ours]).isNotNull()
    games = F.count(F.when(known, 1))
    partner = F.coalesce(mate, F.concat(F.lit("port:"), F.col(port).cast("string")))
    got = df.groupBy(*keys).agg(
        *record(),
        ratio(F.sum(F.when(known, taken([F.col(c) for c in theirs]))), games).alias("taken_per_game"),
        ratio(F.sum(F.when(known, taken([F.col(c) for c in ours]))), games).alias("lost_per_game"),
        F.avg(seconds).alias("mean_seconds"),
        F.count_distinct(partner).alias("partners"),
    )
    return got.join(current_streak(df, keys, order).select(*keys, F.col("kind").alias("streak_kind"), F.col("length").alias("streak_length")), keys, "left")


def by_teammate(df: DataFrame, keys: list[str], order: list[str], mate: str, self_match: str, char: str, theirs: list[str]) -> DataFrame:
    """Record with each partner that has a code and is not oneself; the most played character, first seen among equals."""
    own = df.where(F.col(mate).isNotNull() & ~F.col(self_match))
    stocks = taken([F.col(c) for c in theirs])
    chars = own.groupBy(*keys, mate, char).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = Window.partitionBy(*keys, mate).orderBy(F.desc("_n"), "_first")
    top = chars.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, mate, F.col(char).alias("top_character"))
    got = own.groupBy(*keys, mate).agg(*record(), ratio(F.sum(stocks), F.count(stocks)).alias("taken_per_game"), F.max(order[0]).alias("last"))
    return got.join(top, [*keys, mate])


def friendly_fire(df: DataFrame, keys: list[str], mate: str, self_match: str, to_me: str, from_me: str) -> DataFrame:
    """Per partner: measured games and friendly fire per game, both ways."""
    own = df.where(F.col(mate).isNotNull() & ~F.col(self_match) & F.col(to_me).isNotNull() & F.col(from_me).isNotNull())
    return own.groupBy(*keys, mate).agg(F.count("*").alias("games"), F.avg(to_me).alias("to_me"), F.avg(from_me).alias("from_me"))


def team_records(df: DataFrame, keys: list[str], order: list[str], mate: str, self_match: str, to_me: str, from_me: str, least: int = 5) -> DataFrame:
    """Longest winning streak; the partner who hits one most, and the one hit most, per game over enough games."""
    runs = islands(df, keys, order, "w").where("w = 1").groupBy(*keys, "island").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("best_streak"))
    fire = friendly_fire(df, keys, mate, self_match, to_me, from_me).where(F.col("games") >= least)
    worst = lambda c: F.min_by(mate, F.struct(-F.col(c), F.col(mate)))
    most = fire.groupBy(*keys).agg(worst("to_me").alias("grudge"), F.max("to_me").alias("grudge_fire"), worst("from_me").alias("target"), F.max("from_me").alias("target_fire"))
    return df.select(*keys).distinct().join(runs, keys, "left").join(most, keys, "left")
