"""Usage against results: heavy against light use of moves and actions, and the detectors of a coach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.sequence import median_split

Z_GATE, Z_GATE_SCAN, LEAST_DECIDED = 2.0, 2.5, 40


def dense_shares(df: DataFrame, keys: list[str], game: str, move: str, landed: str) -> DataFrame:
    """keys, game, move, share of the game's landed total, 0 where the game never used a move that its key knows.

    Games without a landed move are not eligible.  A key's moves are few: they ride along as one array per game.
    """
    per = df.groupBy(*keys, game, move).agg(F.sum(landed).alias("_l"))
    totals = per.groupBy(*keys, game).agg(F.sum("_l").alias("_t"), F.map_from_entries(F.collect_list(F.struct(move, "_l"))).alias("_m")).where("_t > 0")
    known = per.join(totals.select(*keys, game), [*keys, game], "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_set(move)).alias("_moves"))
    return totals.join(known, keys).select(*keys, game, F.explode("_moves").alias(move), "_m", "_t").select(*keys, game, move, (F.coalesce(F.col("_m")[F.col(move)], F.lit(0)) / F.col("_t")).alias("share"))


def impact(samples: DataFrame, keys: list[str], by: list[str], value: str, order: list[str], least: int = 40) -> DataFrame:
    """mean and the win rates of the lower and the upper half of each series by value, of keys with enough games."""
    split = median_split(samples, [*keys, *by], value, order)
    means = samples.groupBy(*keys, *by).agg(F.avg(value).alias("mean_use"))
    return split.where(F.col("n") >= least).join(means, [*keys, *by])


def z_against(rate: Column, base: Column, n: Column) -> Column:
    return (rate - base) / F.sqrt(base * (1 - base) / n)


def decided_rates(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, by, decided, rate, the key's base rate and z of the difference; keys with too few decided games are left out."""
    known = df.where("w IS NOT NULL")
    base = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("w").alias("base")).where((F.col("_n") >= LEAST_DECIDED) & (F.col("base") > 0) & (F.col("base") < 1))
    rows = known.groupBy(*keys, *by).agg(F.count("*").alias("decided"), F.avg("w").alias("rate"))
    joined = rows.join(base.drop("_n"), keys)
    return joined.withColumn("z", z_against(F.col("rate"), F.col("base"), F.col("decided")))


def detect(df: DataFrame, keys: list[str], by: list[str], least: int, gate: float = Z_GATE, worst: bool = True) -> DataFrame:
    """Per key the row by which the result stands out most below (or above) the base rate beyond the gate, with its score."""
    z = F.col("z") if worst else -F.col("z")
    found = decided_rates(df, keys, by).where((F.col("decided") >= least) & (z <= -gate))
    first = Window.partitionBy(*keys).orderBy(z, *by)
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("score", F.abs(F.col("rate") - F.col("base")) * F.sqrt("decided"))


def worst_character(df: DataFrame, keys: list[str], character: str, least: int = 30, gate: float = Z_GATE) -> DataFrame:
    """Per key the character that costs most, of those with enough decided games; a key with one such character has no choice to make."""
    enough = decided_rates(df, keys, [character]).where(F.col("decided") >= least).groupBy(*keys).agg(F.count("*").alias("_choices")).where("_choices > 1").select(*keys)
    return detect(df, keys, [character], least, gate).join(enough, keys, "left_semi")


def move_habit(rows: DataFrame, keys: list[str], move: str, archive: DataFrame | None = None, least: int = 60, share: float = 0.05, delta: float = -0.08, gate: float = Z_GATE, over: tuple[float, float] = (0.04, 0.5), archive_games: int = 100) -> DataFrame:
    """Per key the move whose heavy use goes with losses: the most negative two-proportion z of the heavy against the light half.

    rows: those of impact.  archive (keys, move, archive_share, games): with it only moves count that are used more than there by over[0], or
    over[1] of the archive's share if that is more; a key whose archive has too few games has no habit.
    """
    c, half = F.col, F.floor(F.col("n") / 2)
    if archive is not None:
        gap = F.greatest(F.lit(over[0]), over[1] * c("archive_share"))
        rows = rows.join(archive.where(c("games") >= archive_games), [*keys, move]).where(c("mean_use") - c("archive_share") >= gap)
    pooled = (c("high") + c("low")) / 2
    z = (c("high") - c("low")) / F.sqrt(pooled * (1 - pooled) * 2 / half)
    judged = rows.where((c("mean_use") >= share) & (2 * half >= least) & (pooled > 0) & (pooled < 1)).withColumn("z", z).where((c("z") <= -gate) & (c("delta") <= delta))
    first = Window.partitionBy(*keys).orderBy("z", move)
    return judged.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("score", F.abs("delta") * 0.5 * F.sqrt(2 * half))


def stage_tip(df: DataFrame, keys: list[str], matchup: str, stage: str, margin: float = 0.12, least: int = 8) -> DataFrame:
    """For each key's worst matchup, the best stage within it that is better by the margin (null if none is)."""
    mu = detect(df, keys, [matchup], 20).select(*keys, matchup, F.col("rate").alias("matchup_rate"))
    inside = df.where("w IS NOT NULL").join(mu, [*keys, matchup]).groupBy(*keys, matchup, "matchup_rate", stage).agg(F.count("*").alias("decided"), F.avg("w").alias("rate"))
    fits = (F.col("decided") >= least) & (F.col("rate") >= F.col("matchup_rate") + margin)
    best = F.max_by(F.when(fits, F.col(stage)), F.when(fits, F.struct(F.col("rate"), F.col(stage).alias("_s"))))
    return inside.groupBy(*keys, matchup, "matchup_rate").agg(best.alias("tip"))


def matchup_stage(df: DataFrame, keys: list[str], matchup: str, stage: str, below: float = 0.12, least: int = 15) -> DataFrame:
    """Per key the worst cell of matchup and stage that the matchup alone does not explain."""
    cells = decided_rates(df, keys, [matchup, stage]).where(F.col("decided") >= least)
    alone = df.where("w IS NOT NULL").groupBy(*keys, matchup).agg(F.avg("w").alias("matchup_rate"))
    found = cells.join(alone, [*keys, matchup]).where((F.col("rate") <= F.col("matchup_rate") - below) & (F.col("z") <= -Z_GATE_SCAN))
    first = Window.partitionBy(*keys).orderBy("z", matchup, stage)
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def model_fit(df: DataFrame, keys: list[str], p: str, y: str, least: int = 40, least_class: int = 10) -> DataFrame:
    """n, wins and McFadden's R2 of forecasts p; keys with too few rows of either result are left out."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    ll = F.sum(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log1p(-q)))
    got = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("wins"), ll.alias("ll"))
    gated = got.where((F.col("n") >= least) & (F.col("wins") >= least_class) & (F.col("n") - F.col("wins") >= least_class))
    base = F.col("wins") / F.col("n")
    null = F.col("wins") * F.log(base) + (F.col("n") - F.col("wins")) * F.log(1 - base)
    return gated.withColumn("r2", F.when(null < 0, 1 - F.col("ll") / null).otherwise(0.0)).drop("ll")
