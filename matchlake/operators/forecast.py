"""Counts of events and pairs, chronological evaluation and bracket simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalar import brier, log_loss

def event_pairs(df: DataFrame, keys: list[str], event: str, day: str, a: str, b: str, won: str) -> DataFrame:
    """keys, event, day (of its end), a, b, games, wins (of a)."""
    pairs = df.groupBy(*keys, F.col(event).alias("event"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.max(day).alias("_day"), F.count("*").alias("games"), F.sum(won).cast("long").alias("wins"))
    return pairs.withColumn("day", F.max("_day").over(Window.partitionBy(*keys, "event"))).drop("_day")


def folds(events: DataFrame, least_train: int) -> DataFrame:
    """Per target event, the number of earlier events it may learn from: those that ended before it starts.

    events: event, start, end. A window over end times answers this without an events-by-events join.
    """
    ends = events.select(F.col("end").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event"))
    starts = events.select(F.col("start").alias("t"), F.lit(-1).alias("kind"), "event")
    day = ends.unionByName(starts).groupBy("t").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("n"), F.collect_list("event").alias("events"))
    before = day.withColumn("train_events", F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return before.select(F.explode("events").alias("event"), "train_events").where(F.col("train_events") >= least_train)


def seed_confidence(df: DataFrame, keys: list[str], seed_a: str, seed_b: str, games: str, wins: str) -> DataFrame:
    """comparisons, higher_wins and confidence that the higher seed wins: Beta(1, 1) smoothed, one half at least."""
    higher = F.when(F.col(seed_a) < F.col(seed_b), F.col(wins)).otherwise(F.col(games) - F.col(wins))
    got = df.groupBy(*keys).agg(F.sum(games).alias("comparisons"), F.sum(higher).alias("higher_wins"))
    return got.withColumn("confidence", F.greatest(F.lit(0.5), (F.col("higher_wins") + 1) / (F.col("comparisons") + 2).cast("double")))


def scores(df: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """n, accuracy (one half at 0.5), Brier and log loss."""
    pc, yc = F.col(p), F.col(y)
    right = F.when(pc == 0.5, 0.5).when((pc > 0.5) == (yc == 1), 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(brier(pc, yc)).alias("brier"), F.avg(log_loss(pc, yc)).alias("log_loss"))


def _uniform(seed: int, simulation: np.ndarray, match: int) -> np.ndarray:
    """Random numbers by counter: of a simulation and a match alone, so that neither order nor partitioning shows."""
    x = simulation.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + match) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def double_elimination(power: np.ndarray, simulations: np.ndarray, seed: int = 1) -> np.ndarray:
    """Champion (place in power, best seed first) of each simulation of a bracket of eight with a reset final.

    Losers drop across the bracket, so that no two meet again at once.  The second final is played only where the
    first goes to the side from below.  Checked: all but the champion lose twice, the champion at most once.
    """
    lost, count = np.zeros((len(simulations), len(power)), np.int64), 0
    line = np.arange(len(simulations))

    def play(a: np.ndarray, b: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        nonlocal count
        first = _uniform(seed, simulations, count) < 1 / (1 + np.exp(-(power[a] - power[b])))
        count += 1
        win, lose = np.where(first, a, b), np.where(first, b, a)
        if where is None:
            lost[line, lose] += 1
        else:
            win = np.where(where, win, a)
            lost[line[where], lose[where]] += 1
        return win, lose

    full = lambda i: np.full(len(simulations), i)
    one = [play(full(a), full(b)) for a, b in ((0, 7), (3, 4), (1, 6), (2, 5))]
    two = [play(one[0][0], one[1][0]), play(one[2][0], one[3][0])]
    low = [play(one[0][1], one[1][1])[0], play(one[2][1], one[3][1])[0]]
    low = [play(low[0], two[1][1])[0], play(low[1], two[0][1])[0]]
    top, dropped = play(two[0][0], two[1][0])
    below, _ = play(play(low[0], low[1])[0], dropped)
    first, _ = play(top, below)
    champion, _ = play(first, np.where(first == top, below, top), first == below)
    others = np.ones_like(lost, bool)
    others[line, champion] = False
    if len(line) and not ((lost[others] == 2).all() and (lost[line, champion] < 2).all()):
        raise AssertionError("a bracket lost a match")
    return champion


def bracket_titles(entrants: DataFrame, simulations: int = 20_000, seed: int = 1) -> DataFrame:
    """entrant, titles, title_chance for the eight entrants (entrant, strength; more are an error), seeded by strength."""
    field = entrants.orderBy(F.desc("strength"), "entrant").limit(9).collect()
    if len(field) != 8:
        raise ValueError("the bracket takes eight entrants")
    power, names = np.array([r["strength"] for r in field], float), [r["entrant"] for r in field]

    def run(batches):
        for pdf in batches:
            wins = np.bincount(double_elimination(power, pdf["id"].to_numpy(), seed), minlength=8)
            yield pd.DataFrame({"entrant": names, "titles": wins})

    kind = dict(entrants.dtypes)["entrant"]
    got = entrants.sparkSession.range(simulations).mapInPandas(run, f"entrant {kind}, titles long").groupBy("entrant").agg(F.sum("titles").alias("titles"))
    return got.withColumn("title_chance", F.col("titles") / float(simulations))
