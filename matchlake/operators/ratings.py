"""Ratings that advance event by event as tables: every player of every league (or fold, or candidate) at once.

Games of an event are simultaneous, so an event needs two joins of its pairs with the opening ratings, one sum per player and
one outer join back.  Events that end together form one step.  The number of steps is that of distinct ends; no group holds a
history, and what reaches the driver are the ends.

pairs: fit, day (of the event's end), a, b, games, wins (of a).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import decay, elo_probability, sigmoid
from matchlake.operators.effects import effects_of, fit_effects, terms
from matchlake.scratch import discard, materialize

SCALE = 173.7178  # Glicko-2 units


def _ends(pairs: DataFrame) -> list:
    return sorted(r["day"] for r in pairs.select("day").distinct().collect())


def advance(pairs: DataFrame, state: DataFrame, update: Callable[[DataFrame, DataFrame, float], DataFrame], history: bool = False) -> DataFrame:
    """State after the last event; with history the state of every player after each event that moved it.

    update(pairs of one end, state, end) gives the new state of the players in those pairs; the others stay.
    """
    pairs, past = materialize(pairs, "pairs"), []
    values = [c for c in state.columns if c not in ("fit", "player")]
    for day in _ends(pairs):
        moved = update(pairs.where(F.col("day") == day), state, day).select("fit", "player", F.struct(*values).alias("_new"))
        after = state.join(moved, ["fit", "player"], "full").select("fit", "player", *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values), F.col("_new").isNotNull().alias("_moved"))
        after = materialize(after, "ratings")
        past.append(after)
        if not history and len(past) > 1:
            discard(past.pop(0))
        state = after.drop("_moved")
    discard(pairs)
    if history and past:
        state = past[0].where("_moved").drop("_moved")
        for part in past[1:]:
            state = state.unionByName(part.where("_moved").drop("_moved"))
    return state


def _sided(pairs: DataFrame, state: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """pairs with the state of both sides (a_ and b_), defaults where a player has none."""
    out = pairs
    for side in "ab":
        own = state.select("fit", F.col("player").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in defaults))
        out = out.join(own, ["fit", side], "left").fillna({f"{side}_{c}": v for c, v in defaults.items()})
    return out


def _both(pairs: DataFrame, *columns: tuple[str, Column, Column]) -> DataFrame:
    """A row for either player: fit, player and columns (name, as a, as b)."""
    sides = F.array(*(F.struct(F.col(side).alias("player"), *(x[1 + k].alias(x[0]) for x in columns)) for k, side in enumerate("ab")))
    return pairs.select("fit", F.inline(sides))


def elo(pairs: DataFrame, options: DataFrame) -> DataFrame:
    """fit, player, rating: event-batch Elo of the events that end before the cutoff.

    options: fit, cutoff, k, scale, half_life.  An update weighs 2 ** (-age / half_life) of the event's end at
    the cutoff; ratings themselves do not decay.
    """
    own = pairs.join(options, "fit").where("day < cutoff")
    c = F.col

    def update(now: DataFrame, state: DataFrame, day: float) -> DataFrame:
        x = _sided(now, state, {"rating": 0.0})
        p = 1 / (1 + F.pow(F.lit(10.0), (c("b_rating") - c("a_rating")) / c("scale")))
        d = c("k") * F.pow(F.lit(2.0), -(c("cutoff") - c("day")) / c("half_life")) * (c("wins") - c("games") * p)
        change = _both(x.withColumn("d", d), ("d", c("d"), -c("d"))).groupBy("fit", "player").agg(F.sum("d").alias("d"))
        return change.join(state, ["fit", "player"], "left").select("fit", "player", (F.coalesce("rating", F.lit(0.0)) + c("d")).alias("rating"))

    return advance(own, _none(own, "rating double"), update)


def _none(pairs: DataFrame, columns: str) -> DataFrame:
    kinds = dict(pairs.dtypes)
    return pairs.sparkSession.createDataFrame([], f"fit {kinds['fit']}, player {kinds['a']}, {columns}")


def rolling_form(pairs: DataFrame, half_life: float = 180.0, prior: float = 6.0, k: float = 24.0, scale: float = 400.0) -> tuple[DataFrame, DataFrame]:
    """The form of every pair before its event, and the state of players after each of their events.

    Residuals are results less the chances that opening ratings give; form is their recency-weighted mean with a prior
    weight.  All pairs of an end see the same opening state.  First: pairs with form (of a less b).  Second: fit, player, day, total,
    weight, rating.
    """
    c = F.col

    def at(side: str, day) -> Column:
        age = decay(day - c(f"{side}_day"), half_life)
        return F.coalesce(c(f"{side}_total") * age / (c(f"{side}_weight") * age + prior), F.lit(0.0))

    def update(now: DataFrame, state: DataFrame, day: float) -> DataFrame:
        x = _sided(now, state, {"rating": 0.0})
        left = c("wins") - c("games") * elo_probability(c("a_rating"), c("b_rating"), scale)
        moved = _both(x.withColumn("r", left), ("r", c("r"), -c("r")), ("n", c("games"), c("games"))).groupBy("fit", "player").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
        old = moved.join(state, ["fit", "player"], "left")
        age = F.coalesce(decay(F.lit(float(day)) - c("day"), half_life), F.lit(0.0))
        kept = lambda x: F.coalesce(c(x), F.lit(0.0))
        return old.select("fit", "player", F.lit(float(day)).alias("day"), (kept("total") * age + c("r")).alias("total"), (kept("weight") * age + c("n")).alias("weight"), (kept("rating") + k * c("r")).alias("rating"))

    past = advance(pairs, _none(pairs, "day double, total double, weight double, rating double"), update, history=True)
    out = pairs.withColumn("_id", F.struct("fit", "day", "event", "a", "b"))
    for side in "ab":
        before = past.select("fit", c("player").alias(side), c("day").alias("_at"), F.struct(c("day"), c("total"), c("weight")).alias("_s"))
        found = out.select("_id", "fit", side, "day").join(before, ["fit", side]).where("_at < day").groupBy("_id").agg(F.max_by("_s", "_at").alias("_s"))
        out = out.join(found.select("_id", *(c(f"_s.{x}").alias(f"{side}_{x}") for x in ("day", "total", "weight"))), "_id", "left")
    form = at("a", c("day")) - at("b", c("day"))
    return out.select(*pairs.columns, form.alias("form")), past


def form_at(past: DataFrame, cutoffs: DataFrame, half_life: float = 180.0, prior: float = 6.0) -> DataFrame:
    """fit, cutoff, player, form: the last state before each cutoff (fit, cutoff), decayed to it."""
    c = F.col
    last = past.join(cutoffs, "fit").where("day < cutoff").groupBy("fit", "cutoff", "player").agg(F.max_by(F.struct("day", "total", "weight"), "day").alias("s"))
    age = decay(c("cutoff") - c("s.day"), half_life)
    return last.select("fit", "cutoff", "player", (c("s.total") * age / (c("s.weight") * age + prior)).alias("form"))


def dynamic_bradley_terry(pairs: DataFrame, options: DataFrame) -> DataFrame:
    """fit, player, strength at the cutoff: each event is fitted jointly about the decayed strengths of those who return.

    options: fit, cutoff, half_life, ridge.
    """
    own = pairs.join(options, "fit").where("day < cutoff")
    c = F.col

    def update(now: DataFrame, state: DataFrame, day: float) -> DataFrame:
        rows = terms(now.withColumn("observation", F.struct("a", "b", "event")), ("player", c("a"), 1.0), ("player", c("b"), -1.0))
        players = _both(now, ("ridge", c("ridge"), c("ridge")), ("half_life", c("half_life"), c("half_life"))).distinct()
        prior = F.coalesce(c("strength") * F.pow(F.lit(2.0), -(F.lit(float(day)) - c("day")) / c("half_life")), F.lit(0.0))
        effects = materialize(players.join(state, ["fit", "player"], "left").select("fit", "player", F.concat(F.lit("player|"), c("player").cast("string")).alias("effect"), "ridge", prior.alias("prior")), "priors")
        fitted = fit_effects(rows, effects)
        return effects.select("fit", "player", "effect").join(fitted, ["fit", "effect"]).select("fit", "player", F.lit(float(day)).alias("day"), c("value").alias("strength"))

    out = advance(own, _none(own, "day double, strength double"), update)
    return out.join(options, "fit").select("fit", "player", (c("strength") * F.pow(F.lit(2.0), -(c("cutoff") - c("day")) / c("half_life"))).alias("strength"))


def glicko2(pairs: DataFrame, tau: float = 0.5) -> DataFrame:
    """fit, player, rating, deviation, volatility after all events, one rating period each."""
    c = F.col
    g = lambda phi: 1 / F.sqrt(1 + 3 * phi * phi / math.pi**2)

    @F.pandas_udf("double")
    def volatility(phi: pd.Series, v: pd.Series, delta: pd.Series, vol: pd.Series) -> pd.Series:
        return pd.Series(_volatility(*(x.to_numpy(float) for x in (phi, v, delta, vol)), tau))

    def update(now: DataFrame, state: DataFrame, day: float) -> DataFrame:
        x = _sided(now, state, {"mu": 0.0, "phi": 350 / SCALE})
        side = lambda me, other, n, wins: (g(c(f"{other}_phi")), 1 / (1 + F.exp(-g(c(f"{other}_phi")) * (c(f"{me}_mu") - c(f"{other}_mu")))), wins)
        sums = []
        for me, other, wins in (("a", "b", c("wins")), ("b", "a", c("games") - c("wins"))):
            w, e, won = side(me, other, c("games"), wins)
            sums.append((c("games") * w * w * e * (1 - e), w * (won - c("games") * e)))
        met = _both(x, ("information", sums[0][0], sums[1][0]), ("drift", sums[0][1], sums[1][1])).groupBy("fit", "player").agg(F.sum("information").alias("information"), F.sum("drift").alias("drift"))
        old = met.join(state, ["fit", "player"], "left").fillna({"mu": 0.0, "phi": 350 / SCALE, "vol": 0.06})
        v = 1 / c("information")
        new = old.withColumn("vol", volatility("phi", v, v * c("drift"), "vol"))
        new = new.withColumn("phi", 1 / F.sqrt(1 / (c("phi") ** 2 + c("vol") ** 2) + c("information")))
        return new.select("fit", "player", (c("mu") + c("phi") ** 2 * c("drift")).alias("mu"), "phi", "vol")

    out = advance(pairs, _none(pairs, "mu double, phi double, vol double"), update)
    return out.select("fit", "player", (1500 + SCALE * c("mu")).alias("rating"), (SCALE * c("phi")).alias("deviation"), c("vol").alias("volatility"))


def _volatility(phi: np.ndarray, v: np.ndarray, delta: np.ndarray, vol: np.ndarray, tau: float, tolerance: float = 1e-6) -> np.ndarray:
    """Roots of the volatility equation by regula falsi with halving, all rows at once."""
    a = np.log(vol * vol)

    def f(x: np.ndarray) -> np.ndarray:
        e = np.exp(x)
        return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / tau**2

    gap = delta**2 - phi**2 - v
    high = np.where(gap > 0, np.log(np.where(gap > 0, gap, 1)), a - tau)
    while (low := (gap <= 0) & (f(high) < 0)).any():
        high = np.where(low, high - tau, high)
    low, f_low, f_high = a, f(a), f(high)
    while (open_ := np.abs(high - low) > tolerance).any():
        mid = np.where(open_, low + (low - high) * f_low / np.where(open_, f_high - f_low, 1), low)
        f_mid = f(mid)
        crossed = f_mid * f_high <= 0
        low, f_low = np.where(open_, np.where(crossed, high, low), low), np.where(open_, np.where(crossed, f_high, f_low / 2), f_low)
        high, f_high = np.where(open_, mid, high), np.where(open_, f_mid, f_high)
    return np.exp(low / 2)


def regularised(sets: DataFrame, options: DataFrame) -> DataFrame:
    """Bradley-Terry strengths with the logarithm of the seeds' ratio and recent form, fitted for every row of options at once.

    sets: league, event, day (when its outcome was known), a, b, games, wins, seed (ln of b's over a's; 0 if unknown), form.
    options: fit, league, cutoff, ability_ridge, feature_ridge.  Features are scaled by the root mean square of their
    values other than zero.  Gives fit, effect, value, converged and the scale of feature effects.
    """
    c = F.col
    known = sets.join(options.select("fit", "league", "cutoff"), "league").where("day < cutoff")
    square = lambda x: F.sqrt(F.sum(c(x) ** 2 * c("games")) / F.sum(F.when(c(x) != 0, c("games"))))
    scale = lambda x: F.coalesce(F.when(square(x) > 0, square(x)), F.lit(1.0)).alias(f"{x}_scale")
    scales = materialize(known.groupBy("fit").agg(scale("seed"), scale("form")), "scales")
    observed = known.join(scales, "fit").withColumn("observation", F.struct("event", "a", "b"))
    rows = terms(observed, ("player", c("a"), 1.0), ("player", c("b"), -1.0), ("feature", F.lit("seed"), c("seed") / c("seed_scale")), ("feature", F.lit("form"), c("form") / c("form_scale")))
    rows = rows.join(options.select("fit", "ability_ridge", "feature_ridge"), "fit")
    fitted = fit_effects(rows, effects_of(rows, {"player": c("ability_ridge"), "feature": c("feature_ridge")}))
    own = F.when(c("effect") == "feature|seed", c("seed_scale")).when(c("effect") == "feature|form", c("form_scale"))
    return fitted.join(scales, "fit").select("fit", "effect", "value", own.alias("scale"), "converged")


def hierarchical(observations: DataFrame, options: DataFrame, player_ridge: float = 2.0, series_ridge: float = 12.0, half_life: float = 730.0) -> DataFrame:
    """Strengths of players and of players within series: fit, effect, value, error (standard), games, converged.

    observations: league, day, series (null: none), a, b, weight, won.  options: fit, league, cutoff; a fit learns from the days before
    its cutoff, and a weight halves with every half_life days before it.  Effects are player|name and series|series|name.
    """
    c = F.col
    known = observations.join(options, "league").where("day < cutoff")
    weight = c("weight") * F.pow(F.lit(0.5), (c("cutoff") - c("day")) / half_life)
    pairs = known.groupBy("fit", "series", "a", "b").agg(F.sum(weight).alias("games"), F.sum(weight * c("won")).alias("wins"), F.count("*").alias("n"))
    pairs = materialize(pairs.withColumn("observation", F.struct("series", "a", "b")), "pairs")
    within = lambda side: F.concat(c("series").cast("string"), F.lit("|"), c(side).cast("string"))
    sides = (("player", c("a"), 1.0), ("player", c("b"), -1.0), ("series", within("a"), 1.0), ("series", within("b"), -1.0))
    rows = terms(pairs, *sides)
    fitted = fit_effects(rows, effects_of(rows, {"player": player_ridge, "series": series_ridge}))
    seen = terms(pairs.withColumns({"games": c("n"), "wins": c("n")}), *sides).groupBy("fit", "effect").agg(F.sum("games").cast("long").alias("games"))
    return fitted.join(seen, ["fit", "effect"]).select("fit", "effect", "value", F.sqrt(1 / c("information")).alias("error"), "games", "converged")


def chance(pairs: DataFrame, fitted: DataFrame, series: bool = False) -> DataFrame:
    """pairs (fit, a, b, series) with p, the chance of a; an effect that is not known counts as zero."""
    c, out, total = F.col, pairs, F.lit(0.0)
    for kind, side, sign in (("player", "a", 1.0), ("player", "b", -1.0), *((("series", "a", 1.0), ("series", "b", -1.0)) if series else ())):
        name, value = f"_{kind}_{side}", f"_v_{kind}_{side}"
        effect = F.concat(F.lit(f"{kind}|"), *((c("series").cast("string"), F.lit("|")) if kind == "series" else ()), c(side).cast("string"))
        out = out.withColumn(name, effect).join(fitted.select("fit", c("effect").alias(name), c("value").alias(value)), ["fit", name], "left")
        total = total + sign * F.coalesce(value, F.lit(0.0))
    return out.withColumn("p", sigmoid(total)).select(*pairs.columns, "p")
