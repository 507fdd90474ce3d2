"""Penalised logistic fits of sparse effects, many at a time, as iterated aggregates.

An observation of a fit is a number of games and of wins whose log-odds is a sum of x * value over its effects: the
strengths of two players with signs, their series effects, the weight of a feature.  All fits (folds, candidates,
segments) advance together: rows of (observation, effect) are joined with a table of effect values, summed per
observation, and summed back per effect, so no group holds a fit and nothing but the number of open fits reaches the driver.

Each round takes a Newton step by the diagonal, made conjugate to the one before.  Its length is what the curvature along it gives
as far as no log-odds moves by more than TRUST, where the curvature cannot double, or else what the greatest possible curvature gives:
either way the objective rises, so no step is ever taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from matchlake.functions.scalar import sigmoid
from matchlake.scratch import discard, materialize

TRUST = 0.5


def fit_effects(rows: DataFrame, effects: DataFrame, tolerance: float = 1e-7, most_rounds: int = 300) -> DataFrame:
    """fit, effect, value, information (of the diagonal), gradient, converged.

    rows: fit, observation, games, wins, effect, x.  effects: fit, effect, ridge, prior; the penalty is
    ridge / 2 * (value - prior) ** 2, and every effect of a row needs its entry.  Rounds end once no Newton
    step of any fit is longer than tolerance, or after most_rounds; converged tells whether those of the fit are.
    """
    c = F.col
    rows = materialize(rows.select("fit", "observation", c("games").cast("double").alias("games"), c("wins").cast("double").alias("wins"), "effect", c("x").cast("double").alias("x")), "rows")
    zero = F.lit(0.0)
    start = effects.select("fit", "effect", c("ridge").cast("double").alias("ridge"), c("prior").cast("double").alias("prior"), c("prior").cast("double").alias("value"), zero.alias("direction"), zero.alias("gradient"), c("ridge").cast("double").alias("information"), zero.alias("z_before"), zero.alias("norm_before"))
    state = materialize(start, "state")
    for _ in range(most_rounds + 1):
        seen = Observation()
        after = materialize(_round(rows, state), "state", seen, F.count_if(F.abs(c("gradient") / c("information")) >= tolerance).alias("open"))
        discard(state)
        state = after
        if not seen.get["open"]:
            break
    discard(rows)
    settled = state.groupBy("fit").agg((F.max(F.abs(c("gradient") / c("information"))) < tolerance).alias("converged"))
    return state.join(settled, "fit").select("fit", "effect", "value", "information", "gradient", "converged")


def _round(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One step for every fit. The first one does not move: it finds the gradient."""
    c, z = F.col, F.col("gradient") / F.col("information")
    sums = {"gz": c("gradient") * z, "turn": c("gradient") * (z - c("z_before")), "norm": c("norm_before"), "gd": c("gradient") * c("direction")}
    sums |= {"zz": c("ridge") * z * z, "zd": c("ridge") * z * c("direction"), "dd": c("ridge") * c("direction") ** 2}
    scalars = state.groupBy("fit").agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    keep = F.when(c("norm") > 0, F.greatest(F.lit(0.0), c("turn") / c("norm"))).otherwise(0.0)
    scalars = scalars.withColumn("keep", keep).withColumn("keep", F.when(c("gz") + c("keep") * c("gd") > 0, c("keep")).otherwise(0.0))  # uphill at all events
    scalars = scalars.select("fit", "keep", (c("gz") + c("keep") * c("gd")).alias("rise"), (c("zz") + 2 * c("keep") * c("zd") + c("keep") ** 2 * c("dd")).alias("stiff"))
    aimed = state.join(scalars.select("fit", "keep"), "fit").withColumn("direction", z + c("keep") * c("direction"))
    line = rows.join(aimed.select("fit", "effect", "value", "direction"), ["fit", "effect"]).groupBy("fit", "observation")
    line = line.agg(F.max("games").alias("games"), F.max("wins").alias("wins"), F.sum(c("x") * c("value")).alias("eta"), F.sum(c("x") * c("direction")).alias("slope"), F.collect_list(F.struct("effect", "x")).alias("terms"))
    chance = sigmoid(c("eta"))
    curve = line.groupBy("fit").agg(F.sum(c("games") * chance * (1 - chance) * c("slope") ** 2).alias("curve"), F.sum(c("games") / 4 * c("slope") ** 2).alias("most"), F.max(F.abs("slope")).alias("steep"))
    exact, sure = c("rise") / (c("curve") + c("stiff")), c("rise") / (c("most") + c("stiff"))
    length = F.when((c("rise") > 0) & (c("steep") > 0), F.least(exact, F.greatest(sure, TRUST / c("steep")))).when((c("rise") > 0) & (c("stiff") > 0), c("rise") / c("stiff")).otherwise(0.0)
    step = scalars.join(curve, "fit", "left").select("fit", length.alias("t"))
    after = sigmoid(c("eta") + c("t") * c("slope"))
    moved = line.join(step, "fit").select("fit", (c("wins") - c("games") * after).alias("r"), (c("games") * after * (1 - after)).alias("v"), F.explode("terms").alias("e"))
    found = moved.groupBy("fit", c("e.effect").alias("effect")).agg(F.sum(c("e.x") * c("r")).alias("up"), F.sum(c("e.x") ** 2 * c("v")).alias("down"))
    new = aimed.join(found, ["fit", "effect"], "left").join(step, "fit").withColumn("value", c("value") + c("t") * c("direction"))
    return new.select("fit", "effect", "ridge", "prior", "value", "direction", (F.coalesce("up", F.lit(0.0)) - c("ridge") * (c("value") - c("prior"))).alias("gradient"), (F.coalesce("down", F.lit(0.0)) + c("ridge")).alias("information"), z.alias("z_before"), (c("gradient") * z).alias("norm_before"))


def terms(observations: DataFrame, *effects: tuple[str, Column, Column | float]) -> DataFrame:
    """A row for each effect of an observation (kind, name, x); a null name has none. Effects are named kind|name."""
    each = F.array(*(F.struct(F.concat(F.lit(f"{kind}|"), name.cast("string")).alias("effect"), (x if isinstance(x, Column) else F.lit(x)).cast("double").alias("x")) for kind, name, x in effects))
    return observations.withColumn("_e", F.explode(each)).where("_e.effect IS NOT NULL").select("fit", "observation", "games", "wins", "_e.effect", "_e.x")


def effects_of(rows: DataFrame, ridges: dict[str, Column | float]) -> DataFrame:
    """The effects of the rows with the ridge of their kind, about zero; ridges may use columns of rows (constant in a fit)."""
    kind = F.substring_index("effect", "|", 1)
    ridge = F.lit(None).cast("double")
    for name, value in ridges.items():
        ridge = F.when(kind == name, value if isinstance(value, Column) else F.lit(float(value))).otherwise(ridge)
    return rows.groupBy("fit", "effect").agg(F.max(ridge).alias("ridge")).withColumn("prior", F.lit(0.0))
