"""Nested rolling choice of candidates, walk-forward folds and paired bootstraps.

An outer fold may use the scores of an earlier event only once its last outcome was known, so what it sees is a prefix of the
events in the order in which they became known.  Means and paired errors over prefixes are running sums, read as of each
fold's cutoff; no table of folds by events is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions import names as N

EPSILON = 2.220446049250313e-16  # the slack of the one-standard-error rule
FIXED, WARM, NONE, CHOSEN = "fixed", "warmup-default", "inner-unavailable-default", "inner-selected"


def as_of(known: DataFrame, asked: DataFrame, keys: list[str], known_at: str, asked_at: str, sums: dict[str, Column], last: str | None = None) -> DataFrame:
    """asked with running sums over the rows of known (per keys) that were known strictly before; last: the latest such time.

    Sums start at null where nothing was known.
    """
    parts = {name: c.alias(name) for name, c in sums.items()}
    rest = [c for c in asked.columns if c not in keys]
    a = known.select(*keys, F.col(known_at).cast("double").alias("_t"), F.lit(1).alias("_kind"), *parts.values())
    b = asked.select(*keys, F.col(asked_at).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.struct(*rest).alias("_asked"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.select(*keys, "_kind", "_asked", *(F.sum(n).over(upto).alias(n) for n in sums), F.max(F.when(F.col("_kind") == 1, F.col("_t"))).over(upto).alias("_last"))
    return out.where("_kind = 0").select(*keys, "_asked.*", *sums, *([F.col("_last").alias(last)] if last else []))


def nested_choice(scores: DataFrame, events: DataFrame, candidates: list[tuple[str, str, int]], least_inner: int = 12) -> DataFrame:
    """The candidate of every model for every event, chosen on the events known before it, with the event's own scores.

    scores: model, candidate, event, valid, n, log_loss, brier (sums over the event's sets; of an invalid fit those of its
    neutral forecast).  events: event, cutoff, available.  candidates: model, candidate, distance to the default (0: the default).

    Fewer than least_inner inner events leave the default; so does a model with one candidate.  Else the candidates valid in all inner events
    compete by mean event log loss (then Brier score, then name); of those within one paired standard error of the best, the one
    nearest to the default wins (then Brier score, then name).  The run fails if a score was used before its outcome was known.
    """
    c = F.col
    menu = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(x).alias("candidate"), F.lit(d).alias("distance")) for m, x, d in candidates))
    outer = scores.select("event").distinct().join(events, "event")
    asked = outer.select("event", "cutoff", F.inline(menu))
    own = scores.join(events.select("event", "available"), "event").withColumn("ll", c("log_loss") / c("n")).withColumn("bs", c("brier") / c("n"))
    sums = {"events": F.lit(1), "bad": (~c("valid")).cast("int"), "ll": c("ll"), "bs": c("bs")}
    seen = as_of(own, asked, ["model", "candidate"], "available", "cutoff", sums, "latest").fillna(0, ["events", "bad"])
    leak = F.raise_error(F.concat(F.lit("a score was used before its outcome was known, for event "), c("event").cast("string")))
    seen = seen.withColumn("latest", F.when(c("latest") >= c("cutoff"), leak.cast("double")).otherwise(c("latest")))
    seen = seen.withColumn("mean_ll", c("ll") / c("events")).withColumn("mean_bs", c("bs") / c("events")).withColumn("eligible", (c("events") > 0) & (c("bad") == 0))
    best = seen.groupBy("model", "event").agg(F.min_by("candidate", F.when(c("eligible"), F.struct("mean_ll", "mean_bs", "candidate"))).alias("best"), F.max(F.when(c("distance") == 0, c("candidate"))).alias("standard"), F.count("*").alias("choices"), F.max("events").alias("inner_events"), F.max("latest").alias("latest"))
    one = own.select("model", "event", "available", "candidate", "ll")
    other = own.select("model", "event", c("candidate").alias("best"), c("ll").alias("best_ll"))
    paired = one.join(other, ["model", "event"]).withColumn("d", c("ll") - c("best_ll"))
    rivals = seen.where("eligible").join(best.select("model", "event", "best"), ["model", "event"]).select("model", "candidate", "best", "event", "cutoff", "distance", "mean_bs")
    told = as_of(paired, rivals, ["model", "candidate", "best"], "available", "cutoff", {"m": F.lit(1), "d": c("d"), "dd": c("d") ** 2})
    error = F.when(c("m") > 1, F.sqrt(F.greatest(c("dd") - c("d") ** 2 / c("m"), F.lit(0.0)) / (c("m") - 1) / c("m"))).otherwise(F.lit(float("inf")))
    near = told.where(c("d") / c("m") <= error + EPSILON).groupBy("model", "event").agg(F.min_by("candidate", F.struct("distance", "mean_bs", "candidate")).alias("near"))
    mode = F.when(c("choices") == 1, FIXED).when(c("inner_events") < least_inner, WARM).when(c("near").isNull(), NONE).otherwise(CHOSEN)
    chosen = best.join(near, ["model", "event"], "left").withColumn("mode", mode).withColumn("chosen", F.when(c("mode") == CHOSEN, c("near")).otherwise(c("standard")))
    got = lambda name, p: scores.select("model", "event", c("candidate").alias(name), *(c(x).alias(f"{p}{x}") for x in ("valid", "n", "log_loss", "brier")))
    out = chosen.join(got("chosen", ""), ["model", "event", "chosen"]).join(got("standard", "standard_"), ["model", "event", "standard"])
    return out.select("model", "event", "mode", "chosen", "inner_events", "valid", "n", "log_loss", "brier", (c("log_loss") / c("n") - c("standard_log_loss") / c("n")).alias("versus_default"), (c("brier") / c("n") - c("standard_brier") / c("n")).alias("versus_default_brier"))


def summary(outer: DataFrame) -> DataFrame:
    """A row per model: events, sets, how they were chosen, scores as means over events and over sets, gain on the default where chosen."""
    c = F.col
    mode = lambda m: F.count_if(c("mode") == m)
    mature = c("mode") == CHOSEN
    return outer.groupBy("model").agg(
        F.count("*").alias("events"), F.sum("n").alias("sets"), mode(FIXED).alias("fixed"), mode(WARM).alias("warmup"), mode(NONE).alias("unavailable"), mode(CHOSEN).alias("chosen"),
        F.avg(c("log_loss") / c("n")).alias("macro_log_loss"), F.avg(c("brier") / c("n")).alias("macro_brier"), (F.sum("log_loss") / F.sum("n")).alias("pooled_log_loss"), (F.sum("brier") / F.sum("n")).alias("pooled_brier"),
        F.avg(F.when(mature, c("versus_default"))).alias("versus_default"), F.avg(F.when(mature, c("versus_default_brier"))).alias("versus_default_brier"),
    )


def bootstrap(clusters: DataFrame, keys: list[str], order: str, total: str, n: str, seed: Column, replicates: int = 10_000) -> DataFrame:
    """keys, clusters, mean, low, high: the mean of total per n with its 95 % interval, whole clusters drawn with replacement.

    The draw of a place in a replicate is the generator's number of that place, so replicates are rows and nothing is drawn in
    order; drawn places are joined with the numbered clusters (order: what numbers them, unique within keys).
    """
    c = F.col
    numbered = clusters.select(*keys, c(total).alias("_total"), c(n).alias("_n"), (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long").alias("_i"))
    groups = clusters.groupBy(*keys).agg(F.count("*").alias("clusters"), (F.sum(total) / F.sum(n)).alias("mean")).withColumn("_seed", seed.cast("long"))
    draws = groups.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), c("clusters") - 1)))
    place = F.floor(N.counted_random(c("_seed"), c("_r") * c("clusters") + c("_j") + 1) * c("clusters"))
    means = draws.select(*keys, "clusters", "mean", "_r", place.alias("_i")).join(numbered, [*keys, "_i"]).groupBy(*keys, "clusters", "mean", "_r").agg((F.sum("_total") / F.sum("_n")).alias("_m"))
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys, "clusters", "mean").agg(q.alias("_q")).select(*keys, "clusters", "mean", c("_q")[0].alias("low"), c("_q")[1].alias("high"))


def event_scores(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, log_loss, brier (sums): forecasts hold games, wins and p of a; a pair's games share its chance."""
    c = F.col
    p = F.least(F.greatest(c("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    lost = c("games") - c("wins")
    return forecasts.groupBy(*keys).agg(F.sum("games").alias("n"), F.sum(-c("wins") * F.log(p) - lost * F.log1p(-p)).alias("log_loss"), F.sum(c("wins") * (1 - c("p")) ** 2 + lost * c("p") ** 2).alias("brier"))
