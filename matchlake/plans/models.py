"""Fitted models, walk-forward suites and nested tuning over the driver tables.

A contest sets the nation of an order's customer against the nation that its key names; half-years are the events. An outcome
is known some days after its game, so the last ones of an event come after the next has begun.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.functions import names as N
from matchlake.functions import scalar as S
from matchlake.operators import audit as A
from matchlake.operators import forecast as M
from matchlake.operators import ratings as R
from matchlake.operators import tuning as T
from matchlake.plans.registry import VIEWS, games, plays, query, rounded
from matchlake.scratch import materialize
from matchlake.session import load

CUTOFF = 2192  # days from 1992 to 1998
ORIGIN = "1992-01-01"


def contests(spark, sf):
    g = games(spark, sf).where("w IS NOT NULL").withColumn("b", (F.col("game") % 25).cast("int")).where("b <> nation")
    day = F.datediff(F.to_date("ts"), F.lit(ORIGIN).cast("date"))
    half = ((F.year("ts") - 1992) * 2 + F.floor((F.month("ts") - 1) / 6)).cast("int")
    return g.select("game", "player", "segment", F.year("ts").alias("year"), half.alias("event"), day.alias("day"), (day + F.col("game") % 40).alias("completed"), F.col("nation").alias("a"), "b", F.col("w").alias("won"))


def half_years(spark, sf, event="event"):
    """events (event, cutoff, available) and pairs (event, a, b, games, wins); event may be year."""
    h = contests(spark, sf).withColumn("event", F.col(event))
    events = h.groupBy("event").agg(F.min("day").alias("cutoff"), F.greatest(F.max("day"), F.max("completed")).alias("available"))
    return materialize(events, "events"), materialize(h.groupBy("event", "a", "b").agg(F.count("*").alias("games"), F.sum("won").cast("long").alias("wins")), "pairs")


VIEWS["contests"] = """h AS (SELECT game, player, segment, CAST(year(ts) AS INTEGER) AS year, CAST((year(ts) - 1992) * 2 + (month(ts) - 1) // 6 AS INTEGER) AS event, date_diff('day', DATE '1992-01-01', CAST(ts AS DATE)) AS day,
  date_diff('day', DATE '1992-01-01', CAST(ts AS DATE)) + game % 40 AS completed, nation AS a, CAST(game % 25 AS INTEGER) AS b, w AS won FROM games WHERE w IS NOT NULL AND game % 25 <> nation),
e AS (SELECT event, min(day) AS cutoff, greatest(max(day), max(completed)) AS available FROM h GROUP BY event),
q AS (SELECT event, a, b, count(*) AS games, CAST(sum(won) AS BIGINT) AS wins FROM h GROUP BY ALL)"""


def fit_sql(obs: str, sides: str, ridges: str, rounds: int = 400) -> str:
    """CTEs that end in fitted (fit, effect, v, down): the optimum by damped diagonal steps, effects centred within what they can shift together.

    obs: a query for fit, o, games, wins and columns that sides (queries of fit, o, effect, x, joined by UNION ALL) use; ridges: CASE over effect.
    """
    return f"""obs AS ({obs}), terms AS ({sides}), eff AS (SELECT DISTINCT fit, effect, CAST({ridges} AS DOUBLE) AS ridge, regexp_replace(effect, '[|][^|]*$', '') AS grp FROM terms),
b AS (SELECT 0 AS k, fit, effect, 0.0::DOUBLE AS v, 0.0::DOUBLE AS down FROM eff UNION ALL
  SELECT k, fit, effect, CASE WHEN grp = 'feature' THEN v ELSE v - avg(v) OVER (PARTITION BY fit, grp) END, down FROM (SELECT b.k + 1 AS k, b.fit, b.effect, grp, coalesce(g.down, 0) + ridge AS down, b.v + 0.65 * (coalesce(g.up, 0) - ridge * b.v) / (coalesce(g.down, 0) + ridge) AS v
    FROM b JOIN eff USING (fit, effect) LEFT JOIN (SELECT t.fit, t.effect, sum(x * (wins - games * p)) AS up, sum(x * x * games * p * (1 - p)) AS down FROM terms t
      JOIN (SELECT t.fit, t.o, 1 / (1 + exp(-sum(x * b.v))) AS p FROM terms t JOIN b USING (fit, effect) GROUP BY ALL) z ON z.fit = t.fit AND z.o = t.o JOIN obs ON obs.fit = t.fit AND obs.o = t.o GROUP BY ALL) g USING (fit, effect) WHERE b.k < {rounds})),
fitted AS (SELECT fit, effect, v, down FROM b WHERE k = {rounds})"""


PLAYERS = "SELECT fit, o, 'player|' || a AS effect, 1.0::DOUBLE AS x FROM obs UNION ALL SELECT fit, o, 'player|' || b, -1.0 FROM obs"
SERIES = PLAYERS + " UNION ALL SELECT fit, o, 'series|' || series || '|' || a, 1.0 FROM obs UNION ALL SELECT fit, o, 'series|' || series || '|' || b, -1.0 FROM obs"

# --- ratings -------------------------------------------------------------------------------------------------


def leagues(spark, sf):
    """Counts per event (a year) and pair of each segment."""
    pairs = M.event_pairs(contests(spark, sf).withColumn("event", F.col("year")), ["segment"], "event", "day", "a", "b", "won")
    return materialize(pairs.withColumnRenamed("segment", "fit"), "leagues")


def _with(pairs, **options):
    return pairs.select("fit").distinct().withColumns({k: F.lit(v) for k, v in options.items()})


YEARS = """y AS (SELECT segment, year AS event, a, b, max(max(day)) OVER (PARTITION BY segment, year) AS fin, count(*) AS n, sum(won) AS wins FROM h GROUP BY segment, year, a, b)"""


def _elo_sql() -> str:
    """The events in turn, each from the ratings before it."""
    steps = ["r1991 AS (SELECT DISTINCT segment, a AS player, 0.0::DOUBLE AS rating, false AS seen FROM h UNION SELECT DISTINCT segment, b, 0.0::DOUBLE, false FROM h)"]
    for y in range(1992, 1998):
        c = "32 * 2.0 ** (-(2192 - fin) / 730.0) * (wins - n / (1 + 10 ** ((z.rating - x.rating) / 400)))"
        steps.append(f"c{y} AS (SELECT y.*, {c} AS c FROM y JOIN r{y - 1} x ON x.segment = y.segment AND x.player = a JOIN r{y - 1} z ON z.segment = y.segment AND z.player = b WHERE event = {y} AND fin < 2192)")
        steps.append(f"r{y} AS (SELECT r.segment, r.player, any_value(r.rating) + coalesce(sum(d.c), 0) AS rating, bool_or(r.seen OR d.c IS NOT NULL) AS seen FROM r{y - 1} r LEFT JOIN (SELECT segment, a AS player, c FROM c{y} UNION ALL SELECT segment, b, -c FROM c{y}) d ON d.segment = r.segment AND d.player = r.player GROUP BY r.segment, r.player)")
    return f"WITH {YEARS}, {', '.join(steps)} SELECT segment, player, round(rating, 4) AS rating FROM r1997 WHERE seen"


@query("m06_elo", _elo_sql(), "games", "contests")
def m06(spark, sf):
    pairs = leagues(spark, sf)
    got = R.elo(pairs, _with(pairs, cutoff=CUTOFF, k=32.0, scale=400.0, half_life=730.0))
    return rounded(got.withColumnRenamed("fit", "segment"), 4)


@query("m07_glicko2")
def m07(spark, sf):
    return rounded(R.glicko2(leagues(spark, sf)).withColumnRenamed("fit", "segment"), 4)


@query("m08_dyn_bt")
def m08(spark, sf):
    pairs = leagues(spark, sf)
    return rounded(R.dynamic_bradley_terry(pairs, _with(pairs, cutoff=CUTOFF, half_life=365.0, ridge=1.0)).withColumnRenamed("fit", "segment"))


# --- regularised and hierarchical fits -----------------------------------------------------------------------


def seeded(pairs, leagues=("league",)):
    """pairs with seed: the logarithm of b's seed over a's, seeds being places by wins in the event before; 0 where one has none."""
    c = F.col
    wins = R._both(pairs.withColumn("fit", F.struct(*leagues, "event")), ("wins", c("wins"), c("games") - c("wins"))).select("fit.*", "player", "wins")
    order = Window.partitionBy(*leagues, "event").orderBy(F.desc("wins"), "player")
    seeds = wins.groupBy(*leagues, "event", "player").agg(F.sum("wins").alias("wins")).select(*leagues, (c("event") + 1).alias("event"), "player", F.row_number().over(order).alias("seed"))
    for side in "ab":
        pairs = pairs.join(seeds.select(*leagues, "event", c("player").alias(side), c("seed").alias(f"seed_{side}")), [*leagues, "event", side], "left")
    return pairs.withColumn("seed", F.coalesce(F.log(c("seed_b") / c("seed_a")), F.lit(0.0)))


def seeded_form(pairs):
    """pairs (fit, event, day, a, b, games, wins) as sets of a league with seed and form."""
    formed, past = R.rolling_form(pairs)
    return materialize(seeded(formed.withColumnRenamed("fit", "league")), "sets"), past


def _form_sql(first: int, last: int) -> str:
    """CTEs that end in sets (league, event, day, a, b, games, wins, seed, form) from y (league, event, a, b, fin, n, wins), a half-year or year to an event."""
    form = "coalesce({0}.total * 2.0 ** (-(y.fin - {0}.seen_at) / 180.0) / ({0}.weight * 2.0 ** (-(y.fin - {0}.seen_at) / 180.0) + 6), 0)"
    steps = [f"s{first - 1} AS (SELECT league, a AS player, 0.0::DOUBLE AS rating, 0.0::DOUBLE AS total, 0.0::DOUBLE AS weight, 0 AS seen_at FROM y UNION SELECT league, b, 0.0, 0.0, 0.0, 0 FROM y)"]
    for k in range(first, last + 1):
        steps.append(f"f{k} AS (SELECT y.*, {form.format('u')} - {form.format('w')} AS form, wins - n / (1 + 10 ** ((w.rating - u.rating) / 400)) AS r FROM y JOIN s{k - 1} u ON u.league = y.league AND u.player = a JOIN s{k - 1} w ON w.league = y.league AND w.player = b WHERE event = {k})")
        steps.append(f"d{k} AS (SELECT league, player, sum(r) AS r, sum(n) AS n, any_value(fin) AS fin FROM (SELECT league, a AS player, r, n, fin FROM f{k} UNION ALL SELECT league, b, -r, n, fin FROM f{k}) GROUP BY ALL)")
        steps.append(f"s{k} AS (SELECT s.league, s.player, rating + 24 * coalesce(r, 0) AS rating, CASE WHEN r IS NULL THEN total ELSE total * 2.0 ** (-(fin - seen_at) / 180.0) + r END AS total, CASE WHEN r IS NULL THEN weight ELSE weight * 2.0 ** (-(fin - seen_at) / 180.0) + n END AS weight, coalesce(fin, seen_at) AS seen_at FROM s{k - 1} s LEFT JOIN d{k} d USING (league, player))")
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(first, last + 1))
    return f"""{', '.join(steps)}, formed AS ({every}),
placed AS (SELECT league, event + 1 AS event, player, row_number() OVER (PARTITION BY league, event ORDER BY sum(w) DESC, player) AS seed FROM (SELECT league, event, a AS player, wins AS w FROM y UNION ALL SELECT league, event, b, n - wins FROM y) GROUP BY league, event, player),
sets AS (SELECT formed.league, formed.event, fin AS day, a, b, n AS games, wins, coalesce(ln(z.seed / x.seed), 0) AS seed, form FROM formed LEFT JOIN placed x ON x.league = formed.league AND x.event = formed.event AND x.player = a LEFT JOIN placed z ON z.league = formed.league AND z.event = formed.event AND z.player = b)"""


@query("m09_regularised_bt", f"""WITH RECURSIVE {YEARS.replace('SELECT segment, year', 'SELECT segment AS league, year')}, {_form_sql(1992, 1998)},
{fit_sql("SELECT league AS fit, concat_ws('|', event, a, b) AS o, a, b, games, wins, seed / coalesce(sqrt(sum(seed * seed * games) OVER w / sum(games) FILTER (seed <> 0) OVER w), 1) AS seed, form / coalesce(sqrt(sum(form * form * games) OVER w / sum(games) FILTER (form <> 0) OVER w), 1) AS form FROM sets WHERE day < 2192 WINDOW w AS (PARTITION BY league)", PLAYERS + " UNION ALL SELECT fit, o, 'feature|seed', seed FROM obs UNION ALL SELECT fit, o, 'feature|form', form FROM obs", "2.0")}
SELECT fit AS segment, effect, round(v, 5) AS value FROM fitted""", "games", "contests")
def m09(spark, sf):
    """Strengths of each segment's players with the weights of seeds and recent form, fitted at once."""
    sets, _ = seeded_form(leagues(spark, sf))
    options = sets.select("league").distinct().select(F.col("league").alias("fit"), "league", F.lit(CUTOFF).alias("cutoff"), F.lit(2.0).alias("ability_ridge"), F.lit(2.0).alias("feature_ridge"))
    return rounded(R.regularised(sets, options).select(F.col("fit").alias("segment"), "effect", "value"), 5)


def series_fit(spark, sf):
    """Strengths of nations, and of nations within segments, from the games before 1997; a player's games of a year weigh one together."""
    known = A.with_set_weights(contests(spark, sf).where("day < 1827"), ["player", "year"])
    options = spark.range(1).select(F.lit("all").alias("fit"), F.lit("all").alias("league"), F.lit(1827).alias("cutoff"))
    return R.hierarchical(known.select(F.lit("all").alias("league"), "day", F.col("segment").alias("series"), "a", "b", "weight", "won"), options)


SERIES_FIT = "o AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY player, year) AS weight FROM h WHERE day < 1827), " + fit_sql("SELECT 'all' AS fit, concat_ws('|', segment, a, b) AS o, segment AS series, a, b, sum(weight * 0.5 ** ((1827 - day) / 730.0)) AS games, sum(weight * won * 0.5 ** ((1827 - day) / 730.0)) AS wins, count(*) AS n FROM o GROUP BY ALL", SERIES, "CASE WHEN starts_with(effect, 'player') THEN 2 ELSE 12 END", 600)


@query("m10_hierarchical_bt", f"WITH RECURSIVE {SERIES_FIT}, c AS (SELECT effect, CAST(sum(n) AS BIGINT) AS games FROM terms JOIN obs USING (o) GROUP BY effect) SELECT effect, round(v, 5) AS value, round(sqrt(1 / down), 5) AS error, games FROM fitted JOIN c USING (effect)", "games", "contests")
def m10(spark, sf):
    return rounded(series_fit(spark, sf).select("effect", "value", "error", "games"), 5)


@query("m31_pair_forecast", f"WITH RECURSIVE {SERIES_FIT} SELECT a.n_nationkey AS a, b.n_nationkey AS b, s.series, round(1 / (1 + exp(-(coalesce(w.v, 0) - coalesce(x.v, 0) + coalesce(y.v, 0) - coalesce(z.v, 0)))), 5) AS p FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey CROSS JOIN (SELECT DISTINCT c_mktsegment AS series FROM customer) s LEFT JOIN fitted w ON w.effect = 'player|' || a.n_nationkey LEFT JOIN fitted x ON x.effect = 'player|' || b.n_nationkey LEFT JOIN fitted y ON y.effect = 'series|' || series || '|' || a.n_nationkey LEFT JOIN fitted z ON z.effect = 'series|' || series || '|' || b.n_nationkey", "games", "contests")
def m31(spark, sf):
    """Chances of the pairs of each region in each series; a strength or series effect that is not known counts as neutral."""
    n, series = load(spark, sf, "nation"), load(spark, sf, "customer").select(F.col("c_mktsegment").alias("series")).distinct()
    side = lambda c: n.select(F.col("n_nationkey").alias(c), "n_regionkey")
    pairs = side("a").join(side("b"), "n_regionkey").where("b > a").select(F.lit("all").alias("fit"), "a", "b").join(series.withColumn("fit", F.lit("all")), "fit")
    return rounded(R.chance(pairs, series_fit(spark, sf), series=True).select("a", "b", "series", "p"), 5)


# --- walk-forward, suite, tuning -----------------------------------------------------------------------------


@query("m12_walk_forward", f"""WITH RECURSIVE {fit_sql("SELECT e.event AS fit, concat_ws('|', a, b) AS o, a, b, sum(0.5 ** ((cutoff - day) / 730.0)) AS games, sum(won * 0.5 ** ((cutoff - day) / 730.0)) AS wins FROM e JOIN h ON h.day < e.cutoff AND h.completed < e.cutoff GROUP BY ALL", PLAYERS, "2.0")},
known AS (SELECT e.event, count(h.day) AS before FROM e LEFT JOIN h ON h.day < e.cutoff AND h.completed < e.cutoff GROUP BY e.event),
p AS (SELECT q.event, games, wins, 1 / (1 + exp(-(coalesce(x.v, 0) - coalesce(y.v, 0)))) AS p FROM q JOIN known ON known.event = q.event AND before >= 50 LEFT JOIN fitted x ON x.fit = q.event AND x.effect = 'player|' || a LEFT JOIN fitted y ON y.fit = q.event AND y.effect = 'player|' || b)
SELECT event, CAST(sum(games) AS BIGINT) AS n, round(sum(-wins * ln(p) - (games - wins) * ln(1 - p)) / sum(games), 5) AS log_loss, round(sum(wins * (1 - p) ** 2 + (games - wins) * p ** 2) / sum(games), 5) AS brier FROM p GROUP BY event""", "games", "contests")
def m12(spark, sf):
    """Every half-year forecast by a fit of its own, from the games whose outcomes were known before it, once fifty were."""
    h = contests(spark, sf)
    events, pairs = half_years(spark, sf)
    c = F.col
    known = h.select(F.lit("all").alias("league"), F.greatest("day", "completed").alias("at"), "day", F.lit(None).cast("string").alias("series"), "a", "b", F.lit(1.0).alias("weight"), "won")
    options = events.select(c("event").alias("fit"), F.lit("all").alias("league"), "cutoff")
    before = T.as_of(known.groupBy("league", "at").agg(F.count("*").alias("n")), options, ["league"], "at", "cutoff", {"before": c("n")}).where("before >= 50").select("fit", "league", "cutoff")
    own = materialize(before, "folds")
    fitted = R.hierarchical(known.join(own.withColumnRenamed("cutoff", "_cut"), "league").where("at < _cut").withColumn("league", c("fit")).drop("fit", "_cut"), own.withColumn("league", c("fit")))
    asked = pairs.withColumn("fit", c("event")).join(own.select("fit"), "fit", "left_semi")
    scores = T.event_scores(R.chance(asked, fitted), ["event"])
    return rounded(scores.select("event", "n", (c("log_loss") / c("n")).alias("log_loss"), (c("brier") / c("n")).alias("brier")), 5)


HALF_LIVES, PRIORS = (180.0, 730.0), (0.0, 1.0, 4.0, 16.0)
#: name, half-life, prior games of either result, distance to the default
RATES = [("rate-730-4", 730.0, 4.0, 0), ("rate-180-4", 180.0, 4.0, 1), ("rate-730-16", 730.0, 16.0, 1), ("rate-180-1", 180.0, 1.0, 2), ("rate-180-0", 180.0, 0.0, 3)]
LEAST_INNER, LEAST_FITTED = 4, 2
FAMILIES = [("neutral", "neutral", 0), ("higher-seed", "higher-seed", 0), *(("rate", name, d) for name, _, _, d in RATES)]


def rate_forecasts(events, pairs):
    """candidate, event, a, b, games, wins, p: players' decayed and smoothed rates of wins, known at the event's cutoff, set against each other.

    A candidate without a prior has no chance for players it does not know or who never won or never lost: its
    fit is not valid for that event.
    """
    c = F.col
    candidates = F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(h).alias("half_life"), F.lit(k).alias("prior")) for n, h, k, _ in RATES))
    lives = F.array(*(F.lit(h) for h in sorted({h for _, h, _, _ in RATES})))
    sides = R._both(pairs.withColumn("fit", c("event")), ("games", c("games"), c("games")), ("wins", c("wins"), c("games") - c("wins")))
    known = sides.groupBy(c("fit").alias("event"), "player").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins")).join(events.select("event", "available"), "event")
    known = known.withColumn("half_life", F.explode(lives)).withColumn("scale", F.pow(F.lit(2.0), c("available") / c("half_life")))
    asked = sides.select(c("fit").alias("event"), "player").distinct().join(events.select("event", "cutoff"), "event").withColumn("half_life", F.explode(lives))
    told = T.as_of(known, asked, ["half_life", "player"], "available", "cutoff", {"won": c("wins") * c("scale"), "played": c("games") * c("scale")})
    now = F.pow(F.lit(2.0), -c("cutoff") / c("half_life"))
    told = told.withColumns({"won": F.coalesce(c("won") * now, F.lit(0.0)), "played": F.coalesce(c("played") * now, F.lit(0.0))})
    out = pairs.withColumn("o", F.explode(candidates)).select(*pairs.columns, "o.*")
    for side in "ab":
        rate = (c("won") + c("prior")) / F.nullif(c("played") + 2 * c("prior"), F.lit(0.0))
        own = told.select("event", "half_life", c("player").alias(side), "won", "played")
        out = out.join(own, ["event", "half_life", side]).withColumn(f"r_{side}", rate).drop("won", "played")
    up, down = c("r_a") * (1 - c("r_b")), c("r_b") * (1 - c("r_a"))
    return out.withColumn("p", F.when(up + down > 0, up / (up + down))).select("candidate", "event", "a", "b", "games", "wins", "p")


def seed_forecasts(events, pairs):
    """event, a, b, games, wins, p: the better seed wins with the smoothed share of the seeded games known before; one half without seeds."""
    c = F.col
    s = seeded(pairs.withColumn("league", F.lit("all")))
    per = s.where("seed <> 0").groupBy("event").agg(F.sum("games").alias("n"), F.sum(F.when(c("seed") > 0, c("wins")).otherwise(c("games") - c("wins"))).alias("k")).join(events.select("event", "available"), "event").withColumn("league", F.lit("all"))
    told = T.as_of(per, events.select("event", "cutoff").withColumn("league", F.lit("all")), ["league"], "available", "cutoff", {"n": c("n"), "k": c("k")}).fillna(0)
    sure = F.greatest(F.lit(0.5), (c("k") + 1) / (c("n") + 2))
    return s.join(told.select("event", sure.alias("sure")), "event").select("event", "a", "b", "games", "wins", F.when(c("seed") > 0, c("sure")).when(c("seed") < 0, 1 - c("sure")).otherwise(0.5).alias("p"))


def valid_scores(forecasts, model, candidate="candidate"):
    """Scores by model, candidate and event; an event with a chance that is missing, 0 or 1 gets the neutral forecast and is not valid."""
    c = F.col
    w = Window.partitionBy(candidate, "event")
    fine = F.coalesce((c("p") > 0) & (c("p") < 1), F.lit(False))
    x = forecasts.withColumn("valid", F.min(fine).over(w)).withColumn("p", F.when(c("valid"), c("p")).otherwise(0.5))
    return T.event_scores(x, [candidate, "event", "valid"]).select(F.lit(model).alias("model"), c(candidate).alias("candidate"), "event", "valid", "n", "log_loss", "brier")


def plain_scores(spark, sf):
    """events, and scores of the families that need no fit, for events before which something was known."""
    events, pairs = half_years(spark, sf)
    first = events.agg(F.min("available").alias("first"))
    told = pairs.join(events.join(F.broadcast(first), F.col("cutoff") > F.col("first")).select("event"), "event", "left_semi")
    neutral = told.withColumns({"p": F.lit(0.5), "candidate": F.lit("neutral")})
    seed = seed_forecasts(events, pairs).join(told.select("event").distinct(), "event", "left_semi").withColumn("candidate", F.lit("higher-seed"))
    rate = rate_forecasts(events, pairs).join(told.select("event").distinct(), "event", "left_semi")
    parts = [valid_scores(neutral, "neutral"), valid_scores(seed, "higher-seed"), valid_scores(rate, "rate")]
    return events, materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "scores")


RATE_SQL = """sides AS (SELECT event, player, sum(n) AS n, sum(k) AS k FROM (SELECT event, a AS player, games AS n, wins AS k FROM q UNION ALL SELECT event, b, games, games - wins FROM q) GROUP BY ALL),
options(candidate, half_life, prior, distance) AS (VALUES """ + ", ".join(f"('{n}', {h}::DOUBLE, {k}::DOUBLE, {d})" for n, h, k, d in RATES) + """),
told AS (SELECT e.event, candidate, player, sum(s.k * 0.5 ** ((e.cutoff - i.available) / half_life)) AS won, sum(s.n * 0.5 ** ((e.cutoff - i.available) / half_life)) AS played FROM e JOIN e i ON i.available < e.cutoff JOIN sides s ON s.event = i.event CROSS JOIN options GROUP BY ALL),
rates AS (SELECT q.event, options.candidate, a, b, games, wins, (coalesce(x.won, 0) + prior) / nullif(coalesce(x.played, 0) + 2 * prior, 0) AS ra, (coalesce(y.won, 0) + prior) / nullif(coalesce(y.played, 0) + 2 * prior, 0) AS rb FROM q CROSS JOIN options LEFT JOIN told x ON x.event = q.event AND x.candidate = options.candidate AND x.player = a LEFT JOIN told y ON y.event = q.event AND y.candidate = options.candidate AND y.player = b),
seeds AS (SELECT event + 1 AS event, player, row_number() OVER (PARTITION BY event ORDER BY k DESC, player) AS seed FROM sides),
s AS (SELECT q.*, x.seed AS sa, z.seed AS sb FROM q LEFT JOIN seeds x ON x.event = q.event AND x.player = a LEFT JOIN seeds z ON z.event = q.event AND z.player = b),
sure AS (SELECT e.event, greatest(0.5, (coalesce(sum(CASE WHEN sa < sb THEN wins ELSE games - wins END), 0) + 1) / (coalesce(sum(games), 0) + 2)) AS sure FROM e LEFT JOIN (SELECT s.*, available FROM s JOIN e USING (event) WHERE sa IS NOT NULL AND sb IS NOT NULL) s ON s.available < e.cutoff GROUP BY e.event),
forecasts AS (SELECT 'neutral' AS model, 'neutral' AS candidate, event, a, b, games, wins, 0.5::DOUBLE AS p FROM q UNION ALL SELECT 'higher-seed', 'higher-seed', s.event, a, b, games, wins, CASE WHEN sa < sb THEN sure WHEN sb < sa THEN 1 - sure ELSE 0.5 END FROM s JOIN sure USING (event)
  UNION ALL SELECT 'rate', candidate, event, a, b, games, wins, CASE WHEN ra * (1 - rb) + rb * (1 - ra) > 0 THEN ra * (1 - rb) / (ra * (1 - rb) + rb * (1 - ra)) END FROM rates)"""

SCORES_SQL = f"""{RATE_SQL}, judged AS (SELECT *, min(coalesce(p > 0 AND p < 1, false)) OVER (PARTITION BY candidate, event) AS valid FROM forecasts WHERE event IN (SELECT e.event FROM e JOIN e i ON i.available < e.cutoff)),
scored AS (SELECT model, candidate, event, valid, CAST(sum(games) AS BIGINT) AS n, sum(-wins * ln(u) - (games - wins) * ln(1 - u)) AS ll, sum(wins * (1 - u) ** 2 + (games - wins) * u ** 2) AS bs FROM (SELECT *, CASE WHEN valid THEN p ELSE 0.5 END AS u FROM judged) GROUP BY ALL)"""

CHOICE_SQL = f"""{SCORES_SQL}, menu AS (SELECT candidate, distance FROM options UNION ALL VALUES ('neutral', 0), ('higher-seed', 0)),
past AS (SELECT o.event AS fold, s.model, s.candidate, s.event, s.valid, s.ll / s.n AS ll, s.bs / s.n AS bs FROM scored s JOIN e i ON i.event = s.event JOIN e o ON i.available < o.cutoff WHERE o.event IN (SELECT event FROM scored)),
means AS (SELECT fold, model, candidate, min(valid) AS ok, avg(ll) AS ml, avg(bs) AS mb FROM past GROUP BY ALL),
best AS (SELECT fold, model, candidate AS best FROM means WHERE ok QUALIFY row_number() OVER (PARTITION BY fold, model ORDER BY ml, mb, candidate) = 1),
gap AS (SELECT x.fold, x.model, x.candidate, avg(x.ll - y.ll) AS m, coalesce(stddev_samp(x.ll - y.ll) / sqrt(count(*)), 'inf'::DOUBLE) AS se FROM past x JOIN best USING (fold, model) JOIN past y ON y.fold = x.fold AND y.model = x.model AND y.event = x.event AND y.candidate = best GROUP BY ALL),
near AS (SELECT gap.fold, gap.model, gap.candidate AS near FROM gap JOIN means USING (fold, model, candidate) JOIN menu USING (candidate) WHERE ok AND m <= se + 2.220446049250313e-16 QUALIFY row_number() OVER (PARTITION BY gap.fold, gap.model ORDER BY distance, mb, gap.candidate) = 1),
folds AS (SELECT s.model, s.event, count(DISTINCT s.candidate) AS choices, any_value(s.candidate) FILTER (distance = 0) AS standard, (SELECT count(DISTINCT p.event) FROM past p WHERE p.fold = s.event AND p.model = s.model) AS inner_events FROM scored s JOIN menu USING (candidate) GROUP BY ALL),
picked AS (SELECT f.*, CASE WHEN choices = 1 THEN 'fixed' WHEN inner_events < {LEAST_INNER} THEN 'warmup-default' WHEN near IS NULL THEN 'inner-unavailable-default' ELSE 'inner-selected' END AS mode, near FROM folds f LEFT JOIN near ON near.fold = f.event AND near.model = f.model),
outers AS (SELECT p.model, p.event, mode, CASE WHEN mode = 'inner-selected' THEN near ELSE standard END AS chosen, inner_events, standard FROM picked p),
tuned AS (SELECT o.model, o.event, mode, chosen, inner_events, x.valid, x.n, x.ll AS log_loss, x.bs AS brier, x.ll / x.n - y.ll / x.n AS versus_default, x.bs / x.n - y.bs / x.n AS versus_default_brier FROM outers o JOIN scored x ON x.model = o.model AND x.event = o.event AND x.candidate = chosen JOIN scored y ON y.model = o.model AND y.event = o.event AND y.candidate = standard)"""


def plain_tuning(spark, sf):
    events, scores = plain_scores(spark, sf)
    return T.nested_choice(scores, events, FAMILIES, LEAST_INNER)


@query("m16_nested_tuning", f"WITH {CHOICE_SQL} SELECT model, event, mode, chosen, inner_events, valid, n, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(versus_default, 6) AS versus_default, round(versus_default_brier, 6) AS versus_default_brier FROM tuned", "games", "contests")
def m16(spark, sf):
    """The candidate chosen for every model and half-year, and how it did."""
    return rounded(plain_tuning(spark, sf))


@query("m16_summary", f"WITH {CHOICE_SQL} SELECT model, count(*) AS events, CAST(sum(n) AS BIGINT) AS sets, count(*) FILTER (mode = 'fixed') AS fixed, count(*) FILTER (mode = 'warmup-default') AS warmup, count(*) FILTER (mode = 'inner-unavailable-default') AS unavailable, count(*) FILTER (mode = 'inner-selected') AS chosen, round(avg(log_loss / n), 6) AS macro_log_loss, round(avg(brier / n), 6) AS macro_brier, round(sum(log_loss) / sum(n), 6) AS pooled_log_loss, round(sum(brier) / sum(n), 6) AS pooled_brier, round(avg(versus_default) FILTER (mode = 'inner-selected'), 6) AS versus_default, round(avg(versus_default_brier) FILTER (mode = 'inner-selected'), 6) AS versus_default_brier FROM tuned GROUP BY model", "games", "contests")
def m16_summary(spark, sf):
    return rounded(T.summary(plain_tuning(spark, sf)))


SWAPPED = "ascii(right(sha256(CAST(game AS VARCHAR)), 1)) % 2 = 1"


@query("m14_model_suite", f"""WITH {RATE_SQL}, shown AS (SELECT event, a, b, {SWAPPED} AS swapped, count(*) AS n, CAST(sum(won) AS BIGINT) AS k FROM h GROUP BY ALL),
sided AS (SELECT model, candidate, n, CASE WHEN swapped THEN n - k ELSE k END AS k, CASE WHEN swapped THEN 1 - p ELSE p END AS p FROM forecasts JOIN shown USING (event, a, b) WHERE candidate IN ('neutral', 'higher-seed', 'rate-730-4', 'rate-730-16') AND event IN (SELECT e.event FROM e JOIN e i ON i.available < e.cutoff))
SELECT candidate AS model, CAST(sum(n) AS BIGINT) AS n, round(sum(-k * ln(p) - (n - k) * ln(1 - p)) / sum(n), 6) AS log_loss, round(sum(k * (1 - p) ** 2 + (n - k) * p ** 2) / sum(n), 6) AS brier, round(sum(CASE WHEN p = 0.5 THEN n / 2 WHEN p > 0.5 THEN k ELSE n - k END) / sum(n), 6) AS accuracy, round(sum(n * p) / sum(n), 6) AS mean_p, round(sum(k) / sum(n), 6) AS first_wins FROM sided GROUP BY candidate""", "games", "contests")
def m14_suite(spark, sf):
    """Models on the same sets with the same sides, swapped by a bit of the set's hash; each forecast knows what its event's cutoff knew."""
    c = F.col
    events, pairs = half_years(spark, sf)
    swapped = F.ascii(F.substring(S.key_hash(c("game")), -1, 1)) % 2 == 1
    shown = contests(spark, sf).groupBy("event", "a", "b", swapped.alias("swapped")).agg(F.count("*").alias("games"), F.sum("won").cast("long").alias("wins"))
    neutral = pairs.select(F.lit("neutral").alias("model"), "event", "a", "b", F.lit(0.5).alias("p"))
    seed = seed_forecasts(events, pairs).select(F.lit("higher-seed").alias("model"), "event", "a", "b", "p")
    rate = rate_forecasts(events, pairs).where(c("candidate").isin("rate-730-4", "rate-730-16")).select(c("candidate").alias("model"), "event", "a", "b", "p")
    first = events.agg(F.min("available").alias("first"))
    told = events.join(F.broadcast(first), c("cutoff") > c("first")).select("event")
    x = neutral.unionByName(seed).unionByName(rate).join(told, "event", "left_semi").join(shown, ["event", "a", "b"])
    x = x.withColumns({"p": F.when(c("swapped"), 1 - c("p")).otherwise(c("p")), "wins": F.when(c("swapped"), c("games") - c("wins")).otherwise(c("wins"))})
    right = F.when(c("p") == 0.5, c("games") / 2).when(c("p") > 0.5, c("wins")).otherwise(c("games") - c("wins"))
    n = F.sum("games")
    more = x.groupBy("model").agg((F.sum(right) / n).alias("accuracy"), (F.sum(c("games") * c("p")) / n).alias("mean_p"), (F.sum("wins") / n).alias("first_wins"))
    scores = T.event_scores(x, ["model"]).select("model", "n", (c("log_loss") / c("n")).alias("log_loss"), (c("brier") / c("n")).alias("brier"))
    return rounded(scores.join(more, "model"))


#: model, candidate, distance, options
FITTED = [("elo", "elo-32-730", 0, {"k": 32.0, "half_life": 730.0}), ("elo", "elo-16-730", 1, {"k": 16.0, "half_life": 730.0}), ("elo", "elo-64-365", 2, {"k": 64.0, "half_life": 365.0})]
FITTED += [("regularised", "regularised-2", 0, {"ridge": 2.0}), ("regularised", "regularised-8", 1, {"ridge": 8.0})]


def fitted_scores(spark, sf):
    """Scores of fitted candidates: one fit for each year and candidate, all of them advanced together."""
    c = F.col
    events, pairs = half_years(spark, sf, "year")
    first = events.agg(F.min("available").alias("first"))
    folds = materialize(events.join(F.broadcast(first), c("cutoff") > c("first")).select("event", "cutoff"), "folds")
    own = lambda model, *names: folds.select("event", "cutoff", F.inline(F.array(*(F.struct(F.lit(n).alias("candidate"), *(F.lit(o[x]).alias(x) for x in names)) for m, n, _, o in FITTED if m == model)))).withColumn("fit", F.concat_ws("@", "candidate", c("event").cast("string")))
    dated = pairs.join(events.select("event", c("available").alias("day")), "event")
    elos = own("elo", "k", "half_life").withColumn("scale", F.lit(400.0))
    history = dated.join(elos.select("fit", "cutoff"), c("day") < c("cutoff")).select("fit", "event", "day", "a", "b", "games", "wins")
    rating = R.elo(history, elos.select("fit", "cutoff", "k", "scale", "half_life"))
    asked = R._sided(pairs.join(elos.select("event", "fit", "candidate"), "event"), rating, {"rating": 0.0})
    by_elo = asked.withColumn("p", S.elo_probability(c("a_rating"), c("b_rating"))).select("candidate", "event", "a", "b", "games", "wins", "p")
    sets, past = seeded_form(dated.withColumn("fit", F.lit("all")))
    options = own("regularised", "ridge").select("fit", "candidate", "event", F.lit("all").alias("league"), "cutoff", c("ridge").alias("ability_ridge"), F.lit(2.0).alias("feature_ridge"))
    fitted = materialize(R.regularised(sets, options), "strengths")
    form = R.form_at(past, folds.select(F.lit("all").alias("fit"), "cutoff"))
    asked = sets.select("league", "event", "a", "b", "games", "wins", "seed").join(options.select("event", "fit", "candidate", "cutoff"), "event")
    for side in "ab":
        asked = asked.join(form.select("cutoff", c("player").alias(side), c("form").alias(f"form_{side}")), ["cutoff", side], "left").fillna({f"form_{side}": 0.0})
        asked = asked.withColumn("effect", F.concat(F.lit("player|"), c(side).cast("string"))).join(fitted.select("fit", "effect", c("value").alias(f"v_{side}")), ["fit", "effect"], "left").fillna({f"v_{side}": 0.0}).drop("effect")
    weight = lambda name: fitted.where(c("effect") == f"feature|{name}").select("fit", (c("value") / c("scale")).alias(f"w_{name}"))
    asked = asked.join(weight("seed"), "fit").join(weight("form"), "fit")
    p = S.sigmoid(c("v_a") - c("v_b") + c("w_seed") * c("seed") + c("w_form") * (c("form_a") - c("form_b")))
    fine = fitted.groupBy("fit").agg(F.min("converged").alias("converged"))
    by_fit = asked.join(fine, "fit").withColumn("p", F.when(c("converged"), p)).select("candidate", "event", "a", "b", "games", "wins", "p")
    return events, materialize(valid_scores(by_elo, "elo").unionByName(valid_scores(by_fit, "regularised")), "scores")


@query("m16_fitted_tuning")
def m16_fitted(spark, sf):
    """Ratings and regularised strengths tuned the same way; tests hold the scores against plain fits."""
    events, scores = fitted_scores(spark, sf)
    return rounded(T.nested_choice(scores, events, [(m, n, d) for m, n, d, _ in FITTED], LEAST_FITTED), 5)


BOOT_SEED = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(mode) + 1), lambda i: CAST(ascii(substr(mode, CAST(i AS INTEGER), 1)) AS HUGEINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query("m15_bootstrap", f"""WITH c AS (SELECT mode, strftime(ts, '%Y-%m') AS cluster, sum(CASE WHEN w = 1 THEN -ln(p) ELSE -ln(1 - p) END + ln(0.5)) AS total, count(*) AS n FROM (SELECT *, greatest(0.01, least(0.99, (value % 101) / 101.0)) AS p FROM plays WHERE w IS NOT NULL) GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY cluster) - 1 AS i FROM c), g AS (SELECT mode, count(*) AS clusters, sum(total) / sum(n) AS mean, {BOOT_SEED} AS seed FROM c GROUP BY mode),
t AS (SELECT g.*, r, (seed + (r * clusters + j + 1)::HUGEINT * 1831565813) % 4294967296 AS t FROM g, range(2000) a(r), range(1000) b(j) WHERE j < clusters), v AS (SELECT *, (xor(t, t >> 15) * (t | 1::HUGEINT)) % 4294967296 AS v FROM t), w AS (SELECT *, xor(v, (v + (xor(v, v >> 7) * (v | 61::HUGEINT)) % 4294967296) % 4294967296) AS w FROM v),
u AS (SELECT mode, clusters, mean, r, CAST(floor(CAST(xor(w, w >> 14) AS DOUBLE) / 4294967296.0 * clusters) AS BIGINT) AS i FROM w), m AS (SELECT u.mode, clusters, mean, r, sum(total) / sum(n) AS m FROM u JOIN i ON i.mode = u.mode AND i.i = u.i GROUP BY ALL)
SELECT mode, clusters, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY ALL""", "plays")
def m15(spark, sf):
    """Difference in log loss between two forecasts of the same games with its interval, whole months drawn, for each mode."""
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col("value") % 101) / 101.0))
    x = plays(spark, sf).where("w IS NOT NULL").withColumn("d", S.log_loss(p, F.col("w")) - S.log_loss(F.lit(0.5), F.col("w")))
    clusters = materialize(x.groupBy("mode", F.date_format("ts", "yyyy-MM").alias("cluster")).agg(F.sum("d").alias("total"), F.count("*").alias("n")), "clusters")
    return rounded(T.bootstrap(clusters, ["mode"], "cluster", "total", "n", N.seed_hash(F.col("mode")), 2000))
