"""Teams, usage impact and coaching detectors over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.functions import scalar as S
from matchlake.metrics import record
from matchlake.operators import impact as I  # noqa: E741
from matchlake.operators import sequence as W
from matchlake.operators import teams as T
from matchlake.plans.records import WL
from matchlake.plans.registry import VIEWS, games, moves, plays, query, rounded
from matchlake.plans.sequences import RUNS, SEQ, SESSIONS, SETS, _sessions, _sets
from matchlake.session import load

# Orders as games of two against two: partner, opponents, stocks (null where a replay has none), friendly fire.
VIEWS["duos"] = """duos AS (SELECT o_orderkey AS game, o_custkey % 50 AS player, o_orderdate AS ts, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS w, o_orderkey % 8 AS stage,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'C' || (o_orderkey % 40) END AS mate, o_orderkey % 4 AS port, o_orderkey % 40 = o_custkey % 50 AS self_match, o_custkey % 26 AS mate_char, [o_orderkey % 26, (o_orderkey + o_custkey) % 26] AS opponents,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 5 END AS s1, o_orderkey % 3 AS s2, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 4 END AS s3, o_orderkey % 2 AS s4,
  o_totalprice / 60 AS seconds, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice % 97 END AS to_me, o_totalprice % 89 AS from_me FROM orders)"""


def duos(spark, sf):
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    w = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return load(spark, sf, "orders").select(
        key.alias("game"), (cust % 50).alias("player"), F.col("o_orderdate").alias("ts"), w.alias("w"), (key % 8).alias("stage"),
        F.when(key % 11 != 0, F.concat(F.lit("C"), key % 40)).alias("mate"), (key % 4).alias("port"), (key % 40 == cust % 50).alias("self_match"), (cust % 26).alias("mate_char"), F.array(key % 26, (key + cust) % 26).alias("opponents"),
        F.when(key % 13 != 0, key % 5).alias("s1"), (key % 3).alias("s2"), F.when(cust % 7 != 0, cust % 4).alias("s3"), (key % 2).alias("s4"),
        (price / 60).alias("seconds"), F.when(key % 9 != 0, price % 97).alias("to_me"), (price % 89).alias("from_me"),
    )


@query("f10_team_filter", "SELECT count(*) AS n, min(game) AS first FROM duos WHERE (opponents[1] = 7 OR opponents[2] = 7) AND mate = 'C3'", "duos")
def f10(spark, sf):
    return duos(spark, sf).where(T.team_filter(F.col("opponents"), F.lit(7)) & (F.col("mate") == "C3")).agg(F.count("*").alias("n"), F.min("game").alias("first"))


DUO_RUNS = RUNS.replace("FROM plays", "FROM duos")


@query("a16_team_overview", f"WITH {DUO_RUNS}, k AS (SELECT player, arg_max(kind, last) AS streak_kind, arg_max(length, last) AS streak_length FROM s GROUP BY player), o AS (SELECT player, {WL}, round(sum(CASE WHEN s1 + s2 + s3 + s4 IS NOT NULL THEN 8 - s1 - s2 END) / nullif(count(s1 + s2 + s3 + s4), 0)::DOUBLE, 6) AS taken_per_game, round(sum(CASE WHEN s1 + s2 + s3 + s4 IS NOT NULL THEN 8 - s3 - s4 END) / nullif(count(s1 + s2 + s3 + s4), 0)::DOUBLE, 6) AS lost_per_game, round(avg(seconds), 3) AS mean_seconds, count(DISTINCT coalesce(mate, 'port:' || port)) AS partners FROM duos GROUP BY player) SELECT o.*, streak_kind, streak_length FROM o LEFT JOIN k USING (player)", "duos")
def a16(spark, sf):
    got = T.team_overview(duos(spark, sf), ["player"], SEQ, ["s1", "s2"], ["s3", "s4"], "seconds", "mate", "port")
    return rounded(got.withColumn("mean_seconds", F.round("mean_seconds", 3)))


@query("a17_by_teammate", f"WITH o AS (SELECT * FROM duos WHERE mate IS NOT NULL AND NOT self_match), n AS (SELECT player, mate, mate_char, count(*) AS k, min((ts, game)) AS f FROM o GROUP BY player, mate, mate_char), c AS (SELECT *, row_number() OVER (PARTITION BY player, mate ORDER BY k DESC, f) AS r FROM n), g AS (SELECT player, mate, {WL}, round(sum(8 - s1 - s2) / nullif(count(s1 + s2), 0)::DOUBLE, 6) AS taken_per_game, strftime(max(ts), '%Y-%m-%d') AS last FROM o GROUP BY player, mate) SELECT g.*, mate_char AS top_character FROM g JOIN c USING (player, mate) WHERE c.r = 1", "duos")
def a17(spark, sf):
    return rounded(T.by_teammate(duos(spark, sf), ["player"], SEQ, "mate", "self_match", "mate_char", ["s1", "s2"]).withColumn("last", F.date_format("last", "yyyy-MM-dd")))


@query("a19_team_stage", f"SELECT stage, {WL} FROM duos GROUP BY stage", "duos")
def a19(spark, sf):
    return rounded(duos(spark, sf).groupBy("stage").agg(*record()))


@query("a21_teammate_damage", "SELECT player, mate, count(*) AS games, round(avg(to_me), 6) AS to_me, round(avg(from_me), 6) AS from_me FROM duos WHERE mate IS NOT NULL AND NOT self_match AND to_me IS NOT NULL GROUP BY player, mate", "duos")
def a21(spark, sf):
    return rounded(T.friendly_fire(duos(spark, sf), ["player"], "mate", "self_match", "to_me", "from_me"))


@query("a23_team_execution", "WITH x AS (SELECT unnest(['me', 'mate']) AS who, unnest([s3, s4]) AS hit, unnest([s1, s2]) AS miss, unnest([to_me, from_me]) AS ipm FROM duos) SELECT who, count(*) AS games, round(sum(hit) FILTER (hit + miss IS NOT NULL) / nullif(sum(hit + miss), 0)::DOUBLE, 6) AS rate, round(avg(ipm), 6) AS ipm FROM x GROUP BY who", "duos")
def a23(spark, sf):
    """Both sides of a team as rows of their own: pooled rate and mean of what is known."""
    side = lambda who, hit, miss, ipm: F.struct(F.lit(who).alias("who"), F.col(hit).alias("hit"), F.col(miss).alias("miss"), F.col(ipm).alias("ipm"))
    x = duos(spark, sf).select(F.inline(F.array(side("me", "s3", "s1", "to_me"), side("mate", "s4", "s2", "from_me"))))
    both = F.col("hit") + F.col("miss")
    return rounded(x.groupBy("who").agg(F.count("*").alias("games"), S.ratio(F.sum(F.when(both.isNotNull(), F.col("hit"))), F.sum(both)).alias("rate"), F.avg("ipm").alias("ipm")))


@query("w14_team_records", f"WITH {DUO_RUNS}, b AS (SELECT player, max(length) AS best_streak FROM s WHERE kind = 1 GROUP BY player), f AS (SELECT player, mate, count(*) AS n, avg(to_me) AS x, avg(from_me) AS y FROM duos WHERE mate IS NOT NULL AND NOT self_match AND to_me IS NOT NULL GROUP BY player, mate HAVING count(*) >= 5), m AS (SELECT player, arg_min(mate, (-x, mate)) AS grudge, round(max(x), 6) AS grudge_fire, arg_min(mate, (-y, mate)) AS target, round(max(y), 6) AS target_fire FROM f GROUP BY player) SELECT player, best_streak, grudge, grudge_fire, target, target_fire FROM (SELECT DISTINCT player FROM duos) LEFT JOIN b USING (player) LEFT JOIN m USING (player)", "duos")
def w14(spark, sf):
    return rounded(T.team_records(duos(spark, sf), ["player"], SEQ, "mate", "self_match", "to_me", "from_me"))


SPLIT = "count(*) AS n, round(avg(w) FILTER (rn <= c // 2), 6) AS low, round(avg(w) FILTER (rn > c - c // 2), 6) AS high, round(avg(w) FILTER (rn > c - c // 2) - avg(w) FILTER (rn <= c // 2), 6) AS delta"


@query("w16_move_impact", f"WITH m AS (SELECT segment, g.game, any_value(g.ts) AS ts, any_value(w) AS w, kind, sum(landed) AS l FROM moves JOIN games g USING (game) WHERE w IS NOT NULL GROUP BY segment, g.game, kind), t AS (SELECT segment, game, any_value(ts) AS ts, any_value(w) AS w, sum(l) AS t FROM m GROUP BY ALL HAVING sum(l) > 0), d AS (SELECT t.*, k.kind, coalesce(l, 0) / t AS share FROM t JOIN (SELECT DISTINCT segment, kind FROM m) k USING (segment) LEFT JOIN m ON m.segment = t.segment AND m.game = t.game AND m.kind = k.kind), x AS (SELECT *, row_number() OVER (PARTITION BY segment, kind ORDER BY share, ts, game) AS rn, count(*) OVER (PARTITION BY segment, kind) AS c FROM d) SELECT segment, kind, {SPLIT}, round(avg(share), 6) AS mean_use FROM x GROUP BY segment, kind HAVING count(*) >= 40", "games", "moves")
def w16(spark, sf):
    g = games(spark, sf).where("w IS NOT NULL").select("game", "segment", "ts", "w")
    shares = I.dense_shares(moves(spark, sf).select("game", "kind", "landed").join(g.select("game", "segment"), "game"), ["segment"], "game", "kind", "landed")
    return rounded(I.impact(shares.join(g.select("game", "ts", "w"), "game"), ["segment"], ["kind"], "share", SEQ))


@query("w17_action_impact", f"WITH a AS (SELECT player, game, ts, w, unnest(['rolls', 'dodges', 'grabs']) AS action, unnest([value % 7, value % 11, value % 5]) / ((value + 1) / 60) AS share FROM plays WHERE w IS NOT NULL AND value > 0), x AS (SELECT *, row_number() OVER (PARTITION BY player, action ORDER BY share, ts, game) AS rn, count(*) OVER (PARTITION BY player, action) AS c FROM a) SELECT player, action, {SPLIT}, round(avg(share), 6) AS mean_use FROM x GROUP BY player, action HAVING count(*) >= 20", "plays")
def w17(spark, sf):
    """Actions per minute, heavy against light use."""
    v = F.col("value")
    acts = F.map_from_arrays(F.array(*map(F.lit, ("rolls", "dodges", "grabs"))), F.array(v % 7, v % 11, v % 5))
    a = plays(spark, sf).where("w IS NOT NULL AND value > 0").select("player", "game", "ts", "w", "value", F.explode(acts).alias("action", "n"))
    return rounded(I.impact(a.withColumn("share", F.col("n") / ((v + 1) / 60)), ["player"], ["action"], "share", SEQ, 20))


@query("w21_storylines", "WITH c AS (SELECT year(ts) AS year, player, count(*) AS n, max(amount) AS best FROM games GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY best DESC, player) AS rank FROM c), l AS (SELECT max(year) AS latest, min(year) AS first FROM c) SELECT player, CAST(min(year) AS INTEGER) AS arrival, min(year) > any_value(l.first) AS newcomer, CAST(arg_max(year, (n, -year)) AS INTEGER) AS peak_year, max(n) AS peak, CAST(arg_min(year, (rank, year)) AS INTEGER) AS best_year, min(rank) AS best_rank, coalesce(max(n) FILTER (year = latest), 0) AS current FROM r, l GROUP BY player", "games")
def w21(spark, sf):
    """Arrival, first peak, first best rank and the latest edition of each player's presence."""
    c = games(spark, sf).groupBy(F.year("ts").alias("year"), "player").agg(F.count("*").alias("n"), F.max("amount").alias("best"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("best"), "player")).cast("long"))
    return W.storylines(ranked, "player", "year", "n", "rank")


@query("l02_l04_model_fit", "WITH x AS (SELECT player, w AS y, greatest(1e-15, least(1 - 1e-15, (value % 101) / 101.0)) AS p FROM plays WHERE w IS NOT NULL), g AS (SELECT player, count(*) AS n, CAST(sum(y) AS BIGINT) AS wins, sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM x GROUP BY player) SELECT player, n, wins, round(1 - ll / (wins * ln(wins / n) + (n - wins) * ln(1 - wins / n)), 6) AS r2 FROM g WHERE n >= 20 AND wins >= 5 AND n - wins >= 5", "plays")
def l02(spark, sf):
    x = plays(spark, sf).where("w IS NOT NULL").withColumn("p", (F.col("value") % 101) / 101.0)
    return rounded(I.model_fit(x, ["player"], "p", "w", 20, 5))


@query("l04_odds", "SELECT p_partkey, round(exp((p_size - 25) / 10.0), 6) AS odds, round((p_size - 25) / 10.0 / 4 * 100, 6) AS points FROM part")
def l04(spark, sf):
    c = (F.col("p_size") - 25) / 10.0
    return rounded(load(spark, sf, "part").select("p_partkey", S.odds(c).alias("odds"), S.probability_points(c).alias("points")))


BASE = "k AS (SELECT * FROM games WHERE w IS NOT NULL), b AS (SELECT mode, avg(w) AS base FROM k GROUP BY mode HAVING count(*) >= 40 AND avg(w) > 0 AND avg(w) < 1)"


def _detected(by: str, least: int, gate: float, sign: str = "") -> str:
    return f"WITH {BASE}, r AS (SELECT mode, {by}, count(*) AS decided, avg(w) AS rate FROM k GROUP BY mode, {by}), z AS (SELECT r.*, base, (rate - base) / sqrt(base * (1 - base) / decided) AS z FROM r JOIN b USING (mode)) SELECT mode, {by}, decided, round(rate, 6) AS rate, round(base, 6) AS base, round(z, 6) AS z, round(abs(rate - base) * sqrt(decided), 6) AS score FROM z WHERE decided >= {least} AND {sign}z <= -{gate} QUALIFY row_number() OVER (PARTITION BY mode ORDER BY {sign}z, {by}) = 1"


@query("l06_worst_matchup", _detected("nation", 20, 1.0), "games")
def l06_matchup(spark, sf):
    return rounded(I.detect(games(spark, sf), ["mode"], ["nation"], 20, 1.0))


@query("l06_stage_ban", _detected("segment", 30, 0.25), "games")
def l06_ban(spark, sf):
    return rounded(I.detect(games(spark, sf), ["mode"], ["segment"], 30, 0.25))


@query("l06_stage_pick", _detected("segment", 30, 0.25, "-"), "games")
def l06_pick(spark, sf):
    return rounded(I.detect(games(spark, sf), ["mode"], ["segment"], 30, 0.25, worst=False))


@query("l06_rival", _detected("player", 5, 1.5), "games")
def l06_rival(spark, sf):
    return rounded(I.detect(games(spark, sf), ["mode"], ["player"], 5, 1.5))


@query("l06_mode", _detected("segment", 30, 0.25).replace("mode", "nation").replace("segment", "mode"), "games")
def l06_mode(spark, sf):
    return rounded(I.detect(games(spark, sf), ["nation"], ["mode"], 30, 0.25))


@query("l06_my_character", "WITH k AS (SELECT * FROM games WHERE w IS NOT NULL), b AS (SELECT segment, avg(w) AS base FROM k GROUP BY segment HAVING count(*) >= 40), r AS (SELECT segment, nation, count(*) AS decided, avg(w) AS rate FROM k GROUP BY ALL HAVING count(*) >= 30), z AS (SELECT r.*, base, (rate - base) / sqrt(base * (1 - base) / decided) AS z, count(*) OVER (PARTITION BY segment) AS choices FROM r JOIN b USING (segment)) SELECT segment, nation, decided, round(rate, 6) AS rate, round(base, 6) AS base, round(z, 6) AS z, round(abs(rate - base) * sqrt(decided), 6) AS score FROM z WHERE z <= -0.5 AND choices > 1 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY z, nation) = 1", "games")
def l06_character(spark, sf):
    return rounded(I.worst_character(games(spark, sf), ["segment"], "nation", gate=0.5))


HABIT = f"""WITH m AS (SELECT segment, g.game, any_value(g.ts) AS ts, any_value(w) AS w, kind, sum(landed) AS l FROM moves JOIN games g USING (game) WHERE w IS NOT NULL GROUP BY segment, g.game, kind), t AS (SELECT segment, game, any_value(ts) AS ts, any_value(w) AS w, sum(l) AS t FROM m GROUP BY ALL HAVING sum(l) > 0), d AS (SELECT t.*, k.kind, coalesce(l, 0) / t AS share FROM t JOIN (SELECT DISTINCT segment, kind FROM m) k USING (segment) LEFT JOIN m ON m.segment = t.segment AND m.game = t.game AND m.kind = k.kind), x AS (SELECT *, row_number() OVER (PARTITION BY segment, kind ORDER BY share, ts, game) AS rn, count(*) OVER (PARTITION BY segment, kind) AS c FROM d), s AS (SELECT segment, kind, count(*) AS n, avg(w) FILTER (rn <= c // 2) AS low, avg(w) FILTER (rn > c - c // 2) AS high, avg(share) AS mean_use FROM x GROUP BY segment, kind HAVING count(*) >= 40),
a AS (SELECT segment, kind, sum(landed) / sum(sum(landed)) OVER (PARTITION BY segment) AS archive_share, any_value(games) AS games FROM moves JOIN (SELECT game, segment, count(*) OVER (PARTITION BY segment) AS games FROM games) g USING (game) GROUP BY segment, kind),
z AS (SELECT s.*, archive_share, games, high - low AS delta, (high - low) / sqrt((high + low) / 2 * (1 - (high + low) / 2) * 2 / (n // 2)) AS z FROM s JOIN a USING (segment, kind))
SELECT segment, kind, n, round(low, 6) AS low, round(high, 6) AS high, round(delta, 6) AS delta, round(mean_use, 6) AS mean_use, round(archive_share, 6) AS archive_share, games, round(z, 6) AS z, round(abs(delta) * 0.5 * sqrt(2 * (n // 2)), 6) AS score
FROM z WHERE games >= 100 AND mean_use - archive_share >= greatest(-0.01, -0.05 * archive_share) AND mean_use >= 0.001 AND 2 * (n // 2) >= 60 AND z <= -0.2 AND delta <= -0.001 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY z, kind) = 1"""


@query("l06_move_habit", HABIT, "games", "moves")
def l06_habit(spark, sf):
    """The move each segment overuses against all its games' share of it, where heavy use goes with losses (the gates are wide: these moves are all alike)."""
    every = games(spark, sf).select("game", "segment", "ts", "w")
    own = every.where("w IS NOT NULL")
    landed = moves(spark, sf).select("game", "kind", "landed")
    shares = I.dense_shares(landed.join(own.select("game", "segment"), "game"), ["segment"], "game", "kind", "landed")
    rows = I.impact(shares.join(own.select("game", "ts", "w"), "game"), ["segment"], ["kind"], "share", SEQ)
    sums = landed.join(every.select("game", "segment"), "game").groupBy("segment", "kind").agg(F.sum("landed").alias("l"))
    counts = every.groupBy("segment").agg(F.count("*").alias("games"))
    archive = sums.join(sums.groupBy("segment").agg(F.sum("l").alias("t")), "segment").join(counts, "segment").select("segment", "kind", (F.col("l") / F.col("t")).alias("archive_share"), "games")
    return rounded(I.move_habit(rows, ["segment"], "kind", archive, share=0.001, delta=-0.001, gate=0.2, over=(-0.01, -0.05)))


@query("l06_hours", "WITH k AS (SELECT *, hour(ts) // 6 AS part FROM plays WHERE w IS NOT NULL), b AS (SELECT player % 5 AS grp, avg(w) AS base FROM k GROUP BY 1 HAVING count(*) >= 40), r AS (SELECT player % 5 AS grp, part, count(*) AS decided, avg(w) AS rate FROM k GROUP BY 1, 2) SELECT r.grp, CAST(part AS INTEGER) AS part, decided, round(rate, 6) AS rate, round(base, 6) AS base, round((rate - base) / sqrt(base * (1 - base) / decided), 6) AS z FROM r JOIN b USING (grp) WHERE decided >= 30", "plays")
def l06_hours(spark, sf):
    k = plays(spark, sf).withColumn("grp", F.col("player") % 5).withColumn("part", S.hour_bucket(F.col("ts")))
    return rounded(I.decided_rates(k, ["grp"], ["part"]).where("decided >= 30"))


@query("l06_stage_tip", f"WITH {BASE}, r AS (SELECT mode, nation, count(*) AS decided, avg(w) AS rate FROM k GROUP BY mode, nation), z AS (SELECT r.*, (rate - base) / sqrt(base * (1 - base) / decided) AS z FROM r JOIN b USING (mode)), m AS (SELECT mode, nation, rate AS mu FROM z WHERE decided >= 20 AND z <= -2 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY z, nation) = 1), s AS (SELECT mode, nation, mu, segment, count(*) AS n, avg(w) AS rate FROM k JOIN m USING (mode, nation) GROUP BY ALL) SELECT mode, nation, round(mu, 6) AS matchup_rate, arg_max(segment, (rate, segment)) FILTER (n >= 8 AND rate >= mu + 0.12) AS tip FROM s GROUP BY mode, nation, mu", "games")
def l06_tip(spark, sf):
    return rounded(I.stage_tip(games(spark, sf), ["mode"], "nation", "segment"))


@query("l06_matchup_stage", f"WITH {BASE}, c AS (SELECT nation, mode, segment, count(*) AS decided, avg(w) AS rate FROM k GROUP BY ALL), a AS (SELECT mode, nation, avg(w) AS matchup_rate FROM k GROUP BY ALL), z AS (SELECT c.*, base, matchup_rate, (rate - base) / sqrt(base * (1 - base) / decided) AS z FROM c JOIN b USING (mode) JOIN a USING (mode, nation)) SELECT mode, nation, segment, decided, round(rate, 6) AS rate, round(base, 6) AS base, round(z, 6) AS z, round(matchup_rate, 6) AS matchup_rate FROM z WHERE decided >= 15 AND rate <= matchup_rate - 0.12 AND z <= -2.5 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY z, nation, segment) = 1", "games")
def l06_cell(spark, sf):
    return rounded(I.matchup_stage(games(spark, sf), ["mode"], "nation", "segment"))


TILT = f"{SESSIONS}, d AS (SELECT player % 5 AS grp, w, player, session, lag(w, 1) OVER p AS a, lag(w, 2) OVER p AS b FROM z WHERE w IS NOT NULL WINDOW p AS (PARTITION BY player, session ORDER BY ts, game))"


@query("l06_tilt_and_cold_start", f"WITH {TILT}, t AS (SELECT grp, avg(w) AS base FROM d GROUP BY grp HAVING count(*) >= 40) SELECT d.grp, count(*) FILTER (a = 0 AND b = 0) AS after_losses, round(avg(w) FILTER (a = 0 AND b = 0), 6) AS tilt_rate, count(*) FILTER (a IS NULL) AS openers, round(avg(w) FILTER (a IS NULL), 6) AS opener_rate, round(any_value(base), 6) AS base FROM d JOIN t USING (grp) GROUP BY d.grp", "plays")
def l06_tilt(spark, sf):
    """Results after two losses or more in a session, and of its first game, against the base rate."""
    x = W.tilt(_sessions(spark, sf), ["player", "session"], SEQ).withColumn("grp", F.col("player") % 5)
    down, first = F.col("entering").isin("2L", "3+L"), F.col("entering") == "opener"
    got = x.groupBy("grp").agg(F.count("*").alias("_n"), F.count(F.when(down, 1)).alias("after_losses"), F.avg(F.when(down, F.col("w"))).alias("tilt_rate"), F.count(F.when(first, 1)).alias("openers"), F.avg(F.when(first, F.col("w"))).alias("opener_rate"), F.avg("w").alias("base"))
    return rounded(got.where("_n >= 40").drop("_n"))


@query("l06_fatigue", f"WITH {SESSIONS}, q AS (SELECT player % 5 AS grp, w, row_number() OVER (PARTITION BY player, session ORDER BY ts, game) AS pos FROM z) SELECT grp, count(w) FILTER (pos > 3) AS late, round(avg(w) FILTER (pos > 3), 6) AS late_rate, round((avg(w) FILTER (pos > 3) - avg(w)) / sqrt(avg(w) * (1 - avg(w)) / count(w) FILTER (pos > 3)), 6) AS z FROM q GROUP BY grp", "plays")
def l06_fatigue(spark, sf):
    pos = F.row_number().over(Window.partitionBy("player", "session").orderBy(*SEQ))
    x = _sessions(spark, sf).withColumn("pos", pos).withColumn("grp", F.col("player") % 5)
    late = F.when(F.col("pos") > 3, F.col("w"))
    got = x.groupBy("grp").agg(F.count(late).alias("late"), F.avg(late).alias("late_rate"), F.avg("w").alias("base"))
    return rounded(got.withColumn("z", I.z_against(F.col("late_rate"), F.col("base"), F.col("late"))).drop("base"))


@query("l06_deciders", f"{SETS} SELECT count(*) AS deciders, round(avg(CASE WHEN wins = 2 THEN 1.0 ELSE 0.0 END), 6) AS rate, round((avg(CASE WHEN wins = 2 THEN 1.0 ELSE 0.0 END) - 0.5) / sqrt(0.25 / count(*)), 6) AS z FROM s WHERE abs(wins - losses) = 1")
def l06_deciders(spark, sf):
    """Sets that went the distance, against one half rather than the base rate."""
    won = _sets(spark, sf).where("abs(wins - losses) = 1").agg(F.count("*").alias("deciders"), F.avg((F.col("wins") == 2).cast("double")).alias("rate"))
    return rounded(won.withColumn("z", I.z_against(F.col("rate"), F.lit(0.5), F.col("deciders"))))


@query("l06_execution_drift", "WITH x AS (SELECT player, value % 100 AS hit, row_number() OVER (PARTITION BY player ORDER BY ts DESC, game DESC) AS back, count(*) OVER (PARTITION BY player) AS n FROM plays) SELECT player, round(avg(hit), 6) AS career, round(avg(hit) FILTER (back <= 20), 6) AS recent FROM x WHERE n >= 60 GROUP BY player HAVING avg(hit) FILTER (back <= 20) <= avg(hit) - 2", "plays")
def l06_drift(spark, sf):
    """The last games against the career, where they fall behind by two points or more."""
    back = F.row_number().over(Window.partitionBy("player").orderBy(*(F.desc(c) for c in SEQ)))
    x = plays(spark, sf).withColumn("hit", F.col("value") % 100).withColumn("back", back)
    got = x.groupBy("player").agg(F.count("*").alias("n"), F.avg("hit").alias("career"), F.avg(F.when(F.col("back") <= 20, F.col("hit"))).alias("recent"))
    return rounded(got.where("n >= 60 AND recent <= career - 2").drop("n"))
