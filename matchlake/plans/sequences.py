"""Windows, sequences, deduplication, scalar functions, machines, models and streams over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.functions import scalar as S
from matchlake.metrics import RatioMetric, trailing
from matchlake.operators import dedupe as D
from matchlake.operators import forecast as M
from matchlake.operators import machines as K
from matchlake.operators import sequence as W
from matchlake.operators import stats as L
from matchlake.plans.registry import VIEWS, games, plays, query, rounded
from matchlake.scratch import scratch_dir
from matchlake.session import load
from matchlake.sources.tables import content_digest, smallest_per_pair
from matchlake.streaming import incremental as I  # noqa: E741

SEQ = ["ts", "game"]


@query("w01_rolling_winrate", "SELECT game, rn, round(win_rate, 6) AS win_rate FROM (SELECT game, row_number() OVER (PARTITION BY player ORDER BY ts, game) AS rn, avg(w) OVER (PARTITION BY player ORDER BY ts, game ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 100 AS win_rate FROM plays WHERE w IS NOT NULL) WHERE rn >= 10", "plays")
def w01(spark, sf):
    return rounded(W.rolling_win_rate(plays(spark, sf), ["player"], SEQ, 20).select("game", F.col("rn").cast("long").alias("rn"), "win_rate"))


RUNS = "r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, game) - row_number() OVER (PARTITION BY player, w ORDER BY ts, game) AS k FROM plays WHERE w IS NOT NULL), s AS (SELECT player, w AS kind, count(*) AS length, max((ts, game)) AS last FROM r GROUP BY player, w, k)"


@query("w02_current_streak", f"WITH {RUNS} SELECT player, arg_max(kind, last) AS kind, arg_max(length, last) AS length FROM s GROUP BY player", "plays")
def w02(spark, sf):
    return W.current_streak(plays(spark, sf), ["player"], SEQ)


@query("w03_rolling_ratio", "WITH x AS (SELECT game, player, ts, CASE WHEN w IS NOT NULL THEN value END AS num, CASE WHEN w IS NOT NULL THEN w + 1 END AS den FROM plays) SELECT game, round(sum(num) OVER p / nullif(sum(den) OVER p, 0) * 100, 6) AS share FROM x WINDOW p AS (PARTITION BY player ORDER BY ts, game ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)", "plays")
def w03(spark, sf):
    known = F.col("w").isNotNull()
    m = RatioMetric("share", F.when(known, F.col("value")), F.when(known, F.col("w") + 1), 100.0)
    return rounded(plays(spark, sf).select("game", m.rolling(trailing(["player"], SEQ, 15))))


@query("w04_thinned_trend", "WITH x AS (SELECT game, player, row_number() OVER (PARTITION BY player ORDER BY ts, game) AS rn, count(*) OVER (PARTITION BY player) AS n FROM plays) SELECT game FROM x WHERE (n - rn) % CAST(ceil(n / 25.0) AS BIGINT) = 0", "plays")
def w04(spark, sf):
    return W.thin(plays(spark, sf), ["player"], SEQ, 25).select("game")


@query("w05_rolling_mean_nulls", "SELECT game, round(avg(CASE WHEN w IS NOT NULL THEN value END) OVER (PARTITION BY player ORDER BY ts, game ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM plays", "plays")
def w05(spark, sf):
    return rounded(plays(spark, sf).select("game", F.avg(F.when(F.col("w").isNotNull(), F.col("value"))).over(trailing(["player"], SEQ, 10)).alias("mean")))


def bounded(df, most):
    """All rows on the driver; fails beyond the bound rather than leave some out."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"over {most} rows in a dimension that must be small")
    return rows


@query("w06_dense_rolling", "WITH g AS (SELECT DISTINCT player, CAST(ts AS DATE) AS day FROM plays), k AS (SELECT DISTINCT mode FROM plays), c AS (SELECT player, CAST(ts AS DATE) AS day, mode, count(*) AS n FROM plays GROUP BY ALL), d AS (SELECT player, day, mode, coalesce(n, 0) AS n FROM g CROSS JOIN k LEFT JOIN c USING (player, day, mode)) SELECT player, strftime(day, '%Y-%m-%d') AS day, mode, CAST(sum(n) OVER (PARTITION BY player, mode ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM d", "plays")
def w06(spark, sf):
    p = plays(spark, sf).withColumn("day", F.to_date("ts"))
    modes = bounded(p.select("mode").distinct(), 1000)["mode"].tolist()
    counts = p.groupBy("player", "day").pivot("mode", modes).agg(F.count("game"))
    dense = counts.select("player", "day", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.coalesce(F.col(m), F.lit(0)).alias("n")) for m in modes))).alias("m")).select("player", "day", "m.*")
    return dense.select("player", F.date_format("day", "yyyy-MM-dd").alias("day"), "mode", F.sum("n").over(trailing(["player", "mode"], ["day"], 5)).alias("recent"))


def _sessions(spark, sf):
    return W.sessions(plays(spark, sf), ["player"], "ts", F.expr("ts + make_dt_interval(0, 0, 0, value / 60)"), "6 HOURS", SEQ)


SESSIONS = "l AS (SELECT *, ts + to_microseconds(CAST(floor(value / 60 * 1000000) AS BIGINT)) AS fin FROM plays), o AS (SELECT *, CASE WHEN ts <= lag(fin) OVER (PARTITION BY player ORDER BY ts, game) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM l), z AS (SELECT *, sum(n) OVER (PARTITION BY player ORDER BY ts, game) AS session FROM o)"


@query("w07_sessions", f"WITH {SESSIONS} SELECT player, CAST(session AS BIGINT) AS session, count(*) AS games, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (w = 1) AS wins FROM z GROUP BY player, session", "plays")
def w07(spark, sf):
    return _sessions(spark, sf).groupBy("player", "session").agg(F.count("*").alias("games"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("start"), F.count(F.when(F.col("w") == 1, 1)).alias("wins"))


@query("w08_session_position", f"WITH {SESSIONS}, q AS (SELECT w, row_number() OVER (PARTITION BY player, session ORDER BY ts, game) AS pos FROM z), b(bucket, i) AS (VALUES ('1-5', 0), ('6-10', 1), ('11-15', 2), ('16-20', 3), ('21+', 4)) SELECT bucket, count(q.pos) AS games, count(w) AS decided, round(avg(w), 6) AS win_rate FROM b LEFT JOIN q ON least(4, (pos - 1) // 5) = i GROUP BY bucket", "plays")
def w08(spark, sf):
    pos = F.row_number().over(Window.partitionBy("player", "session").orderBy(*SEQ))
    got = _sessions(spark, sf).withColumn("bucket", W.position_bucket(pos)).groupBy("bucket").agg(F.count("*").alias("games"), F.count("w").alias("decided"), F.avg("w").alias("win_rate"))
    every = spark.createDataFrame([(b,) for b in W.POSITIONS], "bucket string")
    return rounded(every.join(got, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("games", "decided")), "win_rate"))


@query("w09_tilt", f"WITH {SESSIONS}, d AS (SELECT player, session, w, ts, game, lag(w, 1) OVER p AS a, lag(w, 2) OVER p AS b, lag(w, 3) OVER p AS c FROM z WHERE w IS NOT NULL WINDOW p AS (PARTITION BY player, session ORDER BY ts, game)) SELECT CASE WHEN a IS NULL THEN 'opener' WHEN a = 1 AND coalesce(b, 0) = 1 THEN '2+W' WHEN a = 1 THEN 'W' WHEN coalesce(b, 1) = 1 THEN 'L' WHEN coalesce(c, 1) = 1 THEN '2L' ELSE '3+L' END AS entering, count(*) AS n, round(avg(w), 6) AS win_rate FROM d GROUP BY 1", "plays")
def w09(spark, sf):
    return rounded(W.tilt(_sessions(spark, sf), ["player", "session"], SEQ).groupBy("entering").agg(F.count("*").alias("n"), F.avg("w").alias("win_rate")))


@query("w10_sequence_groups", "WITH x AS (SELECT *, CASE WHEN lag(mode) OVER p = mode AND ts <= lag(ts) OVER p + INTERVAL 3 DAY THEN 0 ELSE 1 END AS b FROM plays WINDOW p AS (PARTITION BY player ORDER BY ts, game)), y AS (SELECT *, sum(b) OVER (PARTITION BY player ORDER BY ts, game) AS run FROM x), c AS (SELECT player, run, count(*) AS size FROM y GROUP BY ALL HAVING count(*) BETWEEN 2 AND 10) SELECT size, count(*) AS n FROM c GROUP BY size", "plays")
def w10(spark, sf):
    runs = W.sequence_groups(plays(spark, sf), ["player"], SEQ, "ts", "mode", "3 DAYS")
    return runs.groupBy("player", "run", "size").agg(F.count("*").alias("_n")).groupBy("size").agg(F.count("*").alias("n"))


# Consecutive games against an opponent (none for every seventh game), cut at gaps after the end of the one before.
SETS = f"""WITH RECURSIVE {VIEWS["plays"]}, f AS (SELECT *, game % 2 AS opp, ts + to_microseconds(CAST(floor(value / 60 * 1000000) AS BIGINT)) AS fin FROM plays WHERE game % 7 <> 0),
m AS (SELECT *, CASE WHEN lag(opp) OVER p = opp AND ts <= lag(fin) OVER p + INTERVAL 10 DAY THEN 0 ELSE 1 END AS b, row_number() OVER p AS pos FROM f WINDOW p AS (PARTITION BY player ORDER BY ts, game)),
k AS (SELECT *, CAST(sum(b) OVER (PARTITION BY player ORDER BY pos) AS BIGINT) AS block FROM m),
c AS (SELECT player, block, pos, w, row_number() OVER (PARTITION BY player, block ORDER BY pos) AS i FROM k),
r AS (
  SELECT player, block, i, 1::BIGINT AS games, (CASE WHEN w = 1 THEN 1 ELSE 0 END)::BIGINT AS wins, (CASE WHEN w = 0 THEN 1 ELSE 0 END)::BIGINT AS losses, pos AS first_pos, w AS opened FROM c WHERE i = 1
  UNION ALL
  SELECT c.player, c.block, c.i, CASE WHEN greatest(r.wins, r.losses) = 2 THEN 1 ELSE r.games + 1 END, CASE WHEN greatest(r.wins, r.losses) = 2 THEN 0 ELSE r.wins END + CASE WHEN c.w = 1 THEN 1 ELSE 0 END,
    CASE WHEN greatest(r.wins, r.losses) = 2 THEN 0 ELSE r.losses END + CASE WHEN c.w = 0 THEN 1 ELSE 0 END, CASE WHEN greatest(r.wins, r.losses) = 2 THEN c.pos ELSE r.first_pos END, CASE WHEN greatest(r.wins, r.losses) = 2 THEN c.w ELSE coalesce(r.opened, c.w) END
  FROM r JOIN c ON c.player = r.player AND c.block = r.block AND c.i = r.i + 1
), s AS (SELECT player, block, row_number() OVER (PARTITION BY player, block ORDER BY i) AS set_no, games, wins, losses, first_pos, opened FROM r WHERE greatest(wins, losses) = 2)"""


def _sets(spark, sf):
    p = plays(spark, sf).withColumn("opponent", F.when(F.col("game") % 7 != 0, F.col("game") % 2))
    return W.best_of_three(p, ["player"], SEQ, "ts", F.expr("ts + make_dt_interval(0, 0, 0, value / 60)"), "opponent", "10 DAYS")


@query("w11_sets_bo3", f"{SETS} SELECT * FROM s")
def w11(spark, sf):
    return _sets(spark, sf)


@query("w12_set_summary", f"{SETS} SELECT player, count(*) AS sets, count(*) FILTER (wins = 2) AS won, round(avg(games), 6) AS mean_games, count(*) FILTER (abs(wins - losses) = 1) AS deciders, count(*) FILTER (abs(wins - losses) = 1 AND wins = 2) AS deciders_won, count(*) FILTER (opened = 0) AS after_loss, count(*) FILTER (opened = 0 AND wins = 2) AS after_loss_won FROM s GROUP BY player")
def w12(spark, sf):
    won, close, behind = F.col("wins") == 2, F.abs(F.col("wins") - F.col("losses")) == 1, F.col("opened") == 0
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rounded(_sets(spark, sf).groupBy("player").agg(F.count("*").alias("sets"), n(won, "won"), F.avg("games").alias("mean_games"), n(close, "deciders"), n(close & won, "deciders_won"), n(behind, "after_loss"), n(behind & won, "after_loss_won")))


@query("w13_records", f"WITH {RUNS}, b AS (SELECT player, max(length) FILTER (kind = 1) AS best_win_streak, max(length) FILTER (kind = 0) AS best_loss_streak FROM s GROUP BY player) SELECT p.player, best_win_streak, best_loss_streak, arg_max(game, (value, -game)) AS top_game FROM plays p LEFT JOIN b ON b.player = p.player GROUP BY ALL", "plays")
def w13(spark, sf):
    p = plays(spark, sf)
    top = p.groupBy("player").agg(F.max_by("game", F.struct("value", -F.col("game"))).alias("top_game"))
    return top.join(W.longest_streaks(p, ["player"], SEQ), "player", "left")


@query("w15_median_split", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY value, ts, game) AS rn, count(*) OVER (PARTITION BY player) AS n FROM plays WHERE w IS NOT NULL) SELECT player, count(*) AS n, round(avg(w) FILTER (rn <= n // 2), 6) AS low, round(avg(w) FILTER (rn > n - n // 2), 6) AS high, round(avg(w) FILTER (rn > n - n // 2) - avg(w) FILTER (rn <= n // 2), 6) AS delta FROM x GROUP BY player", "plays")
def w15(spark, sf):
    return rounded(W.median_split(plays(spark, sf).where("w IS NOT NULL"), ["player"], "value", SEQ))


@query("w18_quartiles", "WITH x AS (SELECT mode, segment, w, amount, row_number() OVER (PARTITION BY segment ORDER BY amount, ts, game) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM games WHERE w IS NOT NULL) SELECT segment, CASE WHEN i < n // 4 THEN 1 WHEN i < n // 2 THEN 2 WHEN i < 3 * n // 4 THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(w), 6) AS win_rate, round(min(amount), 4) AS lo, round(max(amount), 4) AS hi FROM x WHERE n >= 40 GROUP BY 1, 2", "games")
def w18(spark, sf):
    return rounded(W.quartile_rates(games(spark, sf).where("w IS NOT NULL"), ["segment"], "amount", SEQ))


@query("w19_race", "WITH d AS (SELECT CAST(ts AS DATE) AS day, mode, count(*) AS n FROM plays WHERE w = 1 OR mode = 'click' GROUP BY ALL), g AS (SELECT day, mode, coalesce(n, 0) AS n FROM (SELECT DISTINCT day FROM d) CROSS JOIN (SELECT DISTINCT mode FROM d) LEFT JOIN d USING (day, mode)) SELECT mode, strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) OVER (PARTITION BY mode ORDER BY day) AS BIGINT) AS titles FROM g", "plays")
def w19(spark, sf):
    d = plays(spark, sf).where("w = 1 OR mode = 'click'").groupBy(F.to_date("ts").alias("day"), "mode").agg(F.count("*").alias("n"))
    grid = d.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("mode", "n"))).alias("m")).crossJoin(F.broadcast(d.select("mode").distinct()))
    run = Window.partitionBy("mode").orderBy("day")
    return grid.select("mode", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum(F.coalesce(F.col("m")[F.col("mode")], F.lit(0))).over(run).alias("titles"))


@query("w20_breakthroughs", "WITH e AS (SELECT year(ts) - 1992 AS edition, nation, row_number() OVER (PARTITION BY year(ts) ORDER BY sum(amount) DESC, nation) AS rank FROM games GROUP BY year(ts), nation), m AS (SELECT nation, t AS threshold, min(edition) AS first FROM e, (VALUES (5), (10)) x(t) WHERE rank <= t GROUP BY ALL) SELECT nation, threshold, CAST(first AS BIGINT) AS first FROM m WHERE first > (SELECT min(edition) FROM e)", "games")
def w20(spark, sf):
    totals = games(spark, sf).groupBy((F.year("ts") - 1992).cast("long").alias("edition"), "nation").agg(F.sum("amount").alias("a"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("edition").orderBy(F.desc("a"), "nation")))
    reached = ranked.withColumn("threshold", F.explode(F.filter(F.array(F.lit(5), F.lit(10)), lambda t: F.col("rank") <= t)))
    base = ranked.agg(F.min("edition").alias("base"))
    return reached.groupBy("nation", "threshold").agg(F.min("edition").alias("first")).crossJoin(F.broadcast(base)).where("first > base").drop("base")


@query("w22_auc", "WITH x AS (SELECT source, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT a.source, round((count(*) FILTER (a.s > b.s) + 0.5 * count(*) FILTER (a.s = b.s)) / count(*), 6) AS auc FROM x a JOIN x b ON a.source = b.source AND a.y = 1 AND b.y = 0 GROUP BY a.source")
def w22(spark, sf):
    x = load(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("s")).join(load(spark, sf, "labels"), "doc_id")
    return rounded(W.auc(x, ["source"], "s", "quality").where("auc IS NOT NULL"))


@query("w25_prior_window", "SELECT segment, round(avg(w) FILTER (ts >= TIMESTAMP '1998-01-01'), 6) AS now, round(avg(w) FILTER (ts < TIMESTAMP '1998-01-01'), 6) AS before FROM games WHERE ts >= TIMESTAMP '1997-06-01' AND ts < TIMESTAMP '1998-08-03' GROUP BY segment", "games")
def w25(spark, sf):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    g = games(spark, sf).where((F.col("ts") >= at("1997-06-01")) & (F.col("ts") < at("1998-08-03")))
    now = F.col("ts") >= at("1998-01-01")
    return rounded(g.groupBy("segment").agg(F.avg(F.when(now, F.col("w"))).alias("now"), F.avg(F.when(~now, F.col("w"))).alias("before")))


@query("t09_hash_sample", "SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY sha256(CAST(p_partkey AS VARCHAR))) <= 20")
def t09(spark, sf):
    w = Window.partitionBy("p_type").orderBy(S.key_hash(F.col("p_partkey")))
    return load(spark, sf, "part").withColumn("r", F.row_number().over(w)).where("r <= 20").select("p_type", "p_partkey")


@query("d01_content_key", "WITH k AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|' || array_to_string(list_sort(['C' || o_custkey, 'O' || (o_orderkey % 5)]), '+') AS key FROM orders) SELECT key, count(*) AS n, min(o_orderkey) AS first FROM k GROUP BY key")
def d01(spark, sf):
    players = F.array(F.concat(F.lit("C"), F.col("o_custkey")), F.concat(F.lit("O"), F.col("o_orderkey") % 5))
    key = D.content_key(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), players)
    return load(spark, sf, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("d02_prefer", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 4) AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'N' DESC, l_extendedprice DESC, l_partkey) = 1")
def d02(spark, sf):
    got = D.prefer(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], F.desc(F.col("l_returnflag") == "N"), F.desc("l_extendedprice"), F.asc("l_partkey"))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 4).alias("price"))


@query("d04_stale_partials", "WITH x AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS t FROM orders) SELECT o_orderkey FROM x a WHERE t IS NOT NULL OR NOT EXISTS (SELECT 1 FROM x b WHERE b.o_custkey = a.o_custkey AND b.t IS NOT NULL)")
def d04(spark, sf):
    x = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("t"))
    return D.drop_stale_partials(x, "o_custkey", "t").select("o_orderkey")


@query("d07_evidence_merge", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part, bool_or(l_returnflag = 'R') AS broadcast, bool_and(l_tax > 0.01) AS friendly FROM lineitem GROUP BY l_orderkey")
def d07(spark, sf):
    x = load(spark, sf, "lineitem").withColumns({"broadcast": F.col("l_returnflag") == "R", "friendly": F.col("l_tax") > 0.01})
    got = D.merge_evidence(x, ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey")], ["broadcast"], ["friendly"])
    return got.select("l_orderkey", F.col("l_partkey").alias("part"), "broadcast", "friendly")


@query("d03_tri_state", "SELECT l_orderkey, CASE WHEN min(l_returnflag = 'N') = max(l_returnflag = 'N') THEN min(l_returnflag = 'N') END AS flag, min(l_returnflag = 'N') <> max(l_returnflag = 'N') AS conflict FROM lineitem GROUP BY 1")
def d03(spark, sf):
    return D.tri_state(load(spark, sf, "lineitem").withColumn("flag", F.col("l_returnflag") == "N"), ["l_orderkey"], "flag")


@query("d08_hash_dedup_conflict", "SELECT sha256(text) AS sha, count(*) AS copies, count(DISTINCT source) AS variants FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def d08(spark, sf):
    return D.conflicts(load(spark, sf, "documents").select(F.sha2("text", 256).alias("sha"), "source"), ["sha"], "source")


@query("d09_versioned_upsert", "WITH s AS (SELECT l_partkey AS k, max(l_linenumber) AS v, 0 AS ord FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), i AS (SELECT l_partkey AS k, max(l_linenumber) AS v, 1 AS ord FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT k, v, ord FROM (SELECT * FROM s UNION ALL SELECT * FROM i) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC, ord DESC) = 1")
def d09(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag")
    one = lambda flag, o: li.where(F.col("l_returnflag") == flag).groupBy("k").agg(F.max("v").alias("v")).withColumn("ord", F.lit(o))
    return D.versioned_merge(one("A", 0), one("N", 1), ["k"], "v", "ord")


@query("d10_set_union", "SELECT segment, len(list_distinct(list(player) FILTER (w = 1) || list(player) FILTER (w = 0)))::BIGINT AS players FROM games GROUP BY segment", "games")
def d10(spark, sf):
    # a distinct count, not two sets in memory
    return games(spark, sf).groupBy("segment").agg(F.count_distinct(F.when(F.col("w").isNotNull(), F.col("player"))).alias("players"))


@query("x10_wilson", "WITH a AS (SELECT player, count(*) FILTER (w = 1)::DOUBLE AS k, count(w)::DOUBLE AS n FROM plays GROUP BY player), b AS (SELECT player, k / n AS p, n, 1.959963984540054 AS z FROM a WHERE n > 0) SELECT player, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM b", "plays")
def x10(spark, sf):
    t = plays(spark, sf).groupBy("player").agg(F.count(F.when(F.col("w") == 1, 1)).alias("k"), F.count("w").alias("n")).where("n > 0")
    low, high = S.wilson(F.col("k"), F.col("n"))
    return rounded(t.select("player", low.alias("low"), high.alias("high")))


@query("x11_scores", "WITH x AS (SELECT mode, w, greatest(1e-15, least(1 - 1e-15, (value % 101) / 101.0)) AS p FROM plays WHERE w IS NOT NULL) SELECT mode, count(*) AS n, round(avg(CASE WHEN p = 0.5 THEN 0.5 WHEN (p > 0.5) = (w = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg((p - w) * (p - w)), 6) AS brier, round(avg(CASE WHEN w = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM x GROUP BY mode", "plays")
def x11(spark, sf):
    x = plays(spark, sf).where("w IS NOT NULL").withColumn("p", F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), (F.col("value") % 101) / 101.0)))
    return rounded(M.scores(x, ["mode"], "p", "w"))


@query("x05_z_tests", "WITH a AS (SELECT segment, count(*) FILTER (w = 1)::DOUBLE AS w1, count(w)::DOUBLE AS n1 FROM games GROUP BY 1), t AS (SELECT sum(w1) AS wt, sum(n1) AS nt FROM a) SELECT segment, round((w1/n1 - (wt-w1)/(nt-n1)) / sqrt(wt/nt * (1 - wt/nt) * (1/n1 + 1/(nt-n1))), 6) AS z FROM a, t", "games")
def x05(spark, sf):
    a = games(spark, sf).groupBy("segment").agg(F.sum("w").cast("double").alias("w1"), F.count("w").cast("double").alias("n1"))
    t = a.agg(F.sum("w1").alias("wt"), F.sum("n1").alias("nt"))
    both = a.crossJoin(F.broadcast(t))
    return rounded(both.select("segment", S.z_two(F.col("w1"), F.col("n1"), F.col("wt") - F.col("w1"), F.col("nt") - F.col("n1")).alias("z")))


@query("x13_bucket", "SELECT o_orderkey, round(o_totalprice / 500) * 500 AS bucket FROM orders")
def x13(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", S.coarsen(F.col("o_totalprice"), 500).alias("bucket"))


@query("x14_fnv_bucket", "SELECT c_custkey, CAST(list_reduce(list_prepend(197, list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, CAST(i AS INTEGER), 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 147) % 256) AS INTEGER) AS bucket FROM customer")
def x14(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.byte_bucket(F.col("c_name")).alias("bucket"))


@query("x15_sha_key", "SELECT o_orderkey, substr(sha256(o_orderkey || ':' || o_custkey || ':' || o_orderpriority), 1, 24) AS key FROM orders")
def x15(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.substring(S.key_hash(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")), 1, 24).alias("key"))


@query("x17_best_of", "SELECT p_partkey, round(3*p*p*(1-p) + p*p*p, 6) AS bo3, round(10*p**3*(1-p)**2 + 5*p**4*(1-p) + p**5, 6) AS bo5 FROM (SELECT p_partkey, p_size / 51.0 AS p FROM part)")
def x17(spark, sf):
    p = F.col("p_size") / 51.0
    return rounded(load(spark, sf, "part").select("p_partkey", S.best_of(p, 3).alias("bo3"), S.best_of(p, 5).alias("bo5")))


@query("x18_name_key", "SELECT c_custkey, translate(regexp_replace(lower(c_name), '[\\s._''\"`-]', '', 'g'), '0$', 'os') AS key FROM customer")
def x18(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.name_key(F.col("c_name")).alias("key"))


@query("x20_code_norm", "SELECT p_partkey, nullif(upper(trim(p_name)), '') AS code, regexp_matches(upper(trim(p_name)), '^[A-Z0-9]{1,8}#[0-9]{1,4}$') AS valid FROM part")
def x20(spark, sf):
    c = S.code(F.col("p_name"))
    return load(spark, sf, "part").select("p_partkey", c.alias("code"), c.rlike(r"^[A-Z0-9]{1,8}#\d{1,4}$").alias("valid"))


SPLICED = "CASE WHEN page_id % 3 = 0 THEN html || '<scr<b>ipt>x</scr</b>ipt> a &nbsp; b' ELSE html END"


def _stripped(text: str, passes: int = 8) -> str:
    for _ in range(passes):
        text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    return text


@query("x29_html_strip", rf"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace({_stripped(SPLICED)}, '[<>]', '', 'g'), '&#160;|&nbsp;|\x{{A0}}', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM pages")
def x29(spark, sf):
    """Pages, a third of them with tags that removing other tags puts together."""
    return load(spark, sf, "pages").select("page_id", F.sha2(S.html_text(F.expr(SPLICED)), 256).alias("digest"))


@query("x29_event_end", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate) || '-01' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN year(o_orderdate) || strftime(o_orderdate + INTERVAL 3 DAY, '-%m-%d') ELSE strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS day FROM orders")
def x29_end(spark, sf):
    """The last day of texts that name none, one day, a range, and a range without its year (then the order's)."""
    d, later, k = F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 3 DAY"), F.col("o_orderkey") % 5
    name = lambda x, form: F.date_format(x, form)
    text = F.when(k == 0, "no day").when(k == 1, F.concat(F.lit("On "), name(d, "MMM d, yyyy"))).when(k == 4, F.concat(name(d, "MMM d"), F.lit(" - "), name(later, "MMM d")))
    text = text.otherwise(F.concat(name(d, "MMM d"), F.lit(" \u2013 "), F.when(F.month(d) == F.month(later), name(later, "d, yyyy")).otherwise(name(later, "MMM d, yyyy"))))
    return load(spark, sf, "orders").select("o_orderkey", S.event_end(text, F.year("o_orderdate")).alias("day"))


@query("x05_one_sample", "WITH c AS (SELECT nation, sum(w)::DOUBLE AS k, count(w)::DOUBLE AS n FROM games GROUP BY nation), t AS (SELECT sum(k) / sum(n) AS p FROM c) SELECT nation, round((k / n - p) / sqrt(p * (1 - p) / n), 6) AS z FROM c, t WHERE n > 0", "games")
def x05_one(spark, sf):
    """Each nation's rate of wins against that of all."""
    c = games(spark, sf).groupBy("nation").agg(F.sum("w").cast("double").alias("k"), F.count("w").cast("double").alias("n"))
    base = c.agg((F.sum("k") / F.sum("n")).alias("p"))
    return rounded(c.crossJoin(F.broadcast(base)).where("n > 0").select("nation", S.z_one(F.col("k") / F.col("n"), F.col("p"), F.col("n")).alias("z")))


@query("x33_highlight", "SELECT p_partkey, CASE WHEN p_size >= 10 AND p_partkey >= 25 THEN round(least(1, 0.15 + greatest(0, abs(p_size - 20.0) / greatest(2.0, 7.0) - 1) * 0.425), 6) END AS strength FROM part")
def x33(spark, sf):
    return rounded(load(spark, sf, "part").select("p_partkey", S.highlight(F.col("p_size").cast("double"), F.lit(20.0), F.col("p_size"), F.col("p_partkey"), 2.0).alias("strength")))


@query("s21_smallest_per_pair", "SELECT p_brand, p_type, min(p_size) AS p_size, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part GROUP BY ALL")
def s21(spark, sf):
    return smallest_per_pair(load(spark, sf, "part"), ["p_brand", "p_type"], "p_size", "p_partkey")


@query("p06_digest", """WITH r AS (SELECT sha256('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}') AS h FROM supplier), d AS (SELECT ('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 16, 15))::BIGINT AS b FROM r)
SELECT count(*) AS rows, sha256(CAST(sum(a) AS VARCHAR) || ':' || CAST(sum(b) AS VARCHAR)) AS digest FROM d""")
def p06(spark, sf):
    return content_digest(load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), ["s_suppkey"])


@query("p10_reconcile", "SELECT count(*) AS differing FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 EXCEPT ALL SELECT player, count(*) FROM games GROUP BY 1)", "games")
def p10(spark, sf):
    a = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("player")).agg(F.count("*").alias("n"))
    return a.exceptAll(games(spark, sf).groupBy("player").agg(F.count("*").alias("n"))).agg(F.count("*").alias("differing"))


@query("k01_new_actions", "SELECT mode, count(*) AS n FROM (SELECT mode, lag(mode) OVER p AS m, value < lag(value) OVER p AS fell FROM plays WINDOW p AS (PARTITION BY player ORDER BY ts, game)) WHERE m IS NULL OR m <> mode OR fell GROUP BY mode", "plays")
def k01(spark, sf):
    return K.new_actions(plays(spark, sf), ["player"], SEQ, "mode", "value").groupBy("mode").agg(F.count("*").alias("n"))


def _turns(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("k09_opening_context", "WITH x AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM conversations) SELECT conv_id, turn, CASE WHEN turn - last <= 1 THEN 'user' END AS context FROM x")
def k09(spark, sf):
    t = _turns(spark, sf).withColumn("act", F.when(F.col("role") == "user", "user"))
    return K.recent_action(t, ["conv_id"], ["turn"], "turn", "act", 1).select("conv_id", "turn", "context")


@query("k12_contiguous", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*)")
def k12(spark, sf):
    return K.contiguous(_turns(spark, sf), ["conv_id"], "turn").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("l01_irls")
def l01(spark, sf):
    x = load(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.col("lang") == "en").cast("double").alias("en")).join(load(spark, sf, "labels"), "doc_id")
    got = L.irls(x, ["n_chars", "en"], "quality") or {}
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "term string, coefficient double")


@query("l03_collinear", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem) SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(r.a, 6) AS r FROM r UNION ALL SELECT 'l_quantity', 'l_tax', round(r.b, 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_tax', round(r.c, 6) FROM r) WHERE abs(r) >= 0.0")
def l03(spark, sf):
    return rounded(L.correlated_pairs(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 0.0))


@query("l05_coach", "WITH c AS (SELECT mode, nation, sum(w)::DOUBLE AS w1, count(*)::DOUBLE AS n1 FROM games WHERE w IS NOT NULL GROUP BY ALL), t AS (SELECT mode, sum(w1) AS wt, sum(n1) AS nt FROM c GROUP BY mode), z AS (SELECT mode, nation, n1, w1/n1 - (wt-w1)/(nt-n1) AS effect, (w1/n1 - (wt-w1)/(nt-n1)) / sqrt(wt/nt * (1-wt/nt) * (1/n1 + 1/(nt-n1))) AS z FROM c JOIN t USING (mode)) SELECT mode, nation, CAST(n1 AS BIGINT) AS n1, round(z, 6) AS z, round(effect, 6) AS effect, round(abs(effect) * sqrt(n1), 6) AS score FROM z WHERE n1 >= 20 AND abs(z) >= 1 ORDER BY abs(effect) * sqrt(n1) DESC, nation LIMIT 5", "games")
def l05(spark, sf):
    return rounded(L.standouts(games(spark, sf), ["mode"], "nation", 20, 1.0, 5))


@query("m03_folds", "WITH e AS (SELECT c_nationkey * 100 + year(o_orderdate) - 1992 AS event, min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS f FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT CAST(a.event AS BIGINT) AS event, count(b.event) AS train_events FROM e a LEFT JOIN e b ON b.f < a.s GROUP BY 1 HAVING count(b.event) >= 5")
def m03(spark, sf):
    g = games(spark, sf)
    e = g.groupBy((F.col("nation") * 100 + F.year("ts") - 1992).cast("long").alias("event")).agg(F.min(F.to_date("ts")).alias("start"), F.max(F.to_date("ts")).alias("end"))
    return M.folds(e, 5)


def _pairings(spark, sf):
    """Orders as results between nations: the customer's against one by order key, in yearly events."""
    g = games(spark, sf).where("w IS NOT NULL").withColumn("b", (F.col("game") % 25).cast("int"))
    return g.where("b <> nation").select("segment", F.year("ts").alias("event"), F.datediff(F.to_date("ts"), F.lit("1992-01-01").cast("date")).alias("day_of"), F.col("nation").alias("a"), "b", F.col("w").alias("won"), "game")


CUTOFF = 2192  # days from 1992 to 1998
PAIRS = """h AS (SELECT segment, CAST(year(ts) AS INTEGER) AS event, date_diff('day', DATE '1992-01-01', CAST(ts AS DATE)) AS day_of, nation AS a, CAST(game % 25 AS INTEGER) AS b, w AS won FROM games WHERE w IS NOT NULL AND game % 25 <> nation),
q AS (SELECT segment, event, a, b, max(max(day_of)) OVER (PARTITION BY segment, event) AS fin, count(*) AS n, sum(won) AS wins FROM h GROUP BY segment, event, a, b)"""


@query("m05_higher_seed", f"WITH {PAIRS}, s AS (SELECT segment, player, row_number() OVER (PARTITION BY segment ORDER BY sum(wins) DESC, player) AS seed FROM (SELECT segment, a AS player, wins FROM q WHERE event = 1995 UNION ALL SELECT segment, b, n - wins FROM q WHERE event = 1995) GROUP BY segment, player) SELECT q.segment, CAST(sum(n) AS BIGINT) AS comparisons, CAST(sum(CASE WHEN x.seed < y.seed THEN wins ELSE n - wins END) AS BIGINT) AS higher_wins, round(greatest(0.5, (sum(CASE WHEN x.seed < y.seed THEN wins ELSE n - wins END) + 1) / (sum(n) + 2)::DOUBLE), 6) AS confidence FROM q JOIN s x ON x.segment = q.segment AND x.player = a JOIN s y ON y.segment = q.segment AND y.player = b WHERE event > 1995 AND fin < 2192 GROUP BY q.segment", "games")
def m05(spark, sf):
    """Seeds from the wins of the first event; the confidence is that of the training events alone."""
    pairs = M.event_pairs(_pairings(spark, sf), ["segment"], "event", "day_of", "a", "b", "won")
    first = pairs.where("event = 1995")
    wins = first.select("segment", F.col("a").alias("player"), "wins").unionByName(first.select("segment", F.col("b").alias("player"), (F.col("games") - F.col("wins")).alias("wins")))
    seeds = wins.groupBy("segment", "player").agg(F.sum("wins").alias("w")).withColumn("seed", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("w"), "player")))
    side = lambda c: seeds.select("segment", F.col("player").alias(c), F.col("seed").alias(f"seed_{c}"))
    known = pairs.where((F.col("event") > 1995) & (F.col("day") < CUTOFF)).join(side("a"), ["segment", "a"]).join(side("b"), ["segment", "b"])
    return rounded(M.seed_confidence(known, ["segment"], "seed_a", "seed_b", "games", "wins"))


@query("m13_calibration", "WITH x AS (SELECT least(9, CAST(floor(((value % 101) / 101.0) * 10) AS INTEGER)) AS bin, (value % 101) / 101.0 AS p, w FROM plays WHERE w IS NOT NULL) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(w), 6) AS observed FROM x GROUP BY bin", "plays")
def m13(spark, sf):
    p = (F.col("value") % 101) / 101.0
    x = plays(spark, sf).where("w IS NOT NULL").select(p.alias("p"), "w", F.least(F.lit(9), F.floor(p * 10)).cast("int").alias("bin"))
    return rounded(x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("w").alias("observed")))


@query("m19_bracket_mc")
def m19(spark, sf):
    """The eight nations with the best smoothed log-odds of their decided games."""
    g = games(spark, sf).groupBy(F.col("nation").alias("entrant")).agg(F.sum("w").alias("wins"), F.count("w").alias("n"))
    strength = g.select("entrant", F.log((F.col("wins") + 1) / (F.col("n") - F.col("wins") + 1)).alias("strength"))
    return M.bracket_titles(strength.orderBy(F.desc("strength"), "entrant").limit(8), 5000)


@query("i02_preview_replace", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS v, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) END AS amount FROM orders")
def i02(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("amount"), "o_orderstatus")
    preview = o.select("k", F.lit(1).alias("v"), F.lit(None).cast("double").alias("amount"), F.lit(0).alias("ord"))
    full = o.where("o_orderstatus = 'F'").select("k", F.lit(2).alias("v"), "amount", F.lit(1).alias("ord"))
    return D.versioned_merge(preview, full, ["k"], "v", "ord").drop("ord")


@query("i09_dirty_refresh", "SELECT player, count(*) AS n, round(sum(amount), 2) AS amount FROM games GROUP BY player", "games")
def i09(spark, sf):
    g = games(spark, sf)
    build = lambda df: df.groupBy("player").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    old = g.where(F.col("ts") < F.lit("1997-01-01").cast("timestamp_ntz"))
    dirty = g.where(F.col("ts") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("player").distinct()
    return I.refresh_dirty(build(old), g, dirty, "player", build)


@query("i18_session_window", "WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY player ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM plays), z AS (SELECT *, sum(n) OVER (PARTITION BY player ORDER BY ts) AS s FROM o) SELECT player, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS games FROM z GROUP BY player, s", "plays")
def i18(spark, sf):
    """The streaming form over the whole table, drained; every batch writes the sessions so far as files, and the last one stays."""
    schema = load(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    timed = stream.select(F.col("user_id").alias("player"), F.col("ts").cast("timestamp").alias("ts"))
    root, last = f"{scratch_dir(spark)}/sessions-{uuid.uuid4().hex}", []
    got = I.gap_sessions(timed, "player", "ts", "12 hours", "1 day")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/{number}")
        last.append(number)

    got.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{root}/{max(last)}").select("player", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "games")
