"""Filters, joins and grouped aggregates over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.functions import scalar as S
from matchlake.metrics import RatioMetric, group_rows, record
from matchlake.operators import aggregate as A
from matchlake.operators import joins as J
from matchlake.operators import resolve as R
from matchlake.plans.registry import games, moves, plays, query, rounded
from matchlake.session import load

WL = "count(*) AS games, count(*) FILTER (w = 1) AS wins, count(*) FILTER (w = 0) AS losses, count(w) AS decided, round(count(*) FILTER (w = 1) / nullif(count(w), 0)::DOUBLE, 6) AS win_rate"
END = "2000-01-01"


def _players(spark, sf):
    """Orders as two-player games: the customer against its nation's number, to exercise orientation."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    both = o.join(c, o.o_custkey == c.c_custkey)
    side = lambda code, ch: F.struct(code.alias("code"), ch.cast("long").alias("character"), (F.col("o_orderkey") % 50 == 0).alias("is_cpu"))
    players = F.array(side(F.concat(F.lit("C"), F.col("o_custkey") % 40), F.col("c_nationkey")), side(F.concat(F.lit("C"), F.col("o_orderkey") % 40), F.col("o_orderkey") % 30))
    return both.select(F.col("o_orderkey").alias("game"), players.alias("players"), (F.col("o_orderkey") % 8).alias("stage"), (F.col("o_orderpriority") == "1-URGENT").alias("is_teams"), F.lit(None).cast("string").alias("error"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).alias("winner_index"))


@query(
    "f01_resolve",
    """
WITH p AS (SELECT o_orderkey AS game, 'C' || (o_custkey % 40) AS c1, c_nationkey AS h1, 'C' || (o_orderkey % 40) AS c2, o_orderkey % 30 AS h2, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS winner
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 50 <> 0 AND o_orderkey % 8 BETWEEN 1 AND 6 AND c_nationkey BETWEEN 0 AND 25 AND o_orderkey % 30 BETWEEN 0 AND 25),
m AS (SELECT *, c1 IN ('C1', 'C2', 'C3') AS a, c2 IN ('C1', 'C2', 'C3') AS b FROM p)
SELECT game, CASE WHEN a THEN c1 ELSE c2 END AS me, CASE WHEN a THEN c2 ELSE c1 END AS opp, a AND b AS self_match,
  CASE WHEN (a AND b) OR winner IS NULL THEN NULL WHEN winner = CASE WHEN a THEN 0 ELSE 1 END THEN 1 ELSE 0 END AS w FROM m WHERE a OR b""",
)
def f01(spark, sf):
    got = R.resolve_games(_players(spark, sf), ["C1", "C2", "C3"], (1, 6), (0, 25))
    return got.select("game", F.col("me.code").alias("me"), F.col("opp.code").alias("opp"), "self_match", "w")


@query(
    "f02_team_resolve",
    """
WITH t AS (SELECT conv_id, min(text) FILTER (turn = 0) AS t0 FROM conversations GROUP BY 1),
p AS (SELECT conv_id AS game, conv_id % 7 AS a, conv_id % 5 AS b, conv_id % 3 AS c, conv_id % 11 AS d, CASE WHEN conv_id % 4 = 3 THEN NULL ELSE conv_id % 2 END AS winner FROM t)
SELECT game, CAST(b AS VARCHAR) AS ally, (b = 1 OR c = 1 OR d = 1) AS self_match, CASE WHEN b = 1 OR c = 1 OR d = 1 OR winner IS NULL THEN NULL WHEN winner = 0 THEN 1 ELSE 0 END AS w FROM p WHERE a = 1
UNION ALL SELECT game, CAST(a AS VARCHAR), (c = 1 OR d = 1), CASE WHEN c = 1 OR d = 1 OR winner IS NULL THEN NULL WHEN winner = 0 THEN 1 ELSE 0 END FROM p WHERE a <> 1 AND b = 1
UNION ALL SELECT game, CAST(d AS VARCHAR), d = 1, CASE WHEN d = 1 OR winner IS NULL THEN NULL WHEN winner = 1 THEN 1 ELSE 0 END FROM p WHERE a <> 1 AND b <> 1 AND c = 1
UNION ALL SELECT game, CAST(c AS VARCHAR), FALSE, CASE WHEN winner IS NULL THEN NULL WHEN winner = 1 THEN 1 ELSE 0 END FROM p WHERE a <> 1 AND b <> 1 AND c <> 1 AND d = 1""",
)
def f02(spark, sf):
    g = load(spark, sf, "conversations").select("conv_id").distinct()
    side = lambda n, team: F.struct((F.col("conv_id") % n).cast("string").alias("code"), F.lit(team).alias("team"))
    table = g.select(F.col("conv_id").alias("game"), F.lit(True).alias("is_teams"), F.lit(None).cast("string").alias("error"), F.array(side(7, 0), side(5, 0), side(3, 1), side(11, 1)).alias("players"), F.when(F.col("conv_id") % 4 != 3, F.col("conv_id") % 2).alias("winner_team"))
    return R.resolve_team_games(table, ["1"]).select("game", F.col("ally.code").alias("ally"), "self_match", "w")


@query("f07_date_filter", f"SELECT 'range' AS filter, {WL} FROM games WHERE CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' UNION ALL SELECT 'day', {WL} FROM games WHERE CAST(ts AS DATE) = DATE '1995-03-05' UNION ALL SELECT 'invalid', {WL} FROM games WHERE FALSE UNION ALL SELECT 'last365', {WL} FROM games WHERE ts >= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY", "games")
def f07(spark, sf):
    kinds = {"range": R.Filters(range="custom", start="1995-01-01", end="1996-06-30"), "day": R.Filters(day="1995-03-05"), "invalid": R.Filters(range="custom", start="1996-01-01", end="1995-01-01"), "last365": R.Filters(range=365, now=datetime(1998, 8, 1))}
    out = None
    for name, f in kinds.items():
        one = f.apply(games(spark, sf)).agg(*record()).select(F.lit(name).alias("filter"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("f09_filters", f"SELECT player, {WL} FROM games WHERE segment = 'BUILDING' AND mode IN ('1-URGENT', '2-HIGH') AND CAST(ts AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' GROUP BY player", "games")
def f09(spark, sf):
    f = R.Filters(range="custom", start="1993-01-01", end="1997-12-31", equal=(("segment", "BUILDING"),), modes=("1-URGENT", "2-HIGH"))
    return rounded(group_rows(f.apply(games(spark, sf)), ["player"]))


@query("f13_exclusion_case", "SELECT coalesce(CASE WHEN p_size < 5 THEN 'illegal-stage' WHEN p_brand = 'Brand#11' THEN 'invalid-roster' WHEN p_retailprice > 1500 THEN 'invalid-format' WHEN p_size < 10 THEN 'too-short' END, 'kept') AS reason, count(*) AS n FROM part GROUP BY 1")
def f13(spark, sf):
    size = F.col("p_size")
    reason = S.first_reason((size < 5, "illegal-stage"), (F.col("p_brand") == "Brand#11", "invalid-roster"), (F.col("p_retailprice") > 1500, "invalid-format"), (size < 10, "too-short"))
    return load(spark, sf, "part").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("f19_listwise", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL GROUP BY source")
def f19(spark, sf):
    both = load(spark, sf, "documents").select("doc_id", "source", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    return rounded(R.listwise(both, ["quality", "n_chars"]).groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")))


@query("j03_both_sides", "WITH s AS (SELECT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) SELECT own, opp, side, count(*) AS n FROM (SELECT a AS own, b AS opp, 0 AS side FROM s UNION ALL SELECT b, a, 1 FROM s) GROUP BY ALL")
def j03(spark, sf):
    o, li, c, s = (load(spark, sf, t) for t in ("orders", "lineitem", "customer", "supplier"))
    both = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    return J.both_sides(both, ["c_nationkey"], ["s_nationkey"], ["n"]).withColumnsRenamed({"own_n": "own", "opp_n": "opp"}).groupBy("own", "opp", "side").agg(F.sum("n").alias("n"))


@query("j04_period_range_join", f"SELECT d AS look_back, mode, {WL} FROM games, (VALUES (30), (90), (180), (365), (NULL)) p(d) WHERE d IS NULL OR ts >= TIMESTAMP '1998-08-01' - to_days(d) GROUP BY d, mode", "games")
def j04(spark, sf):
    return rounded(group_rows(J.look_backs(games(spark, sf), "ts", "1998-08-01", [30, 90, 180, 365, None]), ["look_back", "mode"]))


@query("j05_nullsafe_join", "WITH r AS (SELECT CASE WHEN grouping(mode) = 1 THEN NULL ELSE mode END AS mode, segment, count(*) AS n FROM games GROUP BY GROUPING SETS ((mode, segment), (segment))), t AS (SELECT CASE WHEN grouping(mode) = 1 THEN NULL ELSE mode END AS mode, count(*) AS total FROM games GROUP BY GROUPING SETS ((mode), ())) SELECT r.mode, segment, n, total FROM r JOIN t ON r.mode IS NOT DISTINCT FROM t.mode", "games")
def j05(spark, sf):
    g = games(spark, sf)
    r = A.cube(g, ["mode", "segment"], [["mode", "segment"], ["segment"]], [F.count("*").alias("n")]).drop("level")
    t = A.cube(g, ["mode"], [["mode"], []], [F.count("*").alias("total")]).drop("level")
    return J.null_safe_join(r, t, ["mode"])


@query("j06_first_owner_anti", "SELECT DISTINCT l_orderkey AS game, l_suppkey AS owner FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey < a.l_suppkey)")
def j06(spark, sf):
    pairs = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("owner")).distinct()
    return J.first_owner(pairs, ["game"], "owner")


@query("j07_reconcile_diff", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01') SELECT k, 'delete' AS change FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'insert' FROM b WHERE k NOT IN (SELECT k FROM a)")
def j07(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    return J.difference(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), ["k"])


@query("j09_left_version_filter", "WITH s AS (SELECT l_partkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), i AS (SELECT l_partkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT i.k, i.v FROM i LEFT JOIN s ON s.k = i.k WHERE s.k IS NULL OR i.v > s.v")
def j09(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag")
    one = lambda flag: li.where(F.col("l_returnflag") == flag).groupBy("k").agg(F.max("v").alias("v"))
    return J.newer_than_stored(one("N"), one("A"), ["k"], "v")


@query("j14_priority_lookup", "SELECT p_partkey AS part, coalesce(a.x, b.x, p_type) AS identity FROM part LEFT JOIN (SELECT p_brand, p_size, min(p_name) AS x FROM part WHERE p_size > 45 GROUP BY 1, 2) a USING (p_brand, p_size) LEFT JOIN (SELECT p_brand, min(p_name) AS x FROM part WHERE p_size < 3 GROUP BY 1) b USING (p_brand)")
def j14(spark, sf):
    p = load(spark, sf, "part")
    exact = p.where("p_size > 45").groupBy("p_brand", "p_size").agg(F.min("p_name").alias("x"))
    loose = p.where("p_size < 3").groupBy("p_brand").agg(F.min("p_name").alias("x"))
    got = J.priority_lookup(p, [(exact, ["p_brand", "p_size"], "x"), (loose, ["p_brand"], "x")], "identity")
    return got.select(F.col("p_partkey").alias("part"), F.coalesce("identity", "p_type").alias("identity"))


_CLICKS = "c AS (SELECT player, ts, max(value) AS value FROM plays WHERE mode = 'click' GROUP BY player, ts), q AS (SELECT game, player, ts FROM plays WHERE mode = 'purchase')"


def _asof(spark, sf, tolerance):
    p = plays(spark, sf)
    clicks = p.where("mode = 'click'").groupBy("player", "ts").agg(F.max("value").alias("value"))
    got = J.as_of(p.where("mode = 'purchase'").select("game", "player", "ts"), clicks, ["player"], "ts", "value", "last_value", tolerance=tolerance)
    return rounded(got.select("game", "last_value"))


@query("j19_asof", f"WITH {_CLICKS} SELECT game, round(arg_max(value, c.ts), 6) AS last_value FROM q LEFT JOIN c ON c.player = q.player AND c.ts < q.ts GROUP BY game", "plays")
def j19(spark, sf):
    return _asof(spark, sf, None)


@query("j20_asof_tolerance", f"WITH {_CLICKS} SELECT game, round(arg_max(value, c.ts), 6) AS last_value FROM q LEFT JOIN c ON c.player = q.player AND c.ts < q.ts AND c.ts >= q.ts - INTERVAL 2 HOUR GROUP BY game", "plays")
def j20(spark, sf):
    return _asof(spark, sf, F.expr("INTERVAL 2 HOURS"))


@query("a01_code_counts", "SELECT user_id AS code, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def a01(spark, sf):
    return load(spark, sf, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("code")).agg(F.count("*").alias("n"))


@query("a02_tally", f"SELECT segment, {WL} FROM games GROUP BY segment", "games")
def a02(spark, sf):
    return rounded(group_rows(games(spark, sf), ["segment"]))


MEASURED = "m AS (SELECT game, sum(landed) AS landed, sum(damage) AS damage FROM moves GROUP BY game), j AS (SELECT g.*, m.landed, m.damage FROM games g LEFT JOIN m USING (game))"


def measured(spark, sf):
    """Games with their moves' totals: null where no move was measured."""
    items = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(F.sum("l_quantity").alias("landed"), F.sum("l_extendedprice").alias("damage"))
    return games(spark, sf).join(items, "game", "left")


@query("a03_overview", f"WITH {MEASURED} SELECT segment, {WL}, count(damage) AS measured, round(sum(damage) / nullif(count(damage), 0), 4) AS damage_per_game, round(avg(amount), 4) AS mean_amount FROM j GROUP BY segment", "games", "moves")
def a03(spark, sf):
    known = F.count("damage")
    got = measured(spark, sf).groupBy("segment").agg(*record(), known.alias("measured"), F.round(S.ratio(F.sum("damage"), known), 4).alias("damage_per_game"), F.round(F.avg("amount"), 4).alias("mean_amount"))
    return rounded(got)


@query("a04_neutral_long", "WITH t AS (SELECT l_returnflag AS side, sum(l_quantity) AS quantity, sum(l_tax) AS tax, sum(l_discount) AS discount FROM lineitem GROUP BY 1), u AS (UNPIVOT t ON quantity, tax, discount INTO NAME measure VALUE value) SELECT side, measure, round(value, 4) AS value, round(value / sum(value) OVER (PARTITION BY measure), 6) AS share FROM u")
def a04(spark, sf):
    t = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("side")).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("discount"))
    long = A.unpivot(t, ["side"], ["quantity", "tax", "discount"])
    return long.select("side", "measure", F.round("value", 4).alias("value"), F.round(F.col("value") / F.sum("value").over(Window.partitionBy("measure")), 6).alias("share"))


@query("a05_action_avgs", f"WITH {MEASURED}, u AS (SELECT mode, amount, 'landed' AS measure, landed AS value FROM j UNION ALL SELECT mode, amount, 'damage', damage FROM j) SELECT mode, measure, count(value) AS coverage, round(sum(value) / nullif(count(value), 0), 4) AS per_game, round(coalesce(sum(value) / nullif(sum(amount) FILTER (value IS NOT NULL), 0), 0), 6) AS per_minute FROM u GROUP BY ALL", "games", "moves")
def a05(spark, sf):
    got = A.averages(measured(spark, sf), ["mode"], ["landed", "damage"], "amount")
    return rounded(got.withColumn("per_game", F.round("per_game", 4)))


@query("a07_group_rows", f"WITH {MEASURED} SELECT nation, {WL}, round(sum(landed) / sum(amount) FILTER (landed IS NOT NULL), 6) AS rate FROM j GROUP BY nation", "games", "moves")
def a07(spark, sf):
    return rounded(group_rows(measured(spark, sf), ["nation"], [RatioMetric("rate", F.col("landed"), F.col("amount"))]))


@query("a08_matrix", f"SELECT segment, mode, {WL}, sum(count(*)) OVER (PARTITION BY segment)::BIGINT AS axis FROM games GROUP BY segment, mode", "games")
def a08(spark, sf):
    return rounded(group_rows(games(spark, sf), ["segment", "mode"]).withColumn("axis", F.sum("games").over(Window.partitionBy("segment"))))


@query("a10_by_stage", f"SELECT nation, {WL} FROM games GROUP BY nation", "games")
def a10(spark, sf):
    return rounded(group_rows(games(spark, sf), ["nation"]))


@query("a11_by_opponent", f"WITH x AS (SELECT player, {WL}, strftime(max(ts), '%Y-%m-%d') AS last_played, arg_max(mode, (ts, game)) AS last_mode FROM plays GROUP BY player), t AS (SELECT player, mode AS top_mode, count(*) AS top_mode_games FROM plays GROUP BY player, mode QUALIFY row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, mode) = 1) SELECT * FROM x JOIN t USING (player)", "plays")
def a11(spark, sf):
    p = plays(spark, sf)
    got = p.groupBy("player").agg(*record(), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_played"), F.max_by("mode", F.struct("ts", "game")).alias("last_mode"))
    return rounded(got.join(A.mode_of(p, ["player"], "mode"), "player"))


@query("a12_mode_rollup", f"SELECT CASE WHEN grouping(mode) = 1 THEN 'overall' ELSE mode END AS mode, {WL} FROM games GROUP BY ROLLUP (mode)", "games")
def a12(spark, sf):
    got = A.cube(games(spark, sf), ["mode"], [["mode"], []], record())
    return rounded(got.withColumn("mode", F.when(F.col("level") == 1, "overall").otherwise(F.col("mode"))).drop("level"))


@query("a14_move_table", "WITH c AS (SELECT segment, count(*) AS games FROM games GROUP BY 1), m AS (SELECT segment, g.game, grp, landed, damage FROM moves JOIN games g USING (game)), t AS (SELECT segment, sum(landed) AS l, sum(damage) AS d, count(DISTINCT game) AS covered FROM m GROUP BY 1) SELECT segment, grp, games, covered, round(sum(landed), 4) AS landed, round(sum(damage), 2) AS damage, round(sum(landed) / any_value(l), 6) AS landed_share, round(sum(damage) / any_value(d), 6) AS damage_share, round(sum(landed) / covered, 6) AS landed_per_game FROM m JOIN t USING (segment) JOIN c USING (segment) GROUP BY segment, grp, games, covered", "games", "moves")
def a14(spark, sf):
    g = games(spark, sf)
    m = moves(spark, sf).join(g.select("game", "segment"), "game")
    got = A.move_table(m, g, ["segment"], "game", "grp")
    return rounded(got.withColumns({"landed": F.round("landed", 4), "damage": F.round("damage", 2)}))


@query("a15_profile", "WITH d AS (SELECT player, mode, count(*) AS n, count(w) AS decided, avg(w) AS r FROM plays GROUP BY ALL), b AS (SELECT player, arg_max(mode, (r, n, mode)) AS favourite FROM d WHERE decided >= 10 GROUP BY 1), m AS (SELECT player, arg_max(mode, (n, mode)) AS played FROM d GROUP BY 1), y AS (SELECT player, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM plays GROUP BY ALL), z AS (SELECT player, arg_max(day, (n, day)) AS busiest, max(n) AS busiest_games, count(*) AS days FROM y GROUP BY 1) SELECT player, coalesce(favourite, played) AS favourite, busiest, busiest_games, days FROM m JOIN z USING (player) LEFT JOIN b USING (player)", "plays")
def a15(spark, sf):
    p = plays(spark, sf)
    d = p.groupBy("player", "mode").agg(F.count("*").alias("n"), F.count("w").alias("decided"), F.avg("w").alias("r"))
    pick = d.groupBy("player").agg(F.max_by("mode", F.when(F.col("decided") >= 10, F.struct("r", "n", "mode"))).alias("best"), F.max_by("mode", F.struct("n", "mode")).alias("played"))
    y = p.groupBy("player", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    z = y.groupBy("player").agg(F.max_by("day", F.struct("n", "day")).alias("busiest"), F.max("n").alias("busiest_games"), F.count("*").alias("days"))
    return pick.join(z, "player").select("player", F.coalesce("best", "played").alias("favourite"), "busiest", "busiest_games", "days")


@query("a18_distinct_explode", f"WITH x AS (SELECT DISTINCT game, kind FROM moves) SELECT kind, {WL} FROM x JOIN games USING (game) GROUP BY kind", "games", "moves")
def a18(spark, sf):
    sets = moves(spark, sf).groupBy("game").agg(F.collect_set("kind").alias("kinds"))
    return rounded(group_rows(games(spark, sf).join(sets, "game").withColumn("kind", F.explode("kinds")), ["kind"]))


@query("a20_matrix_damage", "WITH x AS (SELECT l_orderkey % 50 AS player, l_linenumber AS a, l_suppkey % 2 AS side, l_extendedprice AS d FROM lineitem) SELECT player, round(sum(d) FILTER (side = 0), 2) AS enemy, round(sum(d) FILTER (side = 1), 2) AS friendly, round(sum(d) FILTER (side = 1) / nullif(sum(d), 0), 6) AS focus_share FROM x GROUP BY player")
def a20(spark, sf):
    x = load(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("player"), (F.col("l_suppkey") % 2).alias("side"), F.col("l_extendedprice").alias("d"))
    enemy, friendly = F.sum(F.when(F.col("side") == 0, F.col("d"))), F.sum(F.when(F.col("side") == 1, F.col("d")))
    return x.groupBy("player").agg(F.round(enemy, 2).alias("enemy"), F.round(friendly, 2).alias("friendly"), F.round(S.ratio(friendly, F.sum("d")), 6).alias("focus_share"))


@query("a22_weekly", f"SELECT strftime(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER), '%Y-%m-%d') AS week, {WL} FROM games GROUP BY 1", "games")
def a22(spark, sf):
    return rounded(group_rows(games(spark, sf).withColumn("week", F.date_format(S.week_start(F.col("ts")), "yyyy-MM-dd")), ["week"]))


@query("a25_last_n", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts DESC, game DESC) AS r FROM plays) SELECT player, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value) FILTER (w = 1) / nullif(sum(value), 0), 6) AS share FROM x WHERE r <= 50 GROUP BY player", "plays")
def a25(spark, sf):
    last = Window.partitionBy("player").orderBy(F.desc("ts"), F.desc("game"))
    x = plays(spark, sf).withColumn("r", F.row_number().over(last)).where("r <= 50")
    return rounded(x.groupBy("player").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), S.ratio(F.sum(F.when(F.col("w") == 1, F.col("value"))), F.sum("value")).alias("share")))


@query("a26_map_sum", "SELECT p_type AS family, p_brand AS option, count(*) AS games, CAST(sum(p_size) AS BIGINT) AS attempts, CASE WHEN count(*) FILTER (p_size < 2) = 0 THEN CAST(sum(p_size) AS BIGINT) END AS strict FROM part GROUP BY ALL")
def a26(spark, sf):
    p = load(spark, sf, "part").select("p_type", F.create_map("p_brand", "p_size").alias("options"))
    long = p.select(F.col("p_type").alias("family"), F.explode("options").alias("option", "n"))
    known = F.when(F.col("n") >= 2, F.col("n"))
    return long.groupBy("family", "option").agg(F.count("*").alias("games"), F.sum("n").alias("attempts"), F.when(F.count(known) == F.count("*"), F.sum(known)).alias("strict"))


@query("a30_grouping_sets", "SELECT nation, segment, mode, CAST(grouping(nation) * 4 + grouping(segment) * 2 + grouping(mode) AS BIGINT) AS level, count(DISTINCT game) AS n_games, count(DISTINCT player) AS players, count(*) FILTER (w = 1) AS wins FROM games WHERE w IS NOT NULL GROUP BY GROUPING SETS ((nation), (nation, segment), (nation, mode), (nation, segment, mode))", "games")
def a30(spark, sf):
    g = games(spark, sf).where("w IS NOT NULL")
    sets = [["nation"], ["nation", "segment"], ["nation", "mode"], ["nation", "segment", "mode"]]
    return A.cube(g, ["nation", "segment", "mode"], sets, [F.count_distinct("game").alias("n_games"), F.count_distinct("player").alias("players"), F.count(F.when(F.col("w") == 1, 1)).alias("wins")])


@query("a35_two_level_quartiles", "WITH p AS (SELECT segment, player, avg(amount) AS m FROM games GROUP BY ALL) SELECT segment, count(*) AS players, round(quantile_cont(m, 0.25), 4) AS p25, round(quantile_cont(m, 0.5), 4) AS p50, round(quantile_cont(m, 0.75), 4) AS p75 FROM p GROUP BY segment", "games")
def a35(spark, sf):
    p = games(spark, sf).groupBy("segment", "player").agg(F.avg("amount").alias("m"))
    q = p.groupBy("segment").agg(F.count("*").alias("players"), F.percentile("m", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    return q.select("segment", "players", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))))


@query("a38_archive_cube", "WITH s AS (SELECT *, unnest(CASE WHEN amount > 150000 THEN ['broad', 'conservative'] ELSE ['broad'] END) AS population FROM games) SELECT population, nation, segment, mode, CAST(grouping(nation) * 4 + grouping(segment) * 2 + grouping(mode) AS BIGINT) AS level, count(*) AS games, count(*) FILTER (w = 1) AS wins, round(sum(amount), 2) AS amount FROM s GROUP BY GROUPING SETS ((population), (population, nation), (population, nation, segment), (population, nation, mode), (population, nation, segment, mode))", "games")
def a38(spark, sf):
    g = games(spark, sf)
    # leaves first: sums compose, so the cube expands cells rather than games
    leaf = g.groupBy("nation", "segment", "mode", (F.col("amount") > 150000).alias("strict")).agg(F.count("*").alias("g"), F.count(F.when(F.col("w") == 1, 1)).alias("k"), F.sum("amount").alias("a"))
    leaf = leaf.withColumn("population", F.explode(F.when(F.col("strict"), F.array(F.lit("broad"), F.lit("conservative"))).otherwise(F.array(F.lit("broad")))))
    dims = ["population", "nation", "segment", "mode"]
    sets = [dims[:1], dims[:2], dims[:3], ["population", "nation", "mode"], dims]
    return A.cube(leaf, dims, sets, [F.sum("g").alias("games"), F.sum("k").alias("wins"), F.round(F.sum("a"), 2).alias("amount")])


@query("a39_balanced", "WITH p AS (SELECT segment, player, sum(landed) AS n, sum(damage) AS d, count(*) AS g FROM (SELECT g.segment, g.player, m.* EXCLUDE (player) FROM moves m JOIN games g USING (game)) GROUP BY ALL HAVING count(*) >= 10 AND sum(damage) >= 1000) SELECT segment, count(*) AS players, round(avg(n / d), 8) AS mean, round(quantile_cont(n / d, 0.25), 8) AS p25, round(quantile_cont(n / d, 0.5), 8) AS p50, round(quantile_cont(n / d, 0.75), 8) AS p75 FROM p GROUP BY segment", "games", "moves")
def a39(spark, sf):
    m = moves(spark, sf).join(games(spark, sf).select("game", "segment"), "game")
    return rounded(A.balanced(m, ["segment"], "player", "landed", "damage", 10, 1000.0), 8)


@query("a40_cube8_coverage", f"WITH {MEASURED} SELECT nation, segment, mode, CAST(grouping(nation) * 4 + grouping(segment) * 2 + grouping(mode) AS BIGINT) AS level, count(*) AS player_games, count(DISTINCT game) AS distinct_games, count(damage) AS covered, round(sum(amount) FILTER (damage IS NOT NULL), 2) AS covered_amount FROM j GROUP BY CUBE (nation, segment, mode)", "games", "moves")
def a40(spark, sf):
    """Leaves hold one row for each game, so the levels count games and not rows."""
    covered = F.col("damage").isNotNull()
    leaves = measured(spark, sf).groupBy("nation", "segment", "mode", "game").agg(F.count("*").alias("n"), F.count("damage").alias("covered"), F.sum(F.when(covered, F.col("amount"))).alias("amount"))
    return leaves.cube("nation", "segment", "mode").agg(F.grouping_id().cast("long").alias("level"), F.sum("n").alias("player_games"), F.count_distinct("game").alias("distinct_games"), F.sum("covered").alias("covered"), F.round(F.sum("amount"), 2).alias("covered_amount"))


@query("a47_gap_fill", "WITH c AS (SELECT segment, CAST(year(ts) AS INTEGER) AS year, count(*) AS n FROM games GROUP BY ALL HAVING count(*) >= 40 AND 2 * sum(w) >= count(w)), s AS (SELECT segment, unnest(range(min(year), max(year) + 1))::INTEGER AS year FROM c GROUP BY segment) SELECT segment, year, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (segment, year)", "games")
def a47(spark, sf):
    c = games(spark, sf).groupBy("segment", F.year("ts").alias("year")).agg(F.count("*").alias("n"), (2 * F.sum("w") >= F.count("w")).alias("half")).where("n >= 40 AND half").drop("half")
    return A.gap_fill(c, ["segment"], "year", "n")


@query("a48_composition", "SELECT p_type AS edition, p_brand AS main, count(*) AS n, array_to_string(list(p_name ORDER BY p_size, p_name)[1:3], ';') AS first_three FROM part GROUP BY ALL")
def a48(spark, sf):
    part = load(spark, sf, "part").select(F.col("p_type").alias("edition"), F.col("p_brand").alias("main"), "p_size", "p_name")
    ranked = part.withColumn("r", F.row_number().over(Window.partitionBy("edition", "main").orderBy("p_size", "p_name")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_size", "p_name"))), lambda x: x["p_name"])  # three of them
    top = ranked.where("r <= 3").groupBy("edition", "main").agg(F.array_join(names, ";").alias("first_three"))
    return part.groupBy("edition", "main").agg(F.count("*").alias("n")).join(top, ["edition", "main"])


@query("a49_fold_other", "SELECT p_type AS edition, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN p_brand ELSE 'Other' END AS brand, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_type), 6) AS share FROM part GROUP BY 1, 2")
def a49(spark, sf):
    folded = A.fold_other(load(spark, sf, "part").select(F.col("p_type").alias("edition"), F.col("p_brand").alias("brand")), "brand", ["Brand#11", "Brand#12", "Brand#13"])
    n = folded.groupBy("edition", "brand").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("edition"))))


@query("a50_latest_win", "SELECT mode, count(*) AS wins, strftime(max(ts), '%Y-%m-%d') AS last_win, arg_max(game, (ts, game)) AS last_game FROM games WHERE w = 1 GROUP BY mode", "games")
def a50(spark, sf):
    return games(spark, sf).where("w = 1").groupBy("mode").agg(F.count("*").alias("wins"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_win"), F.max_by("game", F.struct("ts", "game")).alias("last_game"))


@query("a51_leaderboard", "SELECT player, count(*) AS titles, strftime(min(ts), '%Y-%m-%d') AS first_win, strftime(max(ts), '%Y-%m-%d') AS last_win, round(sum(amount), 2) AS earnings FROM games WHERE w = 1 GROUP BY player ORDER BY titles DESC, earnings DESC LIMIT 100", "games")
def a51(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    got = games(spark, sf).where("w = 1").groupBy("player").agg(F.count("*").alias("titles"), day(F.min("ts")).alias("first_win"), day(F.max("ts")).alias("last_win"), F.round(F.sum("amount"), 2).alias("earnings"))
    return got.orderBy(F.desc("titles"), F.desc("earnings")).limit(100)


@query("a52_dupes", "SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def a52(spark, sf):
    n = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("duplicates"))


@query("a53_reasons", "SELECT CASE WHEN user_id % 10 = 0 THEN 'noCode' WHEN event_type = 'error' THEN 'unsupported' WHEN value < 10 THEN 'filters' ELSE 'included' END AS reason, count(*) AS n FROM events GROUP BY 1")
def a53(spark, sf):
    reason = S.first_reason((F.col("user_id") % 10 == 0, "noCode"), (F.col("event_type") == "error", "unsupported"), (F.col("value") < 10, "filters"))
    return load(spark, sf, "events").groupBy(F.coalesce(reason, F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


@query("p01_suppress", f"SELECT * FROM (SELECT nation, mode, {WL}, count(DISTINCT player) AS players FROM games GROUP BY ALL) WHERE games >= 100 AND players >= 25", "games")
def p01(spark, sf):
    cells = games(spark, sf).groupBy("nation", "mode").agg(*record(), F.count_distinct("player").alias("players"))
    return rounded(A.suppress(cells, {"games": 100, "players": 25}))


@query("p02_coarsen", "SELECT nation, mode, round(count(*) / 25) * 25 AS games, greatest(1, round(count(DISTINCT player) / 5) * 5) AS players, round(avg(w), 3) AS rate FROM games GROUP BY ALL HAVING count(*) >= 100 AND count(DISTINCT player) >= 25", "games")
def p02(spark, sf):
    cells = A.suppress(games(spark, sf).groupBy("nation", "mode").agg(F.count("*").alias("n"), F.count_distinct("player").alias("p"), F.avg("w").alias("r")), {"n": 100, "p": 25})
    return cells.select("nation", "mode", S.coarsen(F.col("n"), 25).alias("games"), F.greatest(F.lit(1.0), S.coarsen(F.col("p"), 5)).alias("players"), F.round("r", 3).alias("rate"))


@query("p04_sparse", "WITH c AS (SELECT nation, mode, CAST(grouping(nation) * 2 + grouping(mode) AS BIGINT) AS level, count(*) AS games FROM games GROUP BY CUBE (nation, mode)) SELECT * FROM c WHERE level = 3 OR games >= CASE level WHEN 0 THEN 25 ELSE 100 END", "games")
def p04(spark, sf):
    c = games(spark, sf).cube("nation", "mode").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("games"))
    return c.where((F.col("level") == 3) | (F.col("games") >= F.when(F.col("level") == 0, 25).otherwise(100)))
