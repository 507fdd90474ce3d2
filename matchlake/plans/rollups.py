"""Community and archive rollups, eligibility, coverage and alignment over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.functions import scalar as S
from matchlake.metrics import record
from matchlake.operators import community as C
from matchlake.plans.records import WL
from matchlake.plans.registry import VIEWS, games, moves, plays, query, rounded
from matchlake.session import load

# Orders as uploaded games: two codes, an owner, a pack version, an error for some; execution counts with an optional one.
VIEWS["uploads"] = """uploads AS (SELECT o_orderkey AS game, o_custkey % 60 AS owner, o_orderkey % 5 AS pack_version, o_orderkey % 9 = 0 AS is_teams, CASE WHEN o_orderkey % 17 = 0 THEN 'bad' END AS error, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderdate END AS ts,
  o_orderkey % 8 AS stage, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS w, 'P' || (o_custkey % 60) AS p1, 'P' || (o_orderkey % 60) AS p2, o_custkey % 12 AS ch, o_orderkey % 41 AS hit, o_orderkey % 7 AS miss, o_totalprice % 100 AS ipm,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 END AS crouch, o_orderpriority AS mode, o_totalprice / 100 AS seconds FROM orders)"""


def uploads(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return load(spark, sf, "orders").select(
        k.alias("game"), (c % 60).alias("owner"), (k % 5).alias("pack_version"), (k % 9 == 0).alias("is_teams"), F.when(k % 17 == 0, "bad").alias("error"), F.when(k % 23 != 0, F.col("o_orderdate")).alias("ts"),
        (k % 8).alias("stage"), w.alias("w"), F.concat(F.lit("P"), c % 60).alias("p1"), F.concat(F.lit("P"), k % 60).alias("p2"), (c % 12).alias("ch"), (k % 41).alias("hit"), (k % 7).alias("miss"), (F.col("o_totalprice") % 100).alias("ipm"),
        F.when(k % 3 == 0, k % 6).alias("crouch"), F.col("o_orderpriority").alias("mode"), (F.col("o_totalprice") / 100).alias("seconds"),
    )


ELIGIBLE = "e AS (SELECT * FROM uploads WHERE pack_version >= 3 AND NOT is_teams AND error IS NULL AND ts IS NOT NULL AND stage IN (1, 2, 3, 5) AND owner % 4 <> 0 AND ((p1 = 'P' || owner)::INT + (p2 = 'P' || owner)::INT) = 1)"


def _eligible(spark, sf):
    u = uploads(spark, sf).withColumn("players", F.array("p1", "p2"))
    owners = u.select("owner").distinct()
    consent = owners.withColumn("enabled", F.col("owner") % 4 != 0)
    return C.eligible(u, consent, owners.withColumn("codes", F.array(F.concat(F.lit("P"), "owner"))), "owner", 3, [1, 2, 3, 5])


END = "TIMESTAMP '1998-08-02'"


def _windowed(spark, sf):
    return C.with_lookbacks(_eligible(spark, sf), "ts", F.lit("1998-08-02").cast("timestamp_ntz"), [30, 365, None])


WINDOWED = f"{ELIGIBLE}, x AS (SELECT e.*, d AS lookback FROM e, (VALUES (30), (365), (NULL)) p(d) WHERE d IS NULL OR ts >= {END} - to_days(d::INTEGER))"


@query("f20_eligible", f"WITH {ELIGIBLE} SELECT owner, count(*) AS n, min(game) AS first FROM e GROUP BY owner", "uploads")
def f20(spark, sf):
    return _eligible(spark, sf).groupBy("owner").agg(F.count("*").alias("n"), F.min("game").alias("first"))


@query("a31_benchmark", f"WITH {ELIGIBLE} SELECT CASE WHEN grouping(ch) = 1 THEN -1 ELSE ch END AS ch, count(*) AS games, count(DISTINCT game) AS unique_games, round(100.0 * sum(hit) / nullif(sum(hit + miss), 0), 6) AS pooled, round(avg(ipm), 6) AS ipm FROM e GROUP BY GROUPING SETS ((ch), ()) HAVING count(*) >= 5", "uploads")
def a31(spark, sf):
    return rounded(C.benchmark(_eligible(spark, sf), "ch", ["game"], "hit", ["hit", "miss"], ["ipm"], 5))


@query("a32_execution", f"WITH {WINDOWED} SELECT lookback, CASE WHEN grouping(ch) = 1 THEN -1 ELSE ch END AS ch, count(*) AS games, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(miss) AS BIGINT) AS miss, count(crouch) AS crouch_games, CAST(sum(crouch) AS BIGINT) AS crouch FROM x GROUP BY lookback, GROUPING SETS ((ch), ())", "uploads")
def a32(spark, sf):
    return C.executions(_windowed(spark, sf), "ch", ["hit", "miss"], "crouch")


GROUP = "CASE WHEN l_linenumber IN (1, 2) THEN 'jab' WHEN l_linenumber = 3 THEN 'dash' WHEN l_linenumber BETWEEN 4 AND 5 THEN 'tilt' ELSE 'other' END"


@query("a33_move_rollup", f"WITH {WINDOWED}, m AS (SELECT l_orderkey AS game, {GROUP} AS move, sum(l_quantity) AS landed, sum(l_extendedprice) AS damage, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity + 1 END) AS attempts, bool_or(l_returnflag <> 'N') AS has FROM lineitem GROUP BY ALL), t AS (SELECT lookback, ch, count(*) AS games FROM x GROUP BY ALL) SELECT x.lookback, x.ch, move, any_value(t.games) AS games, count(*) AS move_games, round(sum(landed), 4) AS landed, round(sum(damage), 2) AS damage, round(sum(attempts) FILTER (has), 4) AS attempts, count(*) FILTER (has) AS attempt_games FROM x JOIN m USING (game) JOIN t ON t.ch = x.ch AND t.lookback IS NOT DISTINCT FROM x.lookback GROUP BY x.lookback, x.ch, move", "uploads")
def a33(spark, sf):
    """Moves are collapsed once per game before the look-backs multiply the narrow rows."""
    line = F.col("l_linenumber")
    group = F.when(line.isin(1, 2), "jab").when(line == 3, "dash").when(line.between(4, 5), "tilt").otherwise("other")
    raw = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game"), "l_linenumber", F.col("l_quantity").alias("landed"), F.col("l_extendedprice").alias("damage"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity") + 1).alias("attempts"))
    per = C.moves_per_game(raw, ["game"], group, ["landed", "damage"], "attempts")
    x = _windowed(spark, sf).select("game", "lookback", "ch")
    totals = x.groupBy("lookback", "ch").agg(F.count("*").alias("games"))
    got = C.move_rollup(x.join(per, "game"), totals, ["lookback", "ch"], ["landed", "damage"], "attempts")
    return got.withColumns({"landed": F.round("landed", 4), "damage": F.round("damage", 2), "attempts": F.round("attempts", 4)})


@query("a34_months", f"WITH {ELIGIBLE} SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS games, round(sum(seconds), 2) AS seconds, count(*) FILTER (mode = '1-URGENT') AS urgent, count(*) FILTER (mode = '5-LOW') AS low FROM e GROUP BY 1", "uploads")
def a34_months(spark, sf):
    mode = lambda m, name: F.count_if(F.col("mode") == m).alias(name)
    return _eligible(spark, sf).groupBy(F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month")).agg(F.count("*").alias("games"), F.round(F.sum("seconds"), 2).alias("seconds"), mode("1-URGENT", "urgent"), mode("5-LOW", "low"))


@query("a34_characters", f"WITH {WINDOWED} SELECT lookback, ch, count(*) AS games, count(DISTINCT game) AS unique_games, count(*) FILTER (w = 1) AS wins, count(w) AS decided FROM x GROUP BY lookback, ch", "uploads")
def a34_characters(spark, sf):
    return _windowed(spark, sf).groupBy("lookback", "ch").agg(F.count("*").alias("games"), F.count_distinct("game").alias("unique_games"), F.count_if(F.col("w") == 1).alias("wins"), F.count("w").alias("decided"))


@query("a34_stages", f"WITH {ELIGIBLE} SELECT stage, count(*) AS games, round(sum(seconds), 2) AS seconds FROM e GROUP BY stage", "uploads")
def a34_stages(spark, sf):
    return _eligible(spark, sf).groupBy("stage").agg(F.count("*").alias("games"), F.round(F.sum("seconds"), 2).alias("seconds"))


@query("a36_members", "SELECT game, len(list_distinct(list_filter(flatten([[p1, p2], [p1, ''], [mode]]), lambda x: x <> ''))) AS members FROM uploads", "uploads")
def a36(spark, sf):
    sets = F.array(F.array("p1", "p2"), F.array("p1", F.lit("")), F.array("mode"))
    return uploads(spark, sf).select("game", C.count_members(sets).cast("long").alias("members"))


@query("a37_contributions", f"WITH {ELIGIBLE} SELECT count(DISTINCT owner) AS owners, round(2 * count(DISTINCT game) / 500.0) * 500 AS games FROM e", "uploads")
def a37(spark, sf):
    got = _eligible(spark, sf).agg(F.count_distinct("owner").alias("owners"), F.count_distinct("game").alias("n"))
    return got.select("owners", S.coarsen(2 * F.col("n"), 500).alias("games"))


@query("a06_optional_count", "SELECT game, CASE WHEN crouch IS NULL THEN NULL WHEN crouch > 4 THEN NULL WHEN crouch = 1 THEN 0 ELSE crouch END AS n FROM uploads", "uploads")
def a06(spark, sf):
    """Null where the family is unmeasured or the count invalid, zero where it is measured without the key."""
    family = F.when(F.col("crouch").isNotNull(), F.map_from_arrays(F.array(F.when(F.col("crouch") != 1, "ledgedash").otherwise("other")), F.array("crouch")))
    return uploads(spark, sf).select("game", S.optional_count(family, "ledgedash", 4).alias("n"))


@query("a09_stage_character", f"SELECT segment, nation, {WL} FROM games GROUP BY segment, nation", "games")
def a09(spark, sf):
    return rounded(games(spark, sf).groupBy("segment", "nation").agg(*record()))


@query("a13_by_account", f"WITH c AS (SELECT player % 40 AS account, nation, count(*) AS n, min(game) AS f FROM games GROUP BY ALL), t AS (SELECT account, arg_max(nation, (n, -f)) AS top FROM c GROUP BY account), g AS (SELECT player % 40 AS account, {WL}, round(avg(amount), 4) AS mean_amount, strftime(max(ts), '%Y-%m-%d') AS last FROM games GROUP BY 1) SELECT g.*, top FROM g JOIN t USING (account)", "games")
def a13(spark, sf):
    g = games(spark, sf).withColumn("account", F.col("player") % 40)
    chars = g.groupBy("account", "nation").agg(F.count("*").alias("n"), F.min("game").alias("f"))
    top = chars.groupBy("account").agg(F.max_by("nation", F.struct(F.col("n"), -F.col("f"))).alias("top"))
    got = g.groupBy("account").agg(*record(), F.round(F.avg("amount"), 4).alias("mean_amount"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last"))
    return rounded(got.join(top, "account"))


@query("a27_analysis_coverage", "SELECT mode, count(*) FILTER (crouch IS NULL AND pack_version >= 3) AS needs, count(*) FILTER (crouch IS NULL AND pack_version < 3) AS unavailable FROM uploads GROUP BY mode", "uploads")
def a27(spark, sf):
    missing = F.col("crouch").isNull()
    return uploads(spark, sf).groupBy("mode").agg(F.count_if(missing & (F.col("pack_version") >= 3)).alias("needs"), F.count_if(missing & (F.col("pack_version") < 3)).alias("unavailable"))


# Outcome counters of a line: attempts split into punished, hit, traded, no hit and incomplete.
COUNTS = "c AS (SELECT l_returnflag AS family, l_linenumber % 4 AS option, sum(CAST(l_quantity AS BIGINT)) AS attempts, sum(CAST(l_quantity AS BIGINT) // 5) AS punished, sum(CAST(l_quantity AS BIGINT) // 4) AS hit, sum(CAST(l_quantity AS BIGINT) // 7) AS traded, sum(CAST(l_quantity AS BIGINT) // 9) AS incomplete FROM lineitem GROUP BY ALL)"


def _counts(spark, sf):
    q = F.col("l_quantity").cast("long")
    part = lambda d, name: F.sum(F.floor(q / d)).alias(name)
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("family"), (F.col("l_linenumber") % 4).alias("option")).agg(F.sum(q).alias("attempts"), part(5, "punished"), part(4, "hit"), part(7, "traded"), part(9, "incomplete"))


@query("a28_interaction_rates", f"WITH {COUNTS} SELECT family, option, round(attempts / sum(attempts) OVER (PARTITION BY family), 6) AS usage_share, round((punished + traded) / nullif(attempts - incomplete, 0), 6) AS caught_rate, round((hit + traded) / nullif(attempts - incomplete, 0), 6) AS landed_rate, round((attempts - incomplete - punished - hit - traded) / nullif(attempts - incomplete, 0), 6) AS no_hit_rate FROM c")
def a28(spark, sf):
    return rounded(S.interaction_rates(_counts(spark, sf), ["family"], ["option"]))


@query("a29_select_merge", f"WITH {COUNTS} SELECT family, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(hit) AS BIGINT) AS hit FROM c GROUP BY family UNION ALL SELECT NULL, CAST(sum(attempts) AS BIGINT), CAST(sum(hit) AS BIGINT) FROM c")
def a29(spark, sf):
    """A null dimension stands for all of it."""
    got = _counts(spark, sf).rollup("family").agg(F.sum("attempts").alias("attempts"), F.sum("hit").alias("hit"))
    return got


@query("f16_valid_counts", f"WITH {COUNTS} SELECT family, option FROM c WHERE attempts < 0 OR CASE WHEN option = 3 THEN 3 ELSE 1 END * punished + hit + traded + incomplete > attempts")
def f16(spark, sf):
    """Cells whose parts do not fit their whole (those of one option have been tripled)."""
    c = _counts(spark, sf).withColumn("punished", F.col("punished") * F.when(F.col("option") == 3, 3).otherwise(1))
    return c.where((F.col("attempts") < 0) | (F.col("punished") + F.col("hit") + F.col("traded") + F.col("incomplete") > F.col("attempts"))).select("family", "option")


@query("a43_recompute", "WITH e AS (SELECT ch, count(*) AS games, CAST(sum(hit) AS BIGINT) AS hit FROM uploads GROUP BY ch), a AS (SELECT ch, games, hit + CASE WHEN ch = 3 THEN 1 ELSE 0 END AS hit FROM e) SELECT 'export' AS side, * FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT 'again', * FROM (SELECT * FROM a EXCEPT SELECT * FROM e)", "uploads")
def a43(spark, sf):
    """An export against a recomputation by another way, in which one cell has been changed: both sides show it."""
    u = uploads(spark, sf)
    export = u.groupBy("ch").agg(F.count("*").alias("games"), F.sum("hit").alias("hit"))
    again = u.groupBy("ch", "mode").agg(F.count("*").alias("games"), F.sum("hit").alias("hit")).groupBy("ch").agg(F.sum("games").alias("games"), F.sum("hit").alias("hit"))
    changed = again.withColumn("hit", F.col("hit") + F.when(F.col("ch") == 3, 1).otherwise(0))
    return C.recompute_differs(export, changed)


@query("a44_reaggregate", "WITH r AS (SELECT ch, mode, count(*) AS games, sum(hit) AS hit, CASE WHEN any_value(mode) <> '5-LOW' THEN sum(crouch) END AS crouch FROM uploads GROUP BY ch, mode) SELECT ch, CAST(sum(games) AS BIGINT) AS games, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(crouch) AS BIGINT) AS crouch FROM r GROUP BY ch", "uploads")
def a44(spark, sf):
    r = uploads(spark, sf).groupBy("ch", "mode").agg(F.count("*").alias("games"), F.sum("hit").alias("hit"), F.sum("crouch").alias("_c")).withColumn("crouch", F.when(F.col("mode") != "5-LOW", F.col("_c")))
    return C.reaggregate(r, ["ch"], ["games", "hit"], ["crouch"])


@query("a45_grouped_moves", f"SELECT l_returnflag AS cohort, {GROUP} AS move, round(sum(l_quantity), 2) AS landed, round(sum(CASE WHEN l_linenumber > 3 THEN l_tax END), 6) AS tax FROM lineitem GROUP BY 1, 2")
def a45(spark, sf):
    """Raw moves added up by group; an optional field only where some move of the group has it."""
    line = F.col("l_linenumber")
    group = F.when(line.isin(1, 2), "jab").when(line == 3, "dash").when(line.between(4, 5), "tilt").otherwise("other")
    x = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cohort"), group.alias("move"), "l_quantity", F.when(line > 3, F.col("l_tax")).alias("tax"))
    got = x.groupBy("cohort", "move").agg(F.round(F.sum("l_quantity"), 2).alias("landed"), F.round(F.sum("tax"), 6).alias("tax"))
    return got


@query("a46_move_metric", "WITH m AS (SELECT grp, kind, sum(landed) AS landed, count(*) AS n FROM moves GROUP BY ALL HAVING count(*) >= 400), k AS (SELECT count(DISTINCT kind) AS kinds FROM moves) SELECT grp, CASE WHEN count(DISTINCT kind) < any_value(kinds) THEN NULL ELSE round(sum(landed) / sum(n), 6) END AS per_game FROM m, k GROUP BY grp", "moves")
def a46(spark, sf):
    """A per-game figure only where every kind has its cell published, that is 400 moves or more."""
    m = moves(spark, sf)
    cells = m.groupBy("grp", "kind").agg(F.sum("landed").alias("landed"), F.count("*").alias("n")).where("n >= 400")
    kinds = m.agg(F.count_distinct("kind").alias("kinds"))
    got = cells.crossJoin(F.broadcast(kinds)).groupBy("grp").agg(F.count_distinct("kind").alias("have"), F.first("kinds").alias("kinds"), (F.sum("landed") / F.sum("n")).alias("x"))
    return rounded(got.select("grp", F.when(F.col("have") == F.col("kinds"), F.col("x")).alias("per_game")))


@query("a54_options", "WITH k AS (SELECT s_suppkey AS id, s_nationkey AS year, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier), y AS (SELECT id % 50 AS player, year, rank FROM k), l AS (SELECT player, arg_max(rank, (year, -rank)) AS latest, min(rank) AS best FROM y GROUP BY player), g AS (SELECT player % 50 AS player, nation, count(*) AS n FROM games GROUP BY 1, 2), t AS (SELECT player, arg_max(nation, (n, -nation)) AS main, CAST(sum(n) AS BIGINT) AS games FROM g GROUP BY player) SELECT player, latest, best, main, games FROM l JOIN t USING (player)", "games")
def a54(spark, sf):
    """Latest and best ranking of a player with observed games: both are required."""
    s = load(spark, sf, "supplier")
    k = s.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").alias("year"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long").alias("rank"))
    latest = k.groupBy((F.col("id") % 50).alias("player")).agg(F.max_by("rank", F.struct(F.col("year"), -F.col("rank"))).alias("latest"), F.min("rank").alias("best"))
    g = games(spark, sf).groupBy((F.col("player") % 50).alias("player"), "nation").agg(F.count("*").alias("n"))
    top = g.groupBy("player").agg(F.max_by("nation", F.struct(F.col("n"), -F.col("nation"))).alias("main"), F.sum("n").alias("games"))
    return latest.join(top, "player")


@query("a55_cohort_cells", "WITH s AS (SELECT game, nation, segment, amount, unnest(CASE WHEN amount > 150000 AND nation < 12 THEN ['pro', 'nearby'] WHEN amount > 150000 THEN ['pro'] WHEN nation < 12 THEN ['nearby'] ELSE [] END) AS cohort FROM games) SELECT cohort, nation, segment, count(*) AS n, round(sum(amount), 2) AS amount FROM s GROUP BY ALL", "games")
def a55(spark, sf):
    """A side may enter more than one cohort."""
    cohorts = F.array_compact(F.array(F.when(F.col("amount") > 150000, "pro"), F.when(F.col("nation") < 12, "nearby")))
    return games(spark, sf).withColumn("cohort", F.explode(cohorts)).groupBy("cohort", "nation", "segment").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("a56_size_histogram", "WITH c AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT size, count(*) AS n FROM c GROUP BY size")
def a56(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("a57_conditional_coverage", "SELECT ch, count(*) FILTER (pack_version >= 2 AND crouch IS NOT NULL) AS attempt_games, CAST(sum(crouch) FILTER (pack_version >= 2) AS BIGINT) AS attempts, count(*) FILTER (pack_version >= 2 AND crouch IS NOT NULL AND hit + miss = hit + crouch) AS outcome_games FROM uploads GROUP BY ch", "uploads")
def a57(spark, sf):
    """Counts enter only from versions that measured them, outcomes only where they add up."""
    valid = (F.col("pack_version") >= 2) & F.col("crouch").isNotNull()
    return uploads(spark, sf).groupBy("ch").agg(F.count_if(valid).alias("attempt_games"), F.sum(F.when(valid, F.col("crouch"))).alias("attempts"), F.count_if(valid & (F.col("hit") + F.col("miss") == F.col("hit") + F.col("crouch"))).alias("outcome_games"))


@query("j18_alignment", "WITH l AS (SELECT nation, segment, count(*) AS local_games, round(avg(w), 6) AS local_rate FROM games WHERE ts >= TIMESTAMP '1998-06-01' GROUP BY ALL), r AS (SELECT nation, segment, count(*) AS field_games, round(avg(w), 6) AS field_rate FROM games WHERE ts < TIMESTAMP '1995-02-01' GROUP BY ALL) SELECT coalesce(l.nation, r.nation) AS nation, coalesce(l.segment, r.segment) AS segment, local_games, local_rate, field_games, field_rate FROM l FULL JOIN r ON l.nation = r.nation AND l.segment = r.segment", "games")
def j18(spark, sf):
    """Local rows beside reference rows of the same cell: a missing one stays null, never a broader cell."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    g = games(spark, sf)
    one = lambda rows, name: rows.groupBy("nation", "segment").agg(F.count("*").alias(f"{name}_games"), F.avg("w").alias(f"{name}_rate"))
    return rounded(one(g.where(F.col("ts") >= at("1998-06-01")), "local").join(one(g.where(F.col("ts") < at("1995-02-01")), "field"), ["nation", "segment"], "full"))


@query("p03_metric_suppress", "SELECT nation, count(DISTINCT player) FILTER (w IS NOT NULL) AS players, CASE WHEN count(DISTINCT player) FILTER (w IS NOT NULL) >= 25 THEN round(quantile_cont(amount, 0.5) FILTER (w IS NOT NULL), 4) END AS median FROM games GROUP BY nation", "games")
def p03(spark, sf):
    """A quartile only where enough players have that very metric."""
    known = F.col("w").isNotNull()
    got = games(spark, sf).groupBy("nation").agg(F.count_distinct(F.when(known, F.col("player"))).alias("players"), F.percentile(F.when(known, F.col("amount")), 0.5).alias("m"))
    return got.select("nation", "players", F.when(F.col("players") >= 25, F.round("m", 4)).alias("median"))
