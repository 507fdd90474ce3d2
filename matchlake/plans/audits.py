"""Normalisation, observations, audits, backtests and snapshots over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.operators import audit as A
from matchlake.operators import keeping as K
from matchlake.plans.registry import games, plays, query, rounded
from matchlake.session import load


@query("j08_peer_dirty", "SELECT DISTINCT CAST(b.l_suppkey AS BIGINT) AS peer FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey WHERE CAST(a.l_shipdate AS DATE) >= DATE '1998-06-01'")
def j08(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("long").alias("peer"), F.to_date("l_shipdate").alias("day"))
    return A.other_owners(rows, rows.where("day >= DATE '1998-06-01'"), "l_orderkey", "peer")


@query("k05_attempts", "WITH c AS (SELECT player, count(*) FILTER (mode = 'click') AS a, count(*) FILTER (mode = 'view') AS b, count(*) FILTER (mode = 'purchase') AS d FROM plays GROUP BY player) SELECT player, 'ground' AS attempt, a + b AS n FROM c UNION ALL SELECT player, 'air', d FROM c UNION ALL SELECT player, 'any', a + b + d FROM c", "plays")
def k05(spark, sf):
    """Attempts as sums of a player's action counters."""
    held = lambda mode: F.count_if(F.col("mode") == mode).alias(mode)
    c = plays(spark, sf).groupBy("player").agg(held("click"), held("view"), held("purchase"))
    return c.selectExpr("player", "stack(3, 'ground', click + view, 'air', purchase, 'any', click + view + purchase) AS (attempt, n)")


@query("m01_set_reasons", "WITH x AS (SELECT *, min(coalesce(w, -1)) OVER i <> max(coalesce(w, -1)) OVER i AS clash FROM games WINDOW i AS (PARTITION BY CAST(floor(game / 2) AS BIGINT))), r AS (SELECT array_to_string(list_filter([CASE WHEN game % 25 = nation THEN 'bye' END, CASE WHEN w IS NULL AND amount > 200000 THEN 'unfinished' END, CASE WHEN w IS NULL THEN 'no_winner' END, CASE WHEN clash THEN 'conflict' END], lambda x: x IS NOT NULL), ',') AS reasons FROM x) SELECT reasons, count(*) AS n FROM r GROUP BY reasons", "games")
def m01(spark, sf):
    """Why a set is excluded; rows that share an id and differ in their result conflict."""
    i, result = Window.partitionBy(F.floor(F.col("game") / 2)), F.coalesce("w", F.lit(-1))
    x = games(spark, sf).withColumn("clash", F.min(result).over(i) != F.max(result).over(i))
    open_ = F.col("w").isNull()
    found = K.reasons({"bye": F.col("game") % 25 == F.col("nation"), "unfinished": open_ & (F.col("amount") > 200000), "no_winner": open_, "conflict": F.col("clash")})
    return x.groupBy(F.array_join(found, ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("m11_observations", "WITH o AS (SELECT mode, w, 1.0::DOUBLE / count(*) OVER (PARTITION BY player, year(ts)) AS weight FROM games WHERE w IS NOT NULL AND ts < TIMESTAMP '1997-01-01') SELECT mode, count(*) AS games, round(sum(weight), 6) AS weight, round(sum(weight * w) / sum(weight), 6) AS won FROM o GROUP BY mode", "games")
def m11(spark, sf):
    known = games(spark, sf).where((F.col("ts") < F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("w").isNotNull()).withColumn("year", F.year("ts"))
    o = A.with_set_weights(known, ["player", "year"])
    return rounded(o.groupBy("mode").agg(F.count("*").alias("games"), F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("w")) / F.sum("weight")).alias("won")))


@query("m21_backtest", "WITH y AS (SELECT segment, CAST(year(ts) AS INTEGER) AS event, nation, coalesce(sum(w), 0)::DOUBLE AS wins, count(w)::DOUBLE AS n FROM games GROUP BY ALL), p AS (SELECT segment, event, nation, wins, (coalesce(sum(wins) OVER b, 0) + 0.5::DOUBLE) / (coalesce(sum(n) OVER b, 0) + 1.0::DOUBLE) AS score FROM y WINDOW b AS (PARTITION BY segment, nation ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT *, rank() OVER (PARTITION BY segment, event ORDER BY score DESC) AS predicted, count(*) OVER (PARTITION BY segment, event, score) AS tied, rank() OVER (PARTITION BY segment, event ORDER BY wins DESC) AS actual, row_number() OVER (PARTITION BY segment, event ORDER BY score DESC, nation) AS place FROM p) SELECT segment, event, round(sum(CASE WHEN actual = 1 AND predicted = 1 THEN 1.0::DOUBLE / tied ELSE 0 END) / count(*) FILTER (actual = 1), 6) AS top1, round(count(*) FILTER (actual <= 8 AND place <= 8) / 8.0::DOUBLE, 6) AS precision8, CAST(max(predicted + tied - 1) FILTER (actual = 1) AS BIGINT) AS worst_rank FROM r GROUP BY segment, event", "games")
def m21(spark, sf):
    """Each year's nations, ranked by what the years before tell (with half a win and half a loss added)."""
    y = games(spark, sf).groupBy("segment", F.year("ts").alias("event"), "nation").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("wins"), F.count("w").cast("double").alias("n"))
    before = Window.partitionBy("segment", "nation").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    return rounded(A.backtest(y.withColumn("score", (had("wins") + 0.5) / (had("n") + 1.0)), ["segment", "event"], "nation", "score", "wins"))


@query("m23_dispositions", "WITH e AS (SELECT n_nationkey AS nation, y FROM nation, range(1992, 1999) t(y)), d AS (SELECT nation, year(ts) AS y, count(*) AS n FROM games WHERE w IS NOT NULL GROUP BY ALL) SELECT CASE WHEN nation % 6 = 0 THEN 'excluded' WHEN n IS NULL THEN 'missing' WHEN n < 80 THEN 'partial' ELSE 'complete' END AS status, count(*) AS events, CAST(coalesce(sum(n), 0) AS BIGINT) AS games FROM e LEFT JOIN d USING (nation, y) GROUP BY 1", "games")
def m23(spark, sf):
    """Expected events against delivered games."""
    expected = load(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.sequence(F.lit(1992), F.lit(1998))).alias("year"))
    delivered = games(spark, sf).where("w IS NOT NULL").groupBy("nation", F.year("ts").alias("year")).agg(F.count("*").alias("n"))
    status = F.when(F.col("nation") % 6 == 0, "excluded").when(F.col("n").isNull(), "missing").when(F.col("n") < 80, "partial").otherwise("complete")
    return expected.join(delivered, ["nation", "year"], "left").groupBy(status.alias("status")).agg(F.count("*").alias("events"), F.coalesce(F.sum("n"), F.lit(0)).alias("games"))


@query("m24_receipts", "WITH p AS (SELECT source, CAST(floor(doc_id / 50) AS BIGINT) AS page, count(*) AS n FROM documents GROUP BY ALL) SELECT source, count(*) AS pages, max(page) - min(page) + 1 = count(*) AS gapless, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY source")
def m24(spark, sf):
    return A.page_receipts(load(spark, sf, "documents").select("source", "doc_id"), "source", F.floor(F.col("doc_id") / 50))


@query("m26_attach", "WITH s AS (SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, p_brand FROM part) SELECT slug, count(DISTINCT p_brand) AS majors, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS major FROM s GROUP BY slug")
def m26(spark, sf):
    """A slug is attached to its major if it names one only."""
    pairs = load(spark, sf, "part").select(A.slug(F.col("p_type")).alias("slug"), "p_brand").distinct()
    return pairs.groupBy("slug").agg(F.count("p_brand").alias("majors"), F.when(F.count("p_brand") == 1, F.min("p_brand")).alias("major"))


@query("m29_integrity", "WITH x AS (SELECT segment, CAST(year(ts) AS INTEGER) AS event, amount, round(amount / sum(amount) OVER (PARTITION BY segment, year(ts)), 4) AS t FROM games) SELECT segment, event, count(*) AS players, abs(sum(t) - 1) <= 1e-4 AS title_ok, abs(sum(least(1.0::DOUBLE, 8 * t)) - least(8, count(*))) <= 1e-4 AS top8_ok FROM x GROUP BY segment, event", "games")
def m29(spark, sf):
    """Shares rounded to four places as forecasts: the sums show in which events too much was lost."""
    g = games(spark, sf).select("segment", F.year("ts").alias("event"), "game", "amount")
    totals = g.groupBy("segment", "event").agg(F.sum("amount").alias("total"))
    shares = g.join(totals, ["segment", "event"]).withColumn("t", F.round(F.col("amount") / F.col("total"), 4))
    return A.forecast_integrity(shares, ["segment", "event"], "t")


@query("a58_lookbacks", "WITH p AS (SELECT unnest([30, 90, 180, 365, NULL]) AS days) SELECT days, mode, count(*) AS games, CAST(sum(w) AS BIGINT) AS wins FROM games JOIN p ON days IS NULL OR ts >= TIMESTAMP '1998-07-01 12:34:56' - days * INTERVAL 1 DAY WHERE w IS NOT NULL GROUP BY ALL", "games")
def a58(spark, sf):
    """Look-backs end now, not at midnight."""
    now = F.lit("1998-07-01 12:34:56").cast("timestamp_ntz")
    return A.in_periods(games(spark, sf).where("w IS NOT NULL"), ["mode"], "ts", now, [30, 90, 180, 365], {"games": F.count("*"), "wins": F.sum("w")})


@query("a59_named", "WITH a AS (SELECT 'a' || (c_custkey % 1000) AS alias, c_custkey, c_acctbal FROM customer), u AS (SELECT alias, min(c_custkey) AS identity, max(c_acctbal) AS bal FROM a GROUP BY alias HAVING count(*) = 1) SELECT o_orderstatus AS stage, count(*) AS games, count(DISTINCT identity) AS named FROM orders JOIN a ON o_custkey = c_custkey JOIN u USING (alias) WHERE u.bal > 0 GROUP BY 1")
def a59(spark, sf):
    """Games of ranked players whose alias names one identity."""
    a = load(spark, sf, "customer").select(F.concat(F.lit("a"), F.col("c_custkey") % 1000).alias("alias"), F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    one = a.groupBy("alias").agg(F.count("*").alias("n"), F.max("o_custkey").alias("o_custkey"), F.max("c_acctbal").alias("bal")).where("n = 1 AND bal > 0")
    named = load(spark, sf, "orders").join(one, "o_custkey")
    return named.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("games"), F.count_distinct("o_custkey").alias("named"))


#: Features of a game for the win model: SQL expressions by name.
FEATURES = {"won": "w", "decided": "CAST(w IS NOT NULL AS INT)", "amount": "amount / 1000", "years": "year(ts) - 1992"}


@query("u02_features", "WITH f AS (SELECT segment, avg(w) AS won, avg(CASE WHEN w IS NULL THEN 0 ELSE 1 END) AS decided, avg(amount / 1000) AS amount, avg(year(ts) - 1992) AS years FROM games GROUP BY segment) SELECT segment, 'won' AS feature, round(won, 6) AS mean FROM f UNION ALL SELECT segment, 'decided', round(decided, 6) FROM f UNION ALL SELECT segment, 'amount', round(amount, 6) FROM f UNION ALL SELECT segment, 'years', round(years, 6) FROM f", "games")
def u02(spark, sf):
    means = games(spark, sf).groupBy("segment").agg(*(F.avg(F.expr(e)).alias(n) for n, e in FEATURES.items()))
    return rounded(means.unpivot("segment", list(FEATURES), "feature", "mean"))


@query("p08_codec", "SELECT player, mode, count(*) AS n, CASE WHEN mode <> 'view' THEN count(*) FILTER (w = 1) END AS wins FROM plays GROUP BY player, mode", "plays")
def p08(spark, sf):
    """Counters packed into arrays per player and unpacked again; what was not measured stays null."""
    won = F.when(F.col("mode") != "view", F.count_if(F.col("w") == 1))
    cells = plays(spark, sf).groupBy("player", "mode").agg(F.count("*").alias("n"), won.alias("wins"))
    return A.decode_counters(A.encode_counters(cells, ["player"], "mode", ["n", "wins"]), ["player"], "mode", ["n", "wins"])
