"""Predicates, joins, ordering, sets, scalars, increments and publication over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.functions import names as N
from matchlake.functions import scalar as S
from matchlake.metrics import record
from matchlake.operators import keeping as K
from matchlake.plans.records import WL
from matchlake.plans.registry import games, plays, query, rounded
from matchlake.plans.rollups import uploads
from matchlake.plans.sequences import SEQ
from matchlake.session import load


def _all(spark, sf, table, *columns):
    return load(spark, sf, table).select(*columns)


# --- predicates --------------------------------------------------------------------------------------------


@query("f05_capabilities", "SELECT game, error IS NULL AND crouch IS NOT NULL AS full_stats, pack_version >= 4 AND crouch IS NOT NULL AS current_stats, error IS NULL AND crouch IS NULL AND pack_version < 4 AS needs_repair FROM uploads", "uploads")
def f05(spark, sf):
    u = uploads(spark, sf)
    return u.select("game", *(c.alias(n) for n, c in K.capabilities(F.col("error"), F.col("pack_version"), F.col("crouch"), 4).items()))


@query("f06_move_capabilities", "SELECT l_orderkey AS game, l_linenumber AS move, bool_or(CASE WHEN l_linenumber >= 4 THEN o_orderkey % 8 >= 6 AND l_returnflag <> 'N' ELSE l_returnflag <> 'N' END) AS attempts FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def f06(spark, sf):
    """Attempts of a move are measured if recorded; those of special moves from version six only."""
    li = load(spark, sf, "lineitem").join(_all(spark, sf, "orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    measured = K.attempts_measured(F.col("l_linenumber") >= 4, F.col("o_orderkey") % 8, F.when(F.col("l_returnflag") != "N", F.col("l_quantity")), 6)
    return li.groupBy(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("move")).agg(F.max(measured).alias("attempts"))


@query("f11_syncable", "SELECT count(*) AS n, CAST(sum(game) AS BIGINT) AS s FROM uploads WHERE error IS NULL AND crouch IS NOT NULL AND pack_version >= 4 AND (p1 IN ('P1', 'P2', 'P3') OR p2 IN ('P1', 'P2', 'P3'))", "uploads")
def f11(spark, sf):
    mine = spark.createDataFrame([(c,) for c in ("P1", "P2", "P3")], "code string")
    u = uploads(spark, sf)
    ready = u.where(K.capabilities(F.col("error"), F.col("pack_version"), F.col("crouch"), 4)["current_stats"] & F.col("error").isNull())
    own = ready.withColumn("code", F.explode(F.array_distinct(F.array("p1", "p2")))).join(F.broadcast(mine), "code", "left_semi").select("game").distinct()
    return own.agg(F.count("*").alias("n"), F.sum("game").alias("s"))


@query("f12_accounts", "WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE ' c' || (c_custkey % 90) || '#' || c_custkey % 3 || ' ' END AS raw FROM customer), n AS (SELECT upper(trim(raw)) AS code FROM a WHERE trim(raw) <> '') SELECT code, count(*) > 1 AS repeated, regexp_matches(code, '^[A-Z0-9]{1,8}#[0-9]{1,4}$') AS valid FROM n GROUP BY code")
def f12(spark, sf):
    c = F.col("c_custkey")
    raw = F.when(c % 7 == 0, "  ").otherwise(F.concat(F.lit(" c"), c % 90, F.lit("#"), c % 3, F.lit(" ")))
    return K.clean_accounts(load(spark, sf, "customer").select(raw.alias("raw")), "raw")


BUNDLES = ["-main-stream.zip", "-Streams.7z", "-top-8.ZIP", "-r2-offstream.zip", "-pools.zip", "-stream.rar", ".zip"]
PATHS = ["Bracket/", "r1 pools_", "top-8 ", "friendlies/", "Warm-ups ", "hand warmer-", "broadcaster/", ""]
NAMED = "named AS (SELECT p_partkey, p_name || [" + ", ".join(f"'{b}'" for b in BUNDLES) + "][1 + p_partkey % 7] AS bundle, [" + ", ".join(f"'{b}'" for b in PATHS) + "][1 + p_size % 8] || p_type AS path FROM part)"


def named(spark, sf):
    pick = lambda names, n: F.array(*map(F.lit, names))[n % len(names)]
    p = load(spark, sf, "part")
    return p.select("p_partkey", F.concat("p_name", pick(BUNDLES, F.col("p_partkey"))).alias("bundle"), F.concat(pick(PATHS, F.col("p_size")), "p_type").alias("path"))


@query("f14_path_evidence", f"WITH {NAMED}, x AS (SELECT p_partkey, regexp_matches(bundle, '(?i)-(?:main-stream|streams?|top-8|r2-offstream)[.](?:7z|zip)$') AS broadcast_bundle, regexp_matches(path, '(?i)(?:^|[/\\\\ _-])(?:bracket|pools?|top[-_ ]?[0-9]+|stream|broadcast)(?:$|[/\\\\ _-])') AS bracket_path, regexp_matches(path, '(?i)(?:^|[/\\\\ _-])(?:friendlies?|warm[-_ ]?ups?|hand[-_ ]?warmers?|casuals?)(?:$|[/\\\\ _-])') AS friendly FROM named) SELECT p_partkey, broadcast_bundle, bracket_path, broadcast_bundle OR bracket_path AS broadcast, friendly FROM x")
def f14(spark, sf):
    return named(spark, sf).select("p_partkey", *(c.alias(n) for n, c in N.path_evidence(F.col("bundle"), F.col("path")).items()))


@query("f15_tiers", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 100000 THEN 'verified' WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 200000 THEN 'probable' ELSE 'unclassified' END AS t FROM orders) SELECT tier, count(*) AS n FROM (SELECT CASE WHEN t = 'unclassified' AND o_orderkey % 10 = 0 THEN 'probable' ELSE t END AS tier FROM x) GROUP BY tier")
def f15(spark, sf):
    urgent, dear = F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")
    tier = K.tiers(F.col("o_orderstatus") == "P", urgent & (dear > 100000), urgent | (dear > 200000), F.col("o_orderkey") % 10 == 0)
    return load(spark, sf, "orders").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("f17_gate", "WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.095) SELECT count(*) AS kept, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM bad)")
def f17(spark, sf):
    """One impossible count rejects both sides of a game."""
    bad = load(spark, sf, "lineitem").where("l_discount > 0.095").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").join(bad, "o_orderkey", "left_anti").agg(F.count("*").alias("kept"), F.sum("o_orderkey").alias("s"))


@query("f18_never_published", "SELECT 'c_name' AS field, count(*) AS rows FROM customer WHERE regexp_matches(c_name, '#0*1')")
def f18(spark, sf):
    """Fields of a private kind in an output, by name or by what their values look like."""
    return K.forbidden(load(spark, sf, "customer"), r"(?i)uuid|email", r"#0*1").where("rows > 0")


@query("f21_reasons", "SELECT game, array_to_string(list_filter([CASE WHEN is_teams THEN 'teams' END, CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN ts IS NULL THEN 'date' END, CASE WHEN seconds < 300 THEN 'short' END, CASE WHEN stage NOT IN (1, 2, 3, 5) THEN 'stage' END], lambda x: x IS NOT NULL), ',') AS reasons FROM uploads", "uploads")
def f21(spark, sf):
    found = K.reasons({"teams": F.col("is_teams"), "error": F.col("error").isNotNull(), "date": F.col("ts").isNull(), "short": F.col("seconds") < 300, "stage": ~F.col("stage").isin(1, 2, 3, 5)})
    return uploads(spark, sf).select("game", F.array_join(found, ",").alias("reasons"))


# --- joins -------------------------------------------------------------------------------------------------


@query("j10_pending", "SELECT count(*) AS pending FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j10(spark, sf):
    state = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").join(state, "c_custkey", "left_anti").agg(F.count("*").alias("pending"))


@query("j11_counts", "SELECT r_name, count(*) AS rows, count(DISTINCT n_nationkey) AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def j11(spark, sf):
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    both = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # dimensions of fixed size
    return both.groupBy("r_name").agg(F.count("*").alias("rows"), F.count_distinct("n_nationkey").alias("nations"))


@query("j12_publish_cascade", "WITH g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000), p AS (SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM g WHERE o_custkey = c_custkey)) SELECT n_name, (SELECT count(*) FROM p WHERE c_nationkey = n_nationkey) AS players FROM nation WHERE EXISTS (SELECT 1 FROM p WHERE c_nationkey = n_nationkey)")
def j12(spark, sf):
    """A published game publishes its player, a published player its nation."""
    dear = load(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    players = load(spark, sf, "customer").join(dear, "c_custkey", "left_semi").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("players"))
    return load(spark, sf, "nation").join(players, "n_nationkey").select("n_name", "players")


@query("j13_one_to_one", "SELECT 'missing' AS problem, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'repeated', count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)")
def j13(spark, sf):
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return K.one_to_one_problems(_all(spark, sf, "nation", "n_nationkey"), s, "n_nationkey")


@query("j15_ranked_names", "WITH r AS (SELECT translate(regexp_replace(lower(c_name), '[\\s._''\"`-]', '', 'g'), '0$', 'os') AS key, min(row_number) AS rank FROM (SELECT c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS row_number FROM customer) WHERE row_number <= 100 GROUP BY 1) SELECT o_orderkey, rank FROM orders JOIN customer ON c_custkey = o_custkey JOIN r ON key = translate(regexp_replace(lower(upper(c_name)), '[\\s._''\"`-]', '', 'g'), '0$', 'os')")
def j15(spark, sf):
    """Games joined to the hundred best ranked players by normalised name."""
    c = _all(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal")
    best = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long"))
    ranks = best.groupBy(S.name_key(F.col("c_name")).alias("key")).agg(F.min("rank").alias("rank"))
    seen = load(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", S.name_key(F.upper("c_name")).alias("key"))
    return seen.join(F.broadcast(ranks), "key").select("o_orderkey", "rank")  # a hundred rows


@query("j16_lookups", "SELECT p_brand, count(*) FILTER (s_name IS NOT NULL) AS found, count(*) AS rows FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150 GROUP BY p_brand")
def j16(spark, sf):
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), "s_name")
    p = load(spark, sf, "part").select("p_brand", (F.col("p_partkey") % 150).cast("long").alias("k"))
    return p.join(s, "k", "left").groupBy("p_brand").agg(F.count("s_name").alias("found"), F.count("*").alias("rows"))


@query("j17_default_record", "WITH g AS (SELECT nation, count(*) AS games FROM games GROUP BY 1), s AS (SELECT nation, count(*) FILTER (w = 1) AS won, count(*) FILTER (w = 0) AS lost FROM games WHERE amount > 380000 GROUP BY 1) SELECT g.nation, games, coalesce(won, 0) AS won, coalesce(lost, 0) AS lost FROM g LEFT JOIN s USING (nation)", "games")
def j17(spark, sf):
    g = games(spark, sf)
    s = g.where("amount > 380000").groupBy("nation").agg(F.count_if(F.col("w") == 1).alias("won"), F.count_if(F.col("w") == 0).alias("lost"))
    return g.groupBy("nation").agg(F.count("*").alias("games")).join(s, "nation", "left").fillna(0, ["won", "lost"])


@query("j21_m22_reconcile", "WITH a AS (SELECT c_custkey % 4000 AS slot, lower(trim(c_name)) AS exact, translate(regexp_replace(lower(c_name), '[\\s._''\"`#-]', '', 'g'), '0$', 'os') AS loose FROM customer), f AS (SELECT slot, count(*) AS n, count(DISTINCT exact) AS exacts, count(DISTINCT loose) AS looses FROM a GROUP BY slot), s AS (SELECT unnest(range(0, 4000)) AS slot) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' WHEN exacts = 1 THEN 'exact' WHEN looses = 1 THEN 'normalised' ELSE 'ambiguous' END AS status, count(*) AS slots FROM s LEFT JOIN f USING (slot) GROUP BY 1")
def j21(spark, sf):
    """Which evidence settles who holds a slot: one candidate, one exact alias, one normalised alias, or none."""
    c = load(spark, sf, "customer").select((F.col("c_custkey") % 4000).alias("slot"), "c_name")
    loose = F.regexp_replace(S.name_key(F.col("c_name")), "#", "")
    return K.reconcile(spark.range(4000).select(F.col("id").alias("slot")), c, "slot", F.lower(F.trim("c_name")), loose)


# --- order and choice --------------------------------------------------------------------------------------


@query("t01_undated_first", "SELECT game, row_number() OVER (PARTITION BY owner ORDER BY coalesce(ts, TIMESTAMP '1970-01-01'), game) AS place FROM uploads", "uploads")
def t01(spark, sf):
    when = F.coalesce("ts", F.lit("1970-01-01").cast("timestamp_ntz"))
    return uploads(spark, sf).select("game", F.row_number().over(Window.partitionBy("owner").orderBy(when, "game")).cast("long").alias("place"))


@query("t02_ranked_groups", f"WITH g AS (SELECT nation, min(game) AS first, {WL} FROM games GROUP BY nation) SELECT nation, games, row_number() OVER (ORDER BY games DESC, first) AS place FROM g", "games")
def t02(spark, sf):
    g = games(spark, sf).groupBy("nation").agg(F.min("game").alias("first"), *record())
    return g.select("nation", "games", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("games"), "first")).cast("long").alias("place"))  # a row per nation


@query("t08_dummy_levels", "WITH c AS (SELECT mode, nation, count(*) AS n FROM games GROUP BY ALL HAVING count(*) >= 15) SELECT mode, nation, n FROM c QUALIFY row_number() OVER (PARTITION BY mode ORDER BY n DESC, nation) BETWEEN 2 AND 11", "games")
def t08(spark, sf):
    """Levels frequent enough for a dummy, the most frequent one being the reference, at most ten."""
    return K.dummy_levels(games(spark, sf), ["mode"], "nation", 15, 10)


@query("t11_comparison_keys", "SELECT mode, string_agg(segment, ',' ORDER BY n DESC, segment) AS keys FROM (SELECT mode, segment, count(*) AS n FROM games GROUP BY ALL) GROUP BY mode", "games")
def t11(spark, sf):
    c = games(spark, sf).groupBy("mode", "segment").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "segment")))
    return c.groupBy("mode").agg(F.array_join(F.transform(ordered, lambda x: x["segment"]), ",").alias("keys"))


@query("t14_batches", "WITH b AS (SELECT o_custkey AS bucket, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT bucket, n, (sum(n) OVER (PARTITION BY bucket % 8 ORDER BY bucket) - n) // 500 AS batch FROM b) SELECT bucket % 8 AS part, CAST(batch AS BIGINT) AS batch, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS records FROM r GROUP BY ALL")
def t14(spark, sf):
    """Whole buckets in order, a new batch with each 500 records; parts are batched apart."""
    b = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("bucket")).agg(F.count("*").alias("n"))
    return K.batches(b.withColumn("part", F.col("bucket") % 8), "part", "bucket", "n", 500).groupBy("part", "batch").agg(F.count("*").alias("buckets"), F.sum("n").alias("records"))


# --- keys and sets -----------------------------------------------------------------------------------------


@query("d01b_identity_key", "SELECT game, CASE WHEN ts IS NOT NULL THEN strftime(ts, '%Y-%m-%d') || '|' || stage || '|' || array_to_string(list_sort([coalesce(CASE WHEN owner % 3 <> 0 THEN p1 END, 'd:' || mode), p2]), '+') END AS key FROM uploads", "uploads")
def d01b(spark, sf):
    first = F.coalesce(F.when(F.col("owner") % 3 != 0, F.col("p1")), F.concat(F.lit("d:"), "mode"))
    key = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), F.col("stage").cast("string"), F.array_join(F.array_sort(F.array(first, F.col("p2"))), "+"))
    return uploads(spark, sf).select("game", F.when(F.col("ts").isNotNull(), key).alias("key"))


@query("d06_failed", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def d06(spark, sf):
    o = load(spark, sf, "orders")
    failed = o.where("o_orderstatus = 'P'").select("o_custkey").subtract(o.where("o_totalprice > 250000").select("o_custkey"))
    return failed.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query("d11_union_once", "WITH a AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000), b AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS once")
def d11(spark, sf):
    """A population united from two, with no game counted twice."""
    a, b = F.col("o_totalprice") > 150000, F.col("o_orderpriority") == "1-URGENT"
    return load(spark, sf, "orders").agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("both_"), F.count_if(a | b).alias("once"))


@query("d12_major_key", "SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || ':' || (p_size + 1990) AS key, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1")
def d12(spark, sf):
    key = N.major_key(F.col("p_name"), F.col("p_size") + 1990)
    return load(spark, sf, "part").groupBy(key.alias("key")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))


@query("d13_intersect", "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def d13(spark, sf):
    return load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(load(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")))


# --- scalars -----------------------------------------------------------------------------------------------


@query("x02_units", "SELECT game, round(value / 3600, 6) AS minutes, round(value / 60, 6) AS seconds, round(value / 216000, 6) AS hours, CASE WHEN value > 0 THEN round((value % 7) / (value / 3600), 6) END AS per_minute FROM plays", "plays")
def x02(spark, sf):
    v = F.col("value")
    return rounded(plays(spark, sf).select("game", (v / 3600).alias("minutes"), (v / 60).alias("seconds"), (v / 216000).alias("hours"), S.ratio(v % 7, v / 3600).alias("per_minute")))


@query("x03_local_time", "SELECT event_id, strftime(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER), '%Y-%m-%d') AS week, CAST(hour(ts) // 6 AS INTEGER) AS part FROM events")
def x03(spark, sf):
    return load(spark, sf, "events").select("event_id", F.date_format(S.week_start(F.col("ts")), "yyyy-MM-dd").alias("week"), S.hour_bucket(F.col("ts")).alias("part"))


@query("x06_normal_tail", "WITH z AS (SELECT p_partkey, (p_size - 25) / 10.0 AS z, 1 / (1 + 0.2316419 * abs((p_size - 25) / 10.0)) AS t FROM part) SELECT p_partkey, round(least(1, 2 * 0.3989422804 * exp(-z * z / 2) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))), 6) AS p FROM z")
def x06(spark, sf):
    return rounded(load(spark, sf, "part").select("p_partkey", N.two_sided((F.col("p_size") - 25) / 10.0).alias("p")))


@query("x07_x08_x09_logistic", "SELECT p_partkey, round(1 / (1 + exp(-greatest(-30, least(30, (p_size - 25) * 2.0)))), 6) AS logistic, round(1 / (1 + 10 ** ((25.0 - p_size) * 20 / 400)), 6) AS elo, round(2.0 ** (-p_size / 7.0), 6) AS weight FROM part")
def x07(spark, sf):
    s = F.col("p_size")
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (s - 25) * 2.0))
    return rounded(load(spark, sf, "part").select("p_partkey", S.sigmoid(x).alias("logistic"), S.elo_probability(s * 20.0, F.lit(500.0)).alias("elo"), S.decay(s, 7.0).alias("weight")))


FNV = "CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INTEGER), 1)) AS HUGEINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT)"


@query("x16_seeded_random", f"""WITH s AS (SELECT c_custkey, {FNV.format('c_name')} AS seed FROM customer), a AS (SELECT c_custkey, seed, (seed + 2 * 1831565813::HUGEINT) % 4294967296 AS t FROM s),
b AS (SELECT *, (xor(t, t >> 15) * (t | 1::HUGEINT)) % 4294967296 AS v FROM a), c AS (SELECT *, xor(v, (v + xor(v, v >> 7) * (v | 61::HUGEINT)) % 4294967296) AS w FROM b)
SELECT c_custkey, seed, round(CAST(xor(w, w >> 14) AS DOUBLE) / 4294967296.0, 6) AS second FROM c""")
def x16(spark, sf):
    """The seed of a name and the second number of its generator."""
    seed = N.seed_hash(F.col("c_name"))
    return rounded(load(spark, sf, "customer").select("c_custkey", seed.alias("seed")).withColumn("second", N.counted_random(F.col("seed"), F.lit(2))))


@query("x19_strict_alias", "SELECT c_custkey, lower(trim(c_name)) AS alias FROM customer")
def x19(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", N.strict_alias(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("alias"))


@query("x21_match_mode", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'offline' WHEN page_id % 5 = 1 THEN 'ranked' WHEN page_id % 5 = 2 THEN 'unranked' WHEN page_id % 5 = 3 THEN 'direct' ELSE 'unknown' END AS mode FROM pages")
def x21(spark, sf):
    k = F.col("page_id") % 5
    match = F.when(k == 1, "mode.ranked-1").when(k == 2, "x.mode.unranked").when(k == 3, "mode.direct").when(k == 4, "mode.other")
    return load(spark, sf, "pages").select("page_id", N.mode_of_match(match).alias("mode"))


@query("x22_bundle_event", f"WITH {NAMED} SELECT p_partkey, regexp_replace(regexp_replace(bundle, '(?i)[.](7z|zip)$', ''), '(?i)-(main-stream|streams?|top-8|r2-offstream)$', '') AS event FROM named")
def x22(spark, sf):
    return named(spark, sf).select("p_partkey", N.event_of_bundle(F.col("bundle")).alias("event"))


@query("x23_move_groups", "SELECT CASE WHEN p_size BETWEEN 2 AND 5 THEN 'jab' WHEN p_size = 6 THEN 'dash' WHEN p_size IN (7, 8, 9) THEN 'tilt' WHEN p_size IN (10, 11, 12) THEN 'smash' WHEN p_size BETWEEN 13 AND 17 THEN 'air' WHEN p_size BETWEEN 18 AND 21 THEN 'special' WHEN p_size = 50 THEN 'getup' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def x23(spark, sf):
    g = N.move_group(F.col("p_size"))
    kind = F.when(g.isin("ftilt", "utilt", "dtilt"), "tilt").when(g.isin("fsmash", "usmash", "dsmash"), "smash").when(g.isin("nair", "fair", "bair", "uair", "dair"), "air").when(g.endswith("-b"), "special").otherwise(g)
    return load(spark, sf, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("x24_effective_day", "SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN year(o_orderdate) = 1995 THEN CAST(o_orderdate AS DATE) END, DATE '1995-12-31'), '%Y-%m-%d') AS day FROM orders")
def x24(spark, sf):
    start = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))
    return load(spark, sf, "orders").select("o_orderkey", F.date_format(N.effective_day(start, F.col("o_orderdate"), F.lit(1995)), "yyyy-MM-dd").alias("day"))


@query("x25_zoned", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS at FROM orders")
def x25(spark, sf):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "+02:00").otherwise(""))
    return load(spark, sf, "orders").select("o_orderkey", F.date_format(N.zoned(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("x28_tier", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'master' WHEN o_orderkey % 4 = 1 THEN 'diamond' END AS tier FROM orders")
def x28(spark, sf):
    k = F.col("o_orderkey") % 4
    labels = F.when(k == 0, F.array(F.lit("Master Player"), F.lit("x"))).when(k == 1, F.array(F.lit("diamond player"), F.lit("Diamond Player"))).when(k == 2, F.array(F.lit("diamond player"), F.lit("platinum player"))).otherwise(F.array(F.lit("gold player")))
    return load(spark, sf, "orders").select("o_orderkey", N.tier(labels).alias("tier"))


@query("x30_x31_wikitext", "SELECT s_suppkey, s_name AS player, CAST(floor(abs(s_acctbal)) AS BIGINT) AS earned FROM supplier")
def x30(spark, sf):
    amount = F.format_number(F.floor(F.abs("s_acctbal")), 0)
    text = F.concat(F.lit("a {{Other|1}} {{Player| "), "s_name", F.lit(" |earned=$"), amount, F.lit("}} b"))
    fields = N.template_fields(text, "Player")[0]
    return load(spark, sf, "supplier").select("s_suppkey", fields[0].alias("player"), N.earnings(fields[1]).alias("earned"))


@query("x32_formats", "SELECT game, CAST(floor(value / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM plays", "plays")
def x32(spark, sf):
    return plays(spark, sf).select("game", N.clock(F.col("value")).alias("clock"))


@query("x34_fallback", "WITH m AS (SELECT nation, CASE WHEN count(*) FILTER (w = 1) >= 200 THEN quantile_cont(amount, 0.5) FILTER (w = 1) END AS p50 FROM games GROUP BY nation), p AS (SELECT quantile_cont(amount, 0.5) AS pooled FROM games) SELECT n.n_nationkey AS nation, round(coalesce(p50, pooled), 4) AS typical FROM nation n LEFT JOIN m ON m.nation = n.n_nationkey, p", "games")
def x34(spark, sf):
    """The median of a cohort of 200 wins or more, else the pooled one."""
    g = games(spark, sf)
    m = g.groupBy("nation").agg(F.when(F.count_if(F.col("w") == 1) >= 200, F.percentile(F.when(F.col("w") == 1, F.col("amount")), 0.5)).alias("p50"))
    pooled = g.agg(F.percentile("amount", 0.5).alias("pooled"))
    every = load(spark, sf, "nation").select(F.col("n_nationkey").alias("nation")).join(m, "nation", "left").crossJoin(F.broadcast(pooled))
    return every.select("nation", F.round(F.coalesce("p50", "pooled"), 4).alias("typical"))


@query("x36_canonical_json", "SELECT o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"key\":' || o_orderkey || ',\"mode\":\"' || o_orderpriority || '\"}') AS digest FROM orders")
def x36(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", S.canonical_digest({"mode": F.col("o_orderpriority"), "key": F.col("o_orderkey"), "customer": F.col("o_custkey")}).alias("digest"))


@query("x37_reliability", "SELECT CAST(least(4, floor((greatest(p, 1 - p) - 0.5) * 10)) AS INTEGER) AS bucket, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (w = 1) THEN 1.0 ELSE 0.0 END), 6) AS observed FROM (SELECT (value % 101) / 101.0 AS p, w FROM plays WHERE w IS NOT NULL) GROUP BY 1", "plays")
def x37(spark, sf):
    p = F.col("p")
    x = plays(spark, sf).where("w IS NOT NULL").select(((F.col("value") % 101) / 101.0).alias("p"), "w")
    return rounded(x.groupBy(S.reliability_bucket(p).alias("bucket")).agg(F.count("*").alias("n"), F.avg(((p >= 0.5) == (F.col("w") == 1)).cast("double")).alias("observed")))


@query("x39_geometry", "SELECT p_partkey, round(sqrt((p_size - 20.0) ** 2 + (p_retailprice / 100 - 5) ** 2), 6) AS distance, CAST(sign(p_size - 20) AS INTEGER) AS side FROM part")
def x39(spark, sf):
    return rounded(load(spark, sf, "part").select("p_partkey", F.hypot(F.col("p_size") - 20.0, F.col("p_retailprice") / 100 - 5).alias("distance"), F.signum(F.col("p_size") - 20.0).cast("int").alias("side")))


@query("x40_tech_totals", "SELECT o_orderkey, a + b + c AS ground, a + b + c + d AS attempts, a + b + c + e AS every FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 4 AS b, o_orderkey % 5 AS c, o_orderkey % 6 AS d, o_orderkey % 7 AS e FROM orders)")
def x40(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", *S.tech_totals(k % 3, k % 4, k % 5, k % 6, k % 7))


@query("x41_private_keys", "SELECT game, CASE WHEN owner % 5 <> 0 THEN array_to_string(list_sort([p1, p2]), ' vs ') END AS roster, coalesce(CASE WHEN owner % 2 = 0 THEN p1 END, 'u:' || substr(sha256(mode), 1, 16)) AS identity FROM uploads", "uploads")
def x41(spark, sf):
    one = F.when(F.col("owner") % 5 != 0, F.col("p1"))
    who = N.identity(F.when(F.col("owner") % 2 == 0, F.col("p1")), F.col("mode"), F.lit("x"), F.lit("e"), F.lit("t"))
    return uploads(spark, sf).select("game", N.roster(F.array(F.array(one), F.array("p2"))).alias("roster"), who.alias("identity"))


# --- increments --------------------------------------------------------------------------------------------


@query("i03_i04_defer_and_tombstones", "SELECT CASE WHEN ts > TIMESTAMP '1998-08-01' THEN 'deferred' WHEN error IS NOT NULL THEN 'failed' WHEN ts IS NULL THEN 'retry' ELSE 'parsed' END AS state, count(*) AS n FROM uploads GROUP BY 1", "uploads")
def i03(spark, sf):
    """What is too fresh waits without a tombstone, failures are kept as such, partial ones are tried again."""
    state = K.intake_state(F.col("ts") > F.lit("1998-08-01").cast("timestamp_ntz"), F.col("error").isNotNull(), F.col("ts").isNull())
    return uploads(spark, sf).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("i07_upgrade_plan", "WITH c AS (SELECT owner, game, ts FROM uploads WHERE pack_version < 3 AND error IS NULL AND game NOT IN (SELECT game FROM uploads WHERE stage = 7)) SELECT owner, count(*) AS planned, max(game) AS newest FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY owner ORDER BY ts DESC NULLS LAST, game DESC) <= 50) GROUP BY owner", "uploads")
def i07(spark, sf):
    """The newest fifty outdated games of each owner that were not attempted before."""
    u = uploads(spark, sf)
    plan = K.upgrade_plan(u.where("pack_version < 3 AND error IS NULL"), u.where("stage = 7").select("game"), ["owner"], "game", "ts", 50)
    return plan.groupBy("owner").agg(F.count("*").alias("planned"), F.max("game").alias("newest"))


@query("i08_last_then_needed", "SELECT owner, count(*) AS targets FROM (SELECT owner, crouch FROM uploads QUALIFY row_number() OVER (PARTITION BY owner ORDER BY ts DESC NULLS LAST, game DESC) <= 30) WHERE crouch IS NULL GROUP BY owner", "uploads")
def i08(spark, sf):
    """The last games first, then those of them that need it."""
    last = K.newest(uploads(spark, sf), ["owner"], "ts", "game", 30)
    return last.where("crouch IS NULL").groupBy("owner").agg(F.count("*").alias("targets"))


def _settled_sql(least: int, rounds: int = 12) -> str:
    """Rounds that drop the owners who hold too little, each from the owners that the one before left."""
    steps = ["u AS (SELECT DISTINCT stage, ch, pack_version AS v, owner FROM uploads)", "l0 AS (SELECT DISTINCT owner FROM u)"]
    for k in range(1, rounds + 1):
        steps.append(f"h{k} AS (SELECT stage, ch, v, min(owner) AS owner FROM u JOIN l{k - 1} USING (owner) GROUP BY ALL)")
        steps.append(f"l{k} AS (SELECT owner FROM l{k - 1} WHERE owner NOT IN (SELECT owner FROM h{k} GROUP BY owner HAVING count(*) < {least}))")
    return f"WITH {', '.join(steps)} SELECT owner, count(*) AS n FROM h{rounds} GROUP BY owner"


@query("i11_ownership_fixpoint", _settled_sql(4), "uploads")
def i11(spark, sf):
    """Who owns each shared key once all transfers have settled: owners who hold fewer than four hand theirs on, again and again."""
    keys = uploads(spark, sf).select("stage", "ch", F.col("pack_version").alias("v"), "owner").distinct()
    return K.settle(keys, ["stage", "ch", "v"], "owner", 4).groupBy("owner").agg(F.count("*").alias("n"))


@query("i13_cursor_sync", "WITH r AS (SELECT game, pack_version AS v FROM uploads WHERE ts > TIMESTAMP '1996-01-01'), l AS (SELECT game, (game + 1) % 5 AS v FROM uploads) SELECT CASE WHEN l.game IS NULL OR r.v > l.v THEN 'pull' WHEN r.game IS NULL OR l.v > r.v THEN 'push' ELSE 'same' END AS action, count(*) AS n FROM r FULL JOIN l USING (game) GROUP BY 1", "uploads")
def i13(spark, sf):
    """What is newer remotely (since the cursor) is pulled, what is newer here is pushed."""
    u = uploads(spark, sf)
    remote = u.where(F.col("ts") > F.lit("1996-01-01").cast("timestamp_ntz")).select("game", F.col("pack_version").alias("v"))
    local = u.select("game", ((F.col("game") + 1) % 5).alias("v"))
    return K.sync_actions(local, remote, "game", "v").groupBy("action").agg(F.count("*").alias("n"))


@query("i15_resumable_batches", "SELECT count(*) AS moved, max(o_orderkey) AS cursor FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500)")
def i15(spark, sf):
    """The next batch after a stored cursor, and the cursor to store (the limit is the batch size)."""
    return load(spark, sf, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(500).agg(F.count("*").alias("moved"), F.max("o_orderkey").alias("cursor"))


@query("i20_ordered_objects", "SELECT l_orderkey AS owner, l_linenumber AS key, arg_max(l_partkey, (l_quantity, l_shipdate, -l_partkey)) AS data FROM lineitem GROUP BY ALL")
def i20(spark, sf):
    """Objects with repeated keys collapse to the last by version, time and id."""
    last = F.max_by("l_partkey", F.struct("l_quantity", "l_shipdate", -F.col("l_partkey")))
    return load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("key")).agg(last.alias("data"))


# --- publication -------------------------------------------------------------------------------------------


@query("p07_published_only", "SELECT mode, count(*) AS n FROM uploads WHERE pack_version >= 3 AND error IS NULL GROUP BY mode", "uploads")
def p07(spark, sf):
    u = uploads(spark, sf).withColumn("published", (F.col("pack_version") >= 3) & F.col("error").isNull())
    return u.where("published").groupBy("mode").agg(F.count("*").alias("n"))


@query("p09_manifest", "WITH s AS (SELECT o_orderpriority AS shard, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1) SELECT shard, rows, CASE WHEN shard = '3-MEDIUM' THEN 'rows' WHEN shard = '5-LOW' THEN 'missing' ELSE 'ok' END AS state FROM s")
def p09(spark, sf):
    """Shards against their manifest: a missing one, and one whose count differs."""
    o = load(spark, sf, "orders")
    found = o.groupBy(F.col("o_orderpriority").alias("shard")).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("s"))
    manifest = found.where("shard <> '5-LOW'").select("shard", (F.col("rows") + F.when(F.col("shard") == "3-MEDIUM", 1).otherwise(0)).alias("m_rows"), F.col("s").alias("m_s"))
    return K.against_manifest(found, manifest, "shard", {"rows": "m_rows", "s": "m_s"}).select("shard", "rows", "state")


@query("p11_audit_hash", "SELECT sha256(string_agg(o_orderpriority || ':' || n, ',' ORDER BY o_orderpriority)) AS hash FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def p11(spark, sf):
    """A hash of the population plan: its cells in order."""
    cells = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "o_orderpriority", F.col("n").cast("string"))))
    return cells.agg(F.sha2(F.array_join(lines, ","), 256).alias("hash"))


@query("p12_validators", "SELECT 'price' AS check, count(*) FILTER (o_totalprice <= 0) AS broken FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders")
def p12(spark, sf):
    return K.validate(load(spark, sf, "orders"), {"price": "o_totalprice > 0", "status": "o_orderstatus IN ('F', 'O')"})


# --- forecasting helpers -----------------------------------------------------------------------------------


@query("m02_event_bounds", "SELECT o_custkey AS event, strftime(min(least(o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 3 DAY END)), '%Y-%m-%d') AS start, strftime(max(greatest(o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 DAY END)), '%Y-%m-%d') AS finish FROM orders GROUP BY 1")
def m02(spark, sf):
    """The earliest reported start and the latest reported end, unknown ones ignored."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    start, end = F.least(d, F.when(k % 2 == 0, d - F.expr("INTERVAL 3 DAY"))), F.greatest(d, F.when(k % 3 == 0, d + F.expr("INTERVAL 2 DAY")))
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("event")).agg(F.date_format(F.min(start), "yyyy-MM-dd").alias("start"), F.date_format(F.max(end), "yyyy-MM-dd").alias("finish"))


@query("m04_seed_phase", "WITH s AS (SELECT l_orderkey AS event, l_returnflag AS phase, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY ALL), c AS (SELECT event, phase FROM s WHERE n = d AND lo = 1 AND hi = n) SELECT event, min(phase) AS phase FROM c GROUP BY event HAVING count(*) = 1")
def m04(spark, sf):
    """The one phase of an event whose seeds are 1 to n, each once; events with several or none are left out."""
    x = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("phase"), F.col("l_linenumber").alias("seed"))
    return K.full_seed_phase(x, "event", "phase", "seed")


@query("m14_side_swap", "SELECT swapped, count(*) AS n, round(avg(CASE WHEN swapped THEN 1 - w ELSE w END), 6) AS first_wins FROM (SELECT game, w, ascii(right(sha256(CAST(game AS VARCHAR)), 1)) % 2 = 1 AS swapped FROM games WHERE w IS NOT NULL) GROUP BY swapped", "games")
def m14(spark, sf):
    """Sides swapped by a bit of the game's hash, so that no model gains from the order of entry."""
    digit = F.substring(S.key_hash(F.col("game")), -1, 1)
    x = games(spark, sf).where("w IS NOT NULL").withColumn("swapped", F.ascii(digit) % 2 == 1)
    return rounded(x.groupBy("swapped").agg(F.count("*").alias("n"), F.avg(F.when(F.col("swapped"), 1 - F.col("w")).otherwise(F.col("w"))).alias("first_wins")))


@query("m30_input_checks", "SELECT 'seed repeated' AS problem, count(*) AS n FROM (SELECT s_nationkey, s_suppkey % 9 FROM supplier GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'late', count(*) FROM supplier WHERE s_acctbal < 0")
def m30(spark, sf):
    """Entrants whose seed another one of their event has, and those that come after the cutoff."""
    s = load(spark, sf, "supplier")
    twice = s.groupBy("s_nationkey", F.col("s_suppkey") % 9).count().where("count > 1").agg(F.lit("seed repeated").alias("problem"), F.count("*").alias("n"))
    return twice.unionByName(s.where("s_acctbal < 0").agg(F.lit("late").alias("problem"), F.count("*").alias("n")))


# --- frames ------------------------------------------------------------------------------------------------

FRAMES = "f AS (SELECT player, game, floor(value) % 12 AS state, value AS percent, CAST(lag(floor(value) % 12) OVER p AS BIGINT) AS before, lag(value) OVER p AS was FROM plays WINDOW p AS (PARTITION BY player ORDER BY ts, game))"


@query("k01_landings", f"WITH {FRAMES} SELECT player, before AS move, count(*) AS landings, count(*) FILTER (floor(percent) % 2 = 0) AS cancelled FROM f WHERE before BETWEEN 3 AND 7 AND state < 3 GROUP BY ALL", "plays")
def k01_landings(spark, sf):
    """Landings out of an aerial by move, and those that were cancelled in time."""
    return K.landings(plays(spark, sf), ["player"], SEQ, F.floor("value") % 12, (3, 7), 3, F.floor("value") % 2 == 0)


@query("k02_crouch_cancel", f"WITH {FRAMES} SELECT player, count(*) AS n FROM f WHERE percent > was AND state >= 9 AND before = 4 GROUP BY player", "plays")
def k02(spark, sf):
    """Damage taken in a damaged state straight out of a crouch."""
    return K.crouch_cancels(plays(spark, sf), ["player"], SEQ, F.col("value"), F.floor("value") % 12, 4, 9)


@query("k03_damage_matrix", "WITH f AS (SELECT player AS victim, value, lag(value) OVER (PARTITION BY player ORDER BY ts, game) AS was, game % 4 AS hitter, game % 7 = 0 AS nobody FROM plays) SELECT CASE WHEN nobody THEN victim % 4 ELSE hitter END AS attacker, victim % 4 AS victim, count(*) AS hits, round(sum(value - was), 4) AS damage FROM f WHERE value > was GROUP BY 1, 2", "plays")
def k03(spark, sf):
    """Rises in percent credited to the last hitter, or to oneself where there is none."""
    p = plays(spark, sf).withColumn("hitter", F.when(F.col("game") % 7 != 0, F.col("game") % 4))
    return K.damage_matrix(p, ["player"], SEQ, "value", "hitter", F.col("player") % 4).withColumn("damage", F.round("damage", 4))


@query("k04_conversions", "WITH c AS (SELECT l_orderkey, l_partkey % 9 AS move, l_quantity, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)) SELECT move, count(*) AS landed, round(sum(l_quantity), 2) AS damage, count(*) FILTER (i = 1) AS openings, round(sum(total) FILTER (i = 1), 2) AS opening_damage, count(*) FILTER (i = n AND l_orderkey % 2 = 0) AS kills FROM c GROUP BY move")
def k04(spark, sf):
    """Moves of a conversion: the first is its opening, the last its kill."""
    x = load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 9).alias("move"), "l_quantity", "l_linenumber", "l_partkey")
    got = K.conversions(x, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "move", "l_quantity", F.col("l_orderkey") % 2 == 0)
    return got.withColumns({"damage": F.round("damage", 2), "opening_damage": F.round("opening_damage", 2)})


@query("k06_win_ladder", "SELECT game, CASE WHEN seconds < 30 THEN NULL WHEN game % 4 = 0 THEN game % 2 WHEN (game % 5 = 0) <> (game % 3 = 0) THEN CASE WHEN game % 5 = 0 THEN 1 ELSE 0 END WHEN game % 7 = 0 THEN 1 END AS winner FROM uploads", "uploads")
def k06(spark, sf):
    """Placement, else the one who has stocks left, else the one who did not quit; too short games have no winner."""
    k = F.col("game")
    placed = F.when(k % 4 == 0, k % 2)
    return uploads(spark, sf).select("game", K.winner(F.col("seconds"), placed, k % 5 == 0, k % 3 == 0, F.when(k % 7 == 0, F.lit(0))).alias("winner"))


@query("w24_form", "WITH r AS (SELECT player, w - 0.5 AS residual, 2.0 ** (-date_diff('day', CAST(ts AS DATE), DATE '2024-12-31') / 90.0) AS weight FROM plays WHERE w IS NOT NULL) SELECT player, round(sum(residual * weight) / (sum(weight) + 5), 6) AS form FROM r GROUP BY player", "plays")
def w24(spark, sf):
    """Recency-weighted mean residual of each player at a cutoff, shrunk by a prior weight."""
    return rounded(K.form(plays(spark, sf).where("w IS NOT NULL"), ["player"], F.col("w") - 0.5, F.to_date("ts"), "2024-12-31", 90.0, 5.0))
