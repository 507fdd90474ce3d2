"""Verified shards, resumable builds, publishable bundles, dirty queues, table functions and semi-structured records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from matchlake.operators.resolve import range_error
from matchlake.plans.registry import games, plays, query, rounded
from matchlake.scratch import scratch_dir
from matchlake.session import load
from matchlake.sources import shards as V
from matchlake.sources import tables as S
from matchlake.streaming import incremental as I  # noqa: E741
from matchlake.streaming import queue as Q


def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s14_verified_shards", "SELECT segment, mode, count(*) AS n, round(sum(amount), 2) AS amount FROM games GROUP BY ALL", "games")
def s14(spark, sf):
    """Totals written as shards with a manifest, verified file by file, and read again."""
    path = _folder(spark, "shards")
    totals = games(spark, sf).groupBy("segment", "mode").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    V.write_verified(totals, path, ["segment"])
    return V.read_verified(spark, path, totals.schema).select("segment", "mode", "n", "amount")


@query("i16_resumable_build", "SELECT segment, nation, count(*) AS n, round(avg(w), 6) AS won FROM games GROUP BY ALL", "games")
def i16(spark, sf):
    """A stage for each segment, keyed by the segment's rows; a second run finds every partition finished."""
    path, g = _folder(spark, "build"), games(spark, sf)
    stage = lambda df: rounded(df.groupBy("segment", "nation").agg(F.count("*").alias("n"), F.avg("w").alias("won")))
    V.build(g, stage, path, "segment", "1")
    return V.build(g, stage, path, "segment", "1").select("segment", "nation", "n", "won")


BUNDLE = {"segment": "string", "years[].year": "int", "years[].n": "bigint", "years[].won": "double"}


@query("m28_publish_bundle", "WITH c AS (SELECT segment, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, round(avg(w), 6) AS won FROM games GROUP BY ALL) SELECT segment, year, n, won FROM c", "games")
def m28(spark, sf):
    """A nested bundle whose every leaf is on the list, written with its digest and read back under it."""
    c = games(spark, sf).groupBy("segment", F.year("ts").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("won"))
    nested = c.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("year", "n", "won"))).alias("years"))
    path = _folder(spark, "bundle")
    V.snapshot(nested, path, ["segment"], BUNDLE)
    return V.restore(spark, path, ["segment"], BUNDLE).select("segment", F.inline("years"))


@query("m32_sanity", "SELECT source, count(*) AS rows, count(*) FILTER (NOT coalesce(n_chars > 0, false)) AS empty, count(*) FILTER (NOT coalesce(n_chars = length(text), false)) AS wrong_length, count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr'), false)) AS other_language FROM documents GROUP BY source")
def m32(spark, sf):
    """What each source breaks of what is expected of its rows."""
    checks = {"empty": F.col("n_chars") > 0, "wrong_length": F.col("n_chars") == F.char_length("text"), "other_language": F.col("lang").isin("en", "de", "fr")}
    return V.sanity(load(spark, sf, "documents"), ["source"], checks)


@query("i09_dirty_stream", "SELECT player, count(*) AS n, count(w) AS decided, round(sum(value), 4) AS total FROM plays GROUP BY player", "plays")
def i09_stream(spark, sf):
    """The change log as a stream, a few files or all at once: what it marks is rebuilt from the table, and the result is that of a batch."""
    events = load(spark, sf, "events")
    changes = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(F.col("user_id").alias("player"))
    build = lambda df: df.groupBy("player").agg(F.count("*").alias("n"), F.count("w").alias("decided"), F.round(F.sum("value"), 4).alias("total"))
    base = lambda: plays(spark, sf)
    path, schema = _folder(spark, "queue"), build(base()).schema
    I.run_available(changes, Q.dirty_sink(base, build, f"{path}/table", "player", schema, 16), f"{path}/checkpoint")
    return Q.read_table(spark, f"{path}/table", schema)


@udtf(returnType="player long, run int, mode string, first_game long, games int")
class Runs:
    """A row for each run of games in one mode, in the order of a player's games."""

    def __init__(self):
        self.player, self.run, self.mode, self.first, self.n = None, 0, None, None, 0

    def eval(self, row):
        if row["mode"] != self.mode or self.n == 0:
            if self.n:
                yield self.player, self.run, self.mode, self.first, self.n
            self.player, self.run, self.mode, self.first, self.n = row["player"], self.run + 1, row["mode"], row["game"], 0
        self.n += 1

    def terminate(self):
        if self.n:
            yield self.player, self.run, self.mode, self.first, self.n


@query("u07_runs_table_function", "WITH o AS (SELECT *, row_number() OVER p - row_number() OVER m AS island FROM plays WINDOW p AS (PARTITION BY player ORDER BY ts, game), m AS (PARTITION BY player, mode ORDER BY ts, game)), r AS (SELECT player, mode, island, min(ts) AS start, arg_min(game, (ts, game)) AS first_game, CAST(count(*) AS INTEGER) AS games FROM o GROUP BY ALL) SELECT player, CAST(row_number() OVER (PARTITION BY player ORDER BY start, first_game) AS INTEGER) AS run, mode, first_game, games FROM r", "plays")
def u07(spark, sf):
    """A table function over partitions: state lives as long as a player's rows, and each change of mode gives a row."""
    own = plays(spark, sf).select(F.col("player").cast("long").alias("player"), "ts", F.col("game").cast("long").alias("game"), "mode")
    return Runs(own.asTable().partitionBy("player").orderBy("ts", "game"))


@query("x26_variant", "WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 11 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 11 = 0) AS corrupt, CAST(sum(k) AS BIGINT) AS total, max(k) AS most, CAST(sum(k) FILTER (k % 2 = 0) AS BIGINT) AS even FROM x GROUP BY event_type")
def x26(spark, sf):
    """Records of two shapes (k at the top, or k within a list of objects) as variants; what does not parse is counted apart."""
    props = F.col("props")
    old, new = F.concat(F.lit('{"v":1,"items":['), props, F.lit("]}")), props
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), props)).when(F.col("event_id") % 2 == 0, old).otherwise(new)
    v = load(spark, sf, "events").select("event_type", F.try_parse_json(text).alias("v"))
    k = F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.try_variant_get("v", "$.items[0].k", "bigint"))
    x = v.withColumn("k", k)
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("corrupt"), F.sum("k").alias("total"), F.max("k").alias("most"), F.sum(F.when(F.col("k") % 2 == 0, F.col("k"))).alias("even"))


@query("x26_variant_explode", "SELECT event_type, 'k' AS field, count(*) AS n, count(DISTINCT props->>'$.k') AS different FROM events GROUP BY event_type")
def x26_explode(spark, sf):
    """Every field of the records as rows of name and value."""
    v = load(spark, sf, "events").select("event_type", F.parse_json("props").alias("v"))
    v.createOrReplaceTempView(name := f"records_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT event_type, f.key AS field, count(*) AS n, count(DISTINCT to_json(f.value)) AS different FROM {name}, LATERAL variant_explode(v) AS f GROUP BY ALL")


@query("p05_publish", "SELECT nation, count(*) AS n, CAST(sum(w) AS BIGINT) AS wins FROM games GROUP BY nation", "games")
def p05(spark, sf):
    """Totals published under checks: a version that breaks one never becomes the current one."""
    totals = games(spark, sf).groupBy("nation").agg(F.count("*").alias("n"), F.sum("w").alias("wins"))
    path = _folder(spark, "published")
    S.publish(totals, path, {"counts": "n > 0", "wins": "wins IS NULL OR wins <= n"})
    try:
        S.publish(totals.withColumn("n", -F.col("n")), path, {"counts": "n > 0"})
    except ValueError:
        return S.published(spark, path)
    raise AssertionError("a broken version was published")


@query("s16_line_records", "SELECT mode, count(*) AS n, count(w) AS decided, round(sum(amount), 2) AS amount FROM games GROUP BY mode", "games")
def s16(spark, sf):
    """Records written as JSON lines in folders of their own, and all folders read again under one schema; a null stays one."""
    g, root = games(spark, sf).select("game", "mode", "w", "amount"), _folder(spark, "lines")
    for k, part in enumerate((g.where("w = 1"), g.where("w = 0"), g.where("w IS NULL"))):
        part.write.json(f"{root}/{k}")
    lines = S.read_any(spark, f"{root}/*", "json", g.schema)
    return lines.groupBy("mode").agg(F.count("*").alias("n"), F.count("w").alias("decided"), F.round(F.sum("amount"), 2).alias("amount"))


@query("f08_range_errors", "WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS a, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-02-30') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS b FROM orders) SELECT CASE WHEN a IS NULL OR b IS NULL OR NOT regexp_full_match(b, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'dates are written YYYY-MM-DD' WHEN try_cast(b AS DATE) IS NULL THEN 'no such date' WHEN a > b THEN 'the range ends before it starts' ELSE 'fine' END AS problem, count(*) AS n FROM r GROUP BY 1")
def f08(spark, sf):
    """What is wrong with ranges that orders give: an end that is missing, later, earlier, impossible or written otherwise."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    end = F.when(k == 1, day(d + F.expr("INTERVAL 30 DAY"))).when(k == 2, day(d - F.expr("INTERVAL 1 DAY"))).when(k == 3, F.concat(F.date_format(d, "yyyy"), F.lit("-02-30"))).when(k == 4, F.date_format(d, "dd.MM.yyyy"))
    return load(spark, sf, "orders").groupBy(F.coalesce(range_error(day(d), end), F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))
