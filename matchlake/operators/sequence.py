"""Sequence operators: islands, sessions, sets, streaks, splits and series thinning.

All partition by an owner, so that no window spans the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_win_rate(df: DataFrame, keys: list[str], order: list[str], n: int = 150, least: int = 10) -> DataFrame:
    """Over decided rows, the trailing percentage of wins once min(n, least) are there."""
    decided = df.where("w IS NOT NULL")
    whole = Window.partitionBy(*keys).orderBy(*order)
    rate = F.avg("w").over(whole.rowsBetween(-(n - 1), 0)) * 100
    return decided.withColumn("win_rate", rate).withColumn("rn", F.row_number().over(whole)).where(F.col("rn") >= min(n, least))


def islands(df: DataFrame, keys: list[str], order: list[str], kind: str, out: str = "island") -> DataFrame:
    """Number of the run of equal kinds that a row is in (rows without a kind are dropped)."""
    whole = Window.partitionBy(*keys).orderBy(*order)
    known = df.where(F.col(kind).isNotNull())
    change = (F.lag(kind).over(whole).isNull() | (F.lag(kind).over(whole) != F.col(kind))).cast("int")
    return known.withColumn("_c", change).withColumn(out, F.sum("_c").over(whole)).drop("_c")


def current_streak(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Kind and length of the last run of results."""
    runs = islands(df, keys, order, "w").groupBy(*keys, "island").agg(F.first("w").alias("kind"), F.count("*").alias("length"))
    last = F.max_by(F.struct("kind", "length"), "island")
    return runs.groupBy(*keys).agg(last.alias("s")).select(*keys, "s.kind", "s.length")


def longest_streaks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Longest run of wins and of losses; null if there is none."""
    runs = islands(df, keys, order, "w").groupBy(*keys, "island").agg(F.first("w").alias("kind"), F.count("*").alias("length"))
    return runs.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 1, F.col("length"))).alias("best_win_streak"), F.max(F.when(F.col("kind") == 0, F.col("length"))).alias("best_loss_streak"))


def sessions(df: DataFrame, keys: list[str], ts: str, end: Column, gap: str, order: list[str], out: str = "session") -> DataFrame:
    """Session number: a new one where a start lies more than the gap after the previous row's end."""
    whole = Window.partitionBy(*keys).orderBy(*order)
    timed = df.where(F.col(ts).isNotNull()).withColumn("_end", end)
    new = F.coalesce((F.col(ts) > F.lag("_end").over(whole) + F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(1))
    return timed.withColumn("_n", new).withColumn(out, F.sum("_n").over(whole)).drop("_n")


POSITIONS = ("1-5", "6-10", "11-15", "16-20", "21+")


def position_bucket(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, POSITIONS)), F.least(F.lit(5), F.floor((n - 1) / 5) + 1).cast("int"))


def tilt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per decided row, the run it enters on: opener, W, 2+W, L, 2L or 3+L (keys should hold the session)."""
    whole = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(df, keys, order, "w").withColumn("_len", F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)))
    kind, length = F.lag("w").over(whole), F.lag("_len").over(whole)
    state = F.when(kind.isNull(), "opener").when((kind == 1) & (length == 1), "W").when(kind == 1, "2+W").when(length == 1, "L").when(length == 2, "2L").otherwise("3+L")
    return runs.withColumn("entering", state).drop("_len")


def sequence_groups(df: DataFrame, keys: list[str], order: list[str], ts: str, roster: str, gap: str, least: int = 2, most: int = 10) -> DataFrame:
    """Runs of one roster without a gap or a step back in time, of a size within the bounds."""
    whole = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(ts).over(whole)
    breaks = F.lag(roster).over(whole).isNull() | (F.lag(roster).over(whole) != F.col(roster)) | F.coalesce((F.col(ts) > before + F.expr(f"INTERVAL {gap}")) | (F.col(ts) < before), F.lit(False))
    marked = df.withColumn("_b", breaks.cast("int")).withColumn("run", F.sum("_b").over(whole)).drop("_b")
    sized = marked.withColumn("size", F.count("*").over(Window.partitionBy(*keys, "run")))
    return sized.where(F.col("size").between(least, most))


def best_of_three(df: DataFrame, keys: list[str], order: list[str], ts: str, end: Column, opponent: str, gap: str) -> DataFrame:
    """Decided sets against one opponent: games that start within the gap after the end of the one before, up to two wins.

    Games without an opponent or a date are left out and break nothing; those without a result sit inside a set.  Windows
    cut the blocks that cannot share a set; the reset on deciding folds over each block's short sorted array in the JVM.
    opened: the first result of the set.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    known = df.where(F.col(opponent).isNotNull() & F.col(ts).isNotNull()).withColumn("_end", end)
    stays = (F.lag(opponent).over(whole) == F.col(opponent)) & (F.col(ts) <= F.lag("_end").over(whole) + F.expr(f"INTERVAL {gap}"))
    marked = known.withColumn("_b", F.when(stays, 0).otherwise(1)).withColumn("block", F.sum("_b").over(whole)).withColumn("pos", F.row_number().over(whole).cast("long"))
    blocks = marked.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("w").cast("int").alias("w")))).alias("games"))
    set_type = "struct<games: bigint, wins: bigint, losses: bigint, first_pos: bigint, opened: int>"
    empty = F.struct(F.lit(None).cast(set_type).alias("now"), F.array().cast(f"array<{set_type}>").alias("done"))

    def step(a: Column, g: Column) -> Column:
        one = lambda name, more: F.coalesce(a["now"][name], F.lit(0).cast("long")) + more
        now = F.struct(
            one("games", F.lit(1)).alias("games"),
            one("wins", F.when(g["w"] == 1, 1).otherwise(0)).alias("wins"),
            one("losses", F.when(g["w"] == 0, 1).otherwise(0)).alias("losses"),
            F.coalesce(a["now"]["first_pos"], g["pos"]).alias("first_pos"),
            F.coalesce(a["now"]["opened"], g["w"]).alias("opened"),
        ).cast(set_type)
        over = F.greatest(now["wins"], now["losses"]) == 2
        return F.struct(F.when(~over, now).alias("now"), F.when(over, F.concat(a["done"], F.array(now))).otherwise(a["done"]).alias("done"))

    sets = blocks.select(*keys, "block", F.posexplode(F.aggregate("games", empty, step, lambda a: a["done"])).alias("set_no", "s"))
    return sets.select(*keys, "block", (F.col("set_no") + 1).cast("long").alias("set_no"), "s.*")


def median_split(df: DataFrame, keys: list[str], by: str, order: list[str]) -> DataFrame:
    """Win rate of the lower and the upper half by usage; the middle row of an odd count is in neither."""
    w = Window.partitionBy(*keys).orderBy(by, *order)
    n, half = F.count("*").over(Window.partitionBy(*keys)), F.floor(F.col("_n") / 2)
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
    side = F.when(F.col("_rn") <= half, "low").when(F.col("_rn") > F.col("_n") - half, "high")
    got = ranked.withColumn("_side", side).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_side") == "low", F.col("w"))).alias("low"), F.avg(F.when(F.col("_side") == "high", F.col("w"))).alias("high"))
    return got.withColumn("delta", F.col("high") - F.col("low"))


def ranked(df: DataFrame, keys: list[str], by: str, order: list[str], slices: int = 64) -> DataFrame:
    """_i (from 0) and _n: a row's place among those of its keys by (by, order), and their number.

    Approximate quantiles cut the values into slices that are sorted apart; counts of the slices give the offsets, so places are exact
    wherever the cuts fall and no task sorts a whole key.
    """
    c = F.col
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(by, F.array(*(F.lit(k / slices) for k in range(1, slices))), 10_000)).alias("_cuts"))
    dealt = df.join(cuts, keys).withColumn("_s", F.size(F.filter("_cuts", lambda x: x < c(by)))).drop("_cuts")
    counts = dealt.groupBy(*keys, "_s").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_s", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(by, *order)) - 1
    return dealt.withColumn("_own", own).join(offsets, [*keys, "_s"]).withColumn("_i", c("_own") + c("_o")).drop("_own", "_o", "_s")


def quartile_rates(df: DataFrame, keys: list[str], by: str, order: list[str], least: int = 40) -> DataFrame:
    """Win rate, size and bounds of four slices cut at floor(q n / 4) (ntile would put extras first)."""
    placed = ranked(df, keys, by, order).where(F.col("_n") >= least)
    q = F.when(F.col("_i") < F.floor(F.col("_n") / 4), 1).when(F.col("_i") < F.floor(F.col("_n") / 2), 2).when(F.col("_i") < F.floor(3 * F.col("_n") / 4), 3).otherwise(4)
    return placed.withColumn("quartile", q).groupBy(*keys, "quartile").agg(F.count("*").alias("n"), F.avg("w").alias("win_rate"), F.min(by).alias("lo"), F.max(by).alias("hi"))


def thin(df: DataFrame, keys: list[str], order: list[str], most: int = 800) -> DataFrame:
    """At most so many rows per key, evenly apart, the last always in."""
    rn, n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_rn", rn).withColumn("_n", n).where((F.col("_n") - F.col("_rn")) % F.ceil(F.col("_n") / most) == 0).drop("_rn", "_n")


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties, from counts per distinct score."""
    counts = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("u", F.col("p") * (below + F.col("n") / 2)).groupBy(*keys).agg((F.sum("u") / F.when(F.sum("p") * F.sum("n") > 0, F.sum("p") * F.sum("n"))).alias("auc"))


def storylines(df: DataFrame, key: str, edition: str, n: str, rank: str) -> DataFrame:
    """Per key: first edition, whether it came later than the first of all, first peak, first best rank, count in the latest."""
    latest = df.agg(F.max(edition).alias("_latest"), F.min(edition).alias("_first"))  # one row
    got = df.crossJoin(F.broadcast(latest)).groupBy(key).agg(
        F.min(edition).alias("arrival"),
        (F.min(edition) > F.first("_first")).alias("newcomer"),
        F.min_by(edition, F.struct(-F.col(n), F.col(edition))).alias("peak_year"),
        F.max(n).alias("peak"),
        F.min_by(edition, F.struct(F.col(rank), F.col(edition))).alias("best_year"),
        F.min(rank).alias("best_rank"),
        F.coalesce(F.max(F.when(F.col(edition) == F.col("_latest"), F.col(n))), F.lit(0)).alias("current"),
    )
    return got
