"""Predicates, reconciliation, sync plans, checks and frame counters that need no window of their own module."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.scratch import discard, materialize

from matchlake.functions.scalar import code, decay


def capabilities(error: Column, version: Column, measured: Column, current: int) -> dict[str, Column]:
    full = error.isNull() & measured.isNotNull()
    return {"full_stats": full, "current_stats": (version >= current) & measured.isNotNull(), "needs_repair": error.isNull() & measured.isNull() & (version < current)}


def attempts_measured(special: Column, version: Column, attempts: Column, since: int) -> Column:
    return F.when(special, (version >= since) & attempts.isNotNull()).otherwise(attempts.isNotNull())


def clean_accounts(df: DataFrame, raw: str) -> DataFrame:
    """code, repeated, valid for every non-blank code in upper case."""
    own = df.select(code(F.col(raw)).alias("code")).where("code IS NOT NULL")
    return own.groupBy("code").agg((F.count("*") > 1).alias("repeated")).withColumn("valid", F.col("code").rlike(r"^[A-Z0-9]{1,8}#\d{1,4}$"))


def tiers(excluded: Column, verified: Column, evidence: Column, identity: Column) -> Column:
    """Exact evidence of identity lifts the unclassified to probable."""
    return F.when(excluded, "excluded").when(verified, "verified").when(evidence | identity, "probable").otherwise("unclassified")


def forbidden(df: DataFrame, name: str, value: str) -> DataFrame:
    """field, rows: columns whose name is private (all rows), or whose text values look private."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    count = {c: F.count_if(F.col(c).rlike(value)) for c in texts}
    count |= {c: F.count("*") for c in df.columns if re.search(name, c)}
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("field"), n.alias("rows")) for c, n in count.items())).alias("f"))
    return one.select(F.inline("f"))


def reasons(cases: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases.items())))


def one_to_one_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys lack a partner, and how many have several."""
    missing = left.join(right, key, "left_anti").agg(F.lit("missing").alias("problem"), F.count("*").alias("n"))
    return missing.unionByName(right.groupBy(key).count().where("count > 1").agg(F.lit("repeated").alias("problem"), F.count("*").alias("n")))


def reconcile(slots: DataFrame, candidates: DataFrame, slot: str, exact: Column, loose: Column) -> DataFrame:
    """status, slots by the first evidence that settles a slot."""
    found = candidates.select(slot, exact.alias("_e"), loose.alias("_l")).groupBy(slot).agg(F.count("*").alias("_n"), F.count_distinct("_e").alias("_exact"), F.count_distinct("_l").alias("_loose"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "unique").when(F.col("_exact") == 1, "exact").when(F.col("_loose") == 1, "normalised").otherwise("ambiguous")
    return slots.join(found, slot, "left").groupBy(status.alias("status")).agg(F.count("*").alias("slots"))


def dummy_levels(df: DataFrame, keys: list[str], level: str, least: int, most: int) -> DataFrame:
    counts = df.groupBy(*keys, level).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), level))
    return counts.withColumn("_r", rank).where(F.col("_r").between(2, most + 1)).drop("_r")


def batches(df: DataFrame, part: str, order: str, n: str, size: int) -> DataFrame:
    """Number of the batch that each whole bucket falls in, by the records before it."""
    before = F.sum(n).over(Window.partitionBy(part).orderBy(order)) - F.col(n)
    return df.withColumn("batch", F.floor(before / size))


def intake_state(fresh: Column, failed: Column, partial: Column) -> Column:
    return F.when(fresh, "deferred").when(failed, "failed").when(partial, "retry").otherwise("parsed")


def newest(df: DataFrame, keys: list[str], ts: str, tie: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(ts), F.desc(tie)))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def upgrade_plan(outdated: DataFrame, attempted: DataFrame, keys: list[str], key: str, ts: str, n: int) -> DataFrame:
    return newest(outdated.join(attempted, key, "left_anti"), keys, ts, key, n)


def sync_actions(local: DataFrame, remote: DataFrame, key: str, version: str) -> DataFrame:
    both = local.withColumnRenamed(version, "_l").join(remote.withColumnRenamed(version, "_r"), key, "full")
    pull, push = F.col("_l").isNull() | (F.col("_r") > F.col("_l")), F.col("_r").isNull() | (F.col("_l") > F.col("_r"))
    return both.select(key, F.when(pull, "pull").when(push, "push").otherwise("same").alias("action"))


def against_manifest(found: DataFrame, manifest: DataFrame, key: str, same: dict[str, str]) -> DataFrame:
    """found with state: ok, missing from the manifest, or the first figure that differs."""
    state = F.when(F.col(next(iter(same.values()))).isNull(), "missing")
    for own, stated in same.items():
        state = state.when(~F.col(own).eqNullSafe(F.col(stated)), own)
    return found.join(manifest, key, "left").withColumn("state", state.otherwise("ok"))


def validate(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """check, broken: rows that break each condition."""
    cells = F.array(*(F.struct(F.lit(n).alias("check"), F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias("broken")) for n, c in checks.items()))
    return df.agg(cells.alias("c")).select(F.inline("c"))


def full_seed_phase(df: DataFrame, event: str, phase: str, seed: str) -> DataFrame:
    whole = df.groupBy(event, phase).agg(F.count("*").alias("n"), F.count_distinct(seed).alias("d"), F.min(seed).alias("lo"), F.max(seed).alias("hi")).where("n = d AND lo = 1 AND hi = n")
    return whole.groupBy(event).agg(F.count("*").alias("_k"), F.min(phase).alias(phase)).where("_k = 1").drop("_k")


def form(df: DataFrame, keys: list[str], residual: Column, day: Column, cutoff: str, half_life: float, prior: float) -> DataFrame:
    weight = decay(F.datediff(F.lit(cutoff).cast("date"), day), half_life)
    return df.groupBy(*keys).agg((F.sum(residual * weight) / (F.sum(weight) + prior)).alias("form"))


# --- frames: each counter looks one frame back, so a window is all the state it needs -----------------------


def landings(df: DataFrame, keys: list[str], order: list[str], state: Column, aerial: tuple[int, int], ground: int, cancelled: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_s", state).withColumn("move", F.lag("_s").over(w)).where(F.col("move").between(*aerial) & (F.col("_s") < ground))
    return x.groupBy(*keys, "move").agg(F.count("*").alias("landings"), F.count_if(cancelled).alias("cancelled"))


def crouch_cancels(df: DataFrame, keys: list[str], order: list[str], percent: Column, state: Column, crouch: int, damaged: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_p", percent).withColumn("_s", state)
    hit = (F.col("_p") > F.lag("_p").over(w)) & (F.col("_s") >= damaged) & (F.lag("_s").over(w) == crouch)
    return x.withColumn("_h", hit).where("_h").groupBy(*keys).agg(F.count("*").alias("n"))


def damage_matrix(df: DataFrame, keys: list[str], order: list[str], percent: str, hitter: str, victim: Column) -> DataFrame:
    rise = F.col(percent) - F.lag(percent).over(Window.partitionBy(*keys).orderBy(*order))
    x = df.withColumn("_rise", rise).where("_rise > 0").withColumn("victim", victim)
    return x.groupBy(F.coalesce(hitter, "victim").alias("attacker"), "victim").agg(F.count("*").alias("hits"), F.sum("_rise").alias("damage"))


def conversions(df: DataFrame, keys: list[str], order: list[str], move: str, damage: str, kills: Column) -> DataFrame:
    whole = Window.partitionBy(*keys)
    x = df.withColumn("_i", F.row_number().over(whole.orderBy(*order))).withColumn("_n", F.count("*").over(whole)).withColumn("_t", F.sum(damage).over(whole))
    first = F.col("_i") == 1
    return x.groupBy(move).agg(F.count("*").alias("landed"), F.sum(damage).alias("damage"), F.count_if(first).alias("openings"), F.sum(F.when(first, F.col("_t"))).alias("opening_damage"), F.count_if((F.col("_i") == F.col("_n")) & kills).alias("kills"))


def winner(seconds: Column, placed: Column, out_first: Column, out_second: Column, quitter: Column) -> Column:
    """0 or 1; null for games under thirty seconds and those that nothing settles. out: has the side lost its last stock?"""
    survivor = F.when(out_first != out_second, F.when(out_first, 1).otherwise(0))
    return F.when(seconds >= 30, F.coalesce(placed, survivor, 1 - quitter))


def settle(uploads: DataFrame, keys: list[str], owner: str, least: int) -> DataFrame:
    """The owner of each key, the first of its uploaders, once nobody owns fewer than least keys.

    Who holds too little drops out and the next uploader of each key takes over, which may leave others with more, or in turn
    others with too little; rounds go on until nobody drops out.  A key whose uploaders have all dropped out has no owner.
    """
    left = materialize(uploads.select(owner).distinct(), "owners")
    while True:
        held = materialize(uploads.join(left, owner).groupBy(*keys).agg(F.min(owner).alias(owner)), "held")
        few = materialize(held.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") < least).select(owner), "few")
        if few.isEmpty():
            return held
        after = materialize(left.join(few, owner, "left_anti"), "owners")
        discard(left, held, few)
        left = after
