"""Interactions out of frame streams: defensive choices, recoveries and edgeguards, special moves.

frames: game, player (0 or 1), frame, state, percent, stocks, last_hit_by, airborne, hitlag, x, y, and further columns
that an operator names.  A game is one singles match of two players with a row per frame each, or per spell: where frames hold
the column spell, a row stands for that many frames from frame on, in which nothing of either player changes but counter, which rises
by one a frame; c_stick is then that of the first.  Both players' rows have the same bounds.  The opponent's columns may be given as o_ and the name.
Everything before the folds is windows over a
player's frames, so frames that are dealt by game stay where they are; a fold sees one choice (thirty frames at most) or one stretch between calm phases, never a whole game, and
runs in the JVM.  A player's stream with a gap, a repeat, or a missing measurement has no result, which is not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Numbers of animation states.
FIRST, FIRST_PLAYABLE = -123, -39
DEAD = (0, 10)
DAMAGE = (75, 91)
DAMAGE_FALL, JAB_RESETS = 38, (185, 193)
HURT = (DAMAGE, (DAMAGE_FALL, DAMAGE_FALL), *((s, s) for s in JAB_RESETS))
HELD = ((223, 232), (266, 292), (294, 304), (327, 338))  # by grabs and command grabs; 293 is the barrel
LEDGE = (252, 253)
SHIELDS, SHIELD_HIT, SHIELD_RELEASES = (178, 179, 181, 182), 181, (180, 14)
AIR_JUMPS, JUMPS, FALLS = (27, 28), (24, 28), (29, 34)
AERIALS, FLAT_AERIALS, FLAT = (65, 69), (347, 349), 24
AIR_DODGE, SPECIAL_LANDING, FIRST_SPECIAL = 236, 43, 341
SHIELD_BREAK, CLIFF_FALL = (205, 211), 251
DOWN, ENTRY, TUMBLES = (183, 204), (12, 13), (29, 38)
ATTACKS = ((44, 69), (212, 222))
# Half-widths of the ground by stage (3 only where its shape is frozen).
EDGES = {2: 63.3475494385, 3: 87.75, 8: 56.0, 28: 77.2713012695, 31: 68.4000015259, 32: 85.5656967163}

WINDOW, SHIELD_SEQUENCE, LEDGE_SEQUENCE = 30, 15, 30
RETURN_FRAMES, LAUNCH_FRAMES = 30, 15
APPROACH, HEIGHT, DEPTH, MARGIN, NEAR, NEAR_EDGE, AT_EDGE = 40, 5, 20, 2, 60, 25, 12
NEVER = -1_000_000
ROUTES, TACTICS = ("unknown", "high", "low", "mixed"), ("holdLedge", "onstage", "high", "low")


def within(state: Column, *bounds: tuple[int, int]) -> Column:
    """Whether the state is in one of the ranges, ends included, by a list: long chains of comparisons make methods that the JVM does not compile."""
    flags = (any(low <= k <= high for low, high in bounds) for k in range(max(high for _, high in bounds) + 1))
    return F.coalesce(F.get(F.expr(f"array({', '.join(str(x).lower() for x in flags)})"), state), F.lit(False))


def dead(state: Column) -> Column:
    return within(state, DEAD)


def damaged(state: Column) -> Column:
    return within(state, *HURT)


def captured(state: Column) -> Column:
    return within(state, *HELD)


def disrupted(state: Column) -> Column:
    return within(state, DEAD, *HURT, *HELD, SHIELD_BREAK, (CLIFF_FALL, CLIFF_FALL))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_opponent(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with the opponent's columns of the same frames as o_, and with spell; null where that row is missing."""
    rows = frames if "spell" in frames.columns else frames.withColumn("spell", F.lit(1))
    if all(f"o_{c}" in frames.columns for c in columns):
        return rows
    other = rows.select("game", (1 - F.col("player")).alias("player"), "frame", "spell", *(F.col(c).alias(f"o_{c}") for c in columns))
    return rows.join(other, ["game", "player", "frame", "spell"], "left")


def end() -> Column:
    """The last frame of a row."""
    return F.col("frame") + F.col("spell") - 1


def measured(rows: DataFrame, needed: list[str], keys: list[str], first: int | None = None) -> DataFrame:
    """Only the keys whose frames are contiguous and unrepeated from first to the game's last one, and have all needed columns."""
    w = Window.partitionBy(*keys)
    per = 1 if "player" in keys else 2
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull()
    n, low, high = F.sum("spell").over(w), F.min("frame").over(w), F.max(end()).over(w)
    steady = F.lag(end()).over(Window.partitionBy("game", "player").orderBy("frame"))
    out = rows.withColumn("_before", steady).withColumn("_bad", missing | (F.col("_before") != F.col("frame") - 1))
    game = Window.partitionBy("game")
    fine = (low == F.min("frame").over(game)) & (high == F.max(end()).over(game)) & (n == per * (high - low + 1)) & ~F.coalesce(F.max("_bad").over(w), F.lit(False))
    return out.withColumn("_fine", fine & (low == first) if first is not None else fine).where("_fine").drop("_before", "_bad", "_fine")


# --- defensive choices -----------------------------------------------------------------------------------------


def defensive_choices(frames: DataFrame, first: int = FIRST) -> DataFrame:
    """A row for each choice from ledge or shield: game, player, section, option, start, end, outcome, c_stick.

    frames also hold: character, landed_dodge (an air dodge that landed within its frame), c_stick (null: unknown).
    A shield exit within WINDOW frames of a hit on that shield is oos, else shieldExits.  What comes first of a hit
    or grab either way within WINDOW frames (the start included) is the outcome; a death, a disruption or the next choice leaves it incomplete.
    """
    c = F.col
    rows = with_opponent(frames, ["state", "percent", "stocks", "last_hit_by", "hitlag"])
    needed = ["state", "percent", "stocks", "last_hit_by", "airborne", "character", "o_state", "o_percent", "o_stocks", "o_last_hit_by"]
    rows = measured(rows, needed, ["game", "player"], first)
    w = Window.partitionBy("game", "player").orderBy("frame")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    old = {x: F.lag(x).over(w) for x in ("state", "percent", "stocks", "o_state", "o_percent", "o_stocks")}
    rows = rows.withColumns({f"p_{x}": v for x, v in old.items()})
    held = F.max(F.when(c("state") == SHIELD_HIT, end())).over(before)
    loose = F.max(F.when(~c("state").isin(*SHIELDS), end())).over(before)
    hit_shield = (held > F.coalesce(loose, F.lit(NEVER))) & (c("frame") - held <= WINDOW)
    free = (c("stocks") == c("p_stocks")) & ~disrupted(c("state"))
    from_ledge = c("p_state").isin(*LEDGE) & ~c("state").isin(*LEDGE)
    from_shield = c("p_state").isin(*SHIELDS) & ~c("state").isin(*SHIELDS)
    section = F.when(free & from_ledge, "ledge").when(free & from_shield, F.when(F.coalesce(hit_shield, F.lit(False)), "oos").otherwise("shieldExits"))
    touched = lambda s, p, k, b, n, h, ps, pp, pk, by: (k == pk) & ((captured(s) & ~captured(ps)) | ((p > pp) & (b == by) & (damaged(s) | (F.coalesce(h, F.lit(0.0)) > 0))))
    taken = touched(c("state"), c("percent"), c("stocks"), c("last_hit_by"), None, c("hitlag"), c("p_state"), c("p_percent"), c("p_stocks"), 1 - c("player"))
    given = touched(c("o_state"), c("o_percent"), c("o_stocks"), c("o_last_hit_by"), None, c("o_hitlag"), c("p_o_state"), c("p_o_percent"), c("p_o_stocks"), c("player"))
    lost = (c("stocks") != c("p_stocks")) | (c("o_stocks") != c("p_o_stocks")) | dead(c("state")) | dead(c("o_state")) | disrupted(c("state"))
    told = F.when(taken & given, "traded").when(taken, "punished").when(given, "hit").when(lost, "incomplete")
    rows = rows.withColumn("section", section).withColumn("told", told).withColumn("choice", F.count("section").over(upto)).withColumn("last", F.max(end()).over(Window.partitionBy("game", "player")))
    rows = rows.where("choice > 0").withColumn("start", F.max(F.when(c("section").isNotNull(), c("frame"))).over(upto))
    rows = rows.where(c("frame") - c("start") < WINDOW)
    flat = (c("character") == FLAT) & within(c("state"), FLAT_AERIALS)
    step = F.struct("frame", end().alias("to"), "state", "airborne", (within(c("state"), AERIALS) | flat).alias("aerial"), F.coalesce("landed_dodge", F.lit(False)).alias("landed_dodge"), disrupted(c("state")).alias("disrupted"), "c_stick", "section")
    rows = rows.withColumns({"step": step, "at": F.when(c("told").isNotNull(), c("frame")), "seen": end()})  # before the aggregate, which interprets what it collects
    got = rows.groupBy("game", "player", "choice", "start").agg(F.sort_array(F.collect_list("step")).alias("steps"), F.min_by("told", "at").alias("told"), F.min("at").alias("at"), F.max("seen").alias("seen"), F.max("last").alias("last"))
    got = got.withColumn("next", F.lead("start").over(Window.partitionBy("game", "player").orderBy("choice")))
    quiet = c("at").isNull() & (c("seen") - c("start") >= WINDOW - 1)
    got = got.withColumn("told", F.when(quiet, "noHit").otherwise(c("told"))).withColumn("at", F.when(quiet, c("start") + WINDOW - 1).otherwise(c("at")))
    got = got.withColumn("end", F.coalesce("at", "next", "last")).withColumn("section", c("steps")[0]["section"])
    option = F.when(c("section") == "ledge", _ledge_option()).otherwise(_shield_option())
    eligible = c("_first").isin("jump", "aerial", "wavedash", "rollForward", "rollBackward", "spotDodge") & c("option").isin("jump", "aerial", "wavedash", "rollForward", "rollBackward", "spotDodge") & (c("section") != "ledge")
    got = got.withColumn("_first", F.when(c("section") == "ledge", _ledge_start(c("steps")[0])).otherwise(_shield_start(c("steps")[0]))).withColumn("option", option)
    return got.select("game", "player", "section", "option", "start", "end", F.coalesce("told", F.lit("incomplete")).alias("outcome"), F.when(eligible, c("steps")[0]["c_stick"]).alias("c_stick"))


def _ledge_start(s: Column) -> Column:
    state = s["state"]
    out = F.when(state.isin(254, 255), "getup").when(state.isin(256, 257), "attack").when(state.isin(258, 259), "roll").when(state.between(260, 263), "jump")
    return out.when(state.isin(*AIR_JUMPS), "dropJump").when(within(state, FALLS), "drop").when(s["aerial"], "dropAerial").otherwise("unknown")


def _shield_start(s: Column) -> Column:
    state = s["state"]
    out = F.when(state.isin(212, 214), "grab").when(state == 233, "rollForward").when(state == 234, "rollBackward").when(state == 235, "spotDodge")
    return out.when(within(state, JUMPS), "jump").when(within(state, FALLS) | (state == 244), "fall").when(state.isin(*SHIELD_RELEASES), "shieldRelease").otherwise("unknown")


def _sequence(start: Column, goes_on: list[str], jumped: Column, limit: int, judge) -> Column:
    """The option after the steps: judge(state of the fold, step) gives the next (option, open, jumped, dodged) while it is open."""
    s0 = F.col("steps")[0]
    zero = F.struct(start.alias("option"), start.isin(*goes_on).alias("open"), jumped.alias("jumped"), F.lit(False).alias("dodged"))

    def fold(a: Column, s: Column) -> Column:
        # Judged at its first frame after the start; more frames alike change nothing.
        at = F.greatest(s["frame"], s0["frame"] + 1)
        over = (at > s["to"]) | F.coalesce(at > F.col("at"), F.lit(False))
        late = at - s0["frame"] >= limit
        shut = F.struct(a["option"].alias("option"), F.lit(False).alias("open"), a["jumped"].alias("jumped"), a["dodged"].alias("dodged"))
        return F.when(~a["open"] | over, a).when(late, shut).when(s["disrupted"], a).otherwise(judge(a, s))

    return F.aggregate(F.col("steps"), zero, fold)["option"]


def _next(option: Column | str, open_: bool, jumped: Column, dodged: Column) -> Column:
    return F.struct((F.lit(option) if isinstance(option, str) else option).alias("option"), F.lit(open_).alias("open"), jumped.alias("jumped"), dodged.alias("dodged"))


def _ledge_option() -> Column:
    s0 = F.col("steps")[0]

    def judge(a: Column, s: Column) -> Column:
        state, jumped, dodged = s["state"], a["jumped"], a["dodged"]
        dash = jumped & (dodged | s["landed_dodge"]) & (state == SPECIAL_LANDING)
        grounded = F.when(dash, "ledgedash").when(state >= FIRST_SPECIAL, "unknown").otherwise(a["option"])
        out = F.when(state.isin(*LEDGE), _next("regrab", False, jumped, dodged)).when(state.isin(*AIR_JUMPS), _next("dropJump", True, F.lit(True), dodged)).when(s["aerial"], _next("dropAerial", False, jumped, dodged))
        out = out.when(state == AIR_DODGE, _next(a["option"], True, jumped, F.lit(True))).when(~s["airborne"], _next(grounded, False, jumped, dodged))
        return out.when(~within(state, FALLS), _next("unknown", False, jumped, dodged)).otherwise(a)

    return _sequence(_ledge_start(s0), ["drop", "dropJump"], s0["state"].isin(*AIR_JUMPS), LEDGE_SEQUENCE, judge)


def _shield_option() -> Column:
    s0 = F.col("steps")[0]

    def judge(a: Column, s: Column) -> Column:
        state, jumped, dodged = s["state"], a["jumped"], a["dodged"]
        dash = jumped & (dodged | s["landed_dodge"]) & (state == SPECIAL_LANDING)
        grounded = F.when(dash, "wavedash").when(state >= FIRST_SPECIAL, "unknown").otherwise(a["option"])
        out = F.when(s["aerial"], _next("aerial", False, jumped, dodged)).when(state == AIR_DODGE, _next(a["option"], True, jumped, F.lit(True)))
        out = out.when(within(state, JUMPS) | within(state, FALLS), _next(a["option"], True, F.lit(True), dodged))
        return out.when(~s["airborne"], _next(grounded, False, jumped, dodged)).otherwise(_next("unknown", False, jumped, dodged))

    return _sequence(_shield_start(s0), ["jump"], within(s0["state"], JUMPS), SHIELD_SEQUENCE, judge)


def choice_counts(choices: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of outcomes per keys, section and option; C-stick inputs only where samples were recorded."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return choices.groupBy(*keys, "section", "option").agg(F.count("*").alias("attempts"), of("punished"), of("hit"), of("traded"), of("noHit"), of("incomplete"), F.count("c_stick").alias("c_samples"), F.count_if("c_stick").alias("c_inputs"))


# --- recoveries and edgeguards ---------------------------------------------------------------------------------


def recoveries(frames: DataFrame, games: DataFrame | None = None) -> DataFrame:
    """A row for each recovery: game, player, started, ended, route, tactic, outcome, ledge, hit, opponent_lost.

    games: game, edge (half-width of the ground; null or a game that is not measured gives none); without games, frames hold edge.  An episode opens when a player
    is launched off the stage (or was within LAUNCH_FRAMES), counts once the player acts out there or takes the ledge, and ends by a
    death or RETURN_FRAMES steady frames after landing; at the end of the stream it is incomplete.  The route is where the approach was seen, the tactic what the
    opponent was seen to do.
    """
    c = F.col
    rows = with_opponent(frames, ["state", "stocks", "x", "y"])
    rows = rows.where("edge IS NOT NULL") if games is None else rows.join(games.where("edge IS NOT NULL"), "game")
    rows = measured(rows, ["state", "percent", "stocks", "last_hit_by", "airborne", "x", "y"], ["game"])
    w = Window.partitionBy("game", "player").orderBy("frame")
    early = c("frame") < FIRST_PLAYABLE  # a spell that goes on into play has itself before
    rows = rows.withColumns({f"p_{x}": F.lag(x).over(w) for x in ("percent", "stocks", "x")}).where(end() >= FIRST_PLAYABLE)
    rows = rows.withColumns({f"p_{x}": F.when(early, c(x)).otherwise(c(f"p_{x}")) for x in ("percent", "stocks", "x")} | {"frame": F.greatest("frame", F.lit(FIRST_PLAYABLE)), "spell": F.when(early, end() - FIRST_PLAYABLE + 1).otherwise(c("spell"))})
    state, ostate, edge = c("state"), c("o_state"), c("edge")
    cliff = lambda s: s.isin(*LEDGE)
    disabled = lambda s: within(s, DAMAGE, *HELD, DEAD, ENTRY, (CLIFF_FALL, CLIFF_FALL), DOWN)
    off = lambda x, y: (F.abs(x) > edge + MARGIN) | ((F.abs(x) > edge - 4) & (y < -HEIGHT)) | (y < -DEPTH)
    on = lambda x, y: (F.abs(x) <= edge) & (y >= -HEIGHT)
    by_opponent = c("last_hit_by") == 1 - c("player")
    hit = F.coalesce((c("stocks") == c("p_stocks")) & (c("percent") > c("p_percent")) & by_opponent & (within(state, DAMAGE, *HELD) | (F.coalesce("hitlag", F.lit(0.0)) > 0)), F.lit(False))
    rows = rows.withColumns({"hit": hit, "fell": F.coalesce(c("stocks") < c("p_stocks"), F.lit(False)), "outside": off(c("x"), c("y")), "inside": on(c("x"), c("y")), "disabled": disabled(state), "cliff": cliff(state)})
    rows = rows.withColumns({"launched": (within(state, DAMAGE) & by_opponent) | (state == CLIFF_FALL), "passive": within(state, DOWN, TUMBLES, (42, 43))})
    rows = rows.withColumn("calm", ~c("outside") & ~c("disabled") & ~c("airborne") & ~c("passive")).withColumn("steady", c("inside") & ~c("disabled") & ~c("cliff"))
    act = c("outside") & ~c("disabled") & ~c("cliff")
    near = F.abs("x") <= edge + APPROACH
    attacking = within(ostate, *ATTACKS) | (ostate >= FIRST_SPECIAL)
    close = F.hypot(c("o_x") - c("x"), c("o_y") - c("y")) <= NEAR
    coming = c("outside") | c("cliff")
    opponent = {"o_off": off(c("o_x"), c("o_y")), "o_on": on(c("o_x"), c("o_y")), "o_disabled": disabled(ostate), "grips": coming & cliff(ostate) & (F.abs(F.abs("o_x") - edge) <= AT_EDGE), "chases": coming & close, "strikes": attacking & (F.abs("o_x") >= edge - NEAR_EDGE) & close}

    def tactic(side: int, hit: Column) -> Column:
        same = c("o_x") * F.when(c("x") != 0, F.signum("x")).otherwise(F.lit(float(side))) > 0
        away, home = c("o_off") & (hit | c("chases")), c("o_on") & (hit | c("strikes"))
        found = F.when(c("grips") & same, 1).when(~same, F.when(hit & c("o_on"), 2).otherwise(0)).when(away, F.when(c("o_y") < 0, 8).otherwise(4)).when(home, 2).otherwise(0)
        return F.when(c("o_disabled") & ~hit, 0).otherwise(found)

    def row(frame: Column, spell: Column, hit: Column, fell: Column, before: Column, right: str, left: str) -> Column:
        died = dead(state) | fell
        side = F.signum(F.coalesce(F.nullif(c("x"), F.lit(0.0)), F.nullif(before, F.lit(0.0)), F.lit(1.0))).cast("int")
        return F.struct(frame.alias("frame"), spell.alias("spell"), hit.alias("hit"), died.alias("died"), "airborne", (hit | c("launched")).alias("launched"), "passive", "calm", "steady", (c("outside") & c("airborne") & ~died).alias("leaves"), act.alias("acts"), (act & near & (c("y") > HEIGHT)).alias("high"), (act & near & (c("y") < -HEIGHT)).alias("low"), "cliff", (c("inside") & ~c("airborne")).alias("lands"), c(right).alias("right"), c(left).alias("left"), side.alias("side"), "o_stocks", dead(ostate).alias("o_dead"))

    no = F.lit(False)
    # Calm phases: more than RETURN_FRAMES steady frames without a hit since one on the ground, on the ground still; whatever went on is over.
    broken = F.sum((~c("steady") | c("hit")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_run", broken).withColumn("_free", c("frame") + c("hit").cast("int"))  # a hit is only in a row's first frame
    run = Window.partitionBy("game", "player", "_run").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_ground", F.min(F.when(c("steady") & ~c("airborne") & (c("_free") <= end()), c("_free"))).over(run))
    rows = rows.withColumns(opponent)
    rows = rows.withColumns({"right": tactic(1, c("hit")), "left": tactic(-1, c("hit")), "right_later": tactic(1, no), "left_later": tactic(-1, no)})
    over = F.when(c("steady") & c("calm"), F.greatest("_free", c("_ground") + RETURN_FRAMES))
    rows = rows.withColumn("_over", F.when(over <= end(), over))  # null: no frame of the row
    rows = rows.withColumn("stretch", F.coalesce(F.sum(c("_over").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("spell", F.coalesce("_over", end() + 1) - c("frame")).where("spell > 0")
    # The first frame of a spell is a row of its own where it may differ from the others by what was before it.
    differs = (c("spell") > 1) & (c("hit") | c("fell") | F.coalesce((c("x") == 0) & (c("p_x") != 0), F.lit(False)))
    first = row(c("frame"), F.when(differs, 1).otherwise(c("spell")), c("hit"), c("fell"), c("p_x"), "right", "left")
    parts = F.when(differs, F.array(first, row(c("frame") + 1, c("spell") - 1, no, no, c("x"), "right_later", "left_later"))).otherwise(F.array(first))
    # Only stretches that leave the stage after a launch are folded, from that on.
    rows = rows.withColumns({"row": F.struct("frame", parts.alias("parts")), "off": F.when(c("outside") & c("airborne"), end()), "launch": F.when(c("launched") | c("hit"), c("frame")), "last": end()})  # before the aggregate, which interprets what it collects
    stretches = rows.groupBy("game", "player", "stretch").agg(F.collect_list("row").alias("rows"), F.max("off").alias("off"), F.min("launch").alias("launch"), F.max("last").alias("last")).where("launch <= off")
    stretches = stretches.withColumn("rows", F.sort_array(F.filter("rows", lambda r: r["frame"] >= c("launch"))))
    folded = stretches.select("game", "player", _recovery_fold(F.flatten(c("rows.parts"))).alias("s"), "last")
    left_over = F.when(c("s.now.on") & c("s.now.eligible"), F.array(_record(c("s.now"), F.lit("incomplete"), c("last")))).otherwise(F.slice(c("s.out"), 1, 0))
    return folded.select("game", "player", F.inline(F.concat(c("s.out"), left_over)))


_EPISODE = {"on": "boolean", "side": "int", "started": "int", "eligible": "boolean", "ledge": "boolean", "was_hit": "boolean", "landed": "boolean", "stable": "int", "high": "boolean", "low": "boolean", "approached": "boolean", "tactics": "int", "o_stocks": "int", "o_lost": "boolean"}
_RECORD = "struct<started:int,ended:int,route:string,tactic:string,outcome:string,ledge:boolean,hit:boolean,opponent_lost:boolean>"


def _record(s: Column, outcome: Column, at: Column) -> Column:
    route = F.when(s["high"] & s["low"], "mixed").when(s["high"], "high").when(s["low"], "low").otherwise("unknown")
    tactic = F.when(F.bit_count(s["tactics"]) > 1, "mixed")
    for k, name in enumerate(TACTICS):
        tactic = tactic.when(s["tactics"] == 1 << k, name)
    return F.struct(s["started"].alias("started"), at.cast("int").alias("ended"), route.alias("route"), tactic.otherwise("unknown").alias("tactic"), outcome.alias("outcome"), s["ledge"].alias("ledge"), s["was_hit"].alias("hit"), s["o_lost"].alias("opponent_lost")).cast(_RECORD)


def _recovery_fold(rows: Column) -> Column:
    """The state after a stretch of rows, with the episodes that ended in it (out).

    The frames of a row are alike, a hit or a loss of stocks is only in a row of one frame.  So an episode opens in a row's first frame or not in
    it, dies in the first, and all but the last frame that launches and the count of steady frames are as after the first two.
    """
    blank = lambda kind: F.lit(False if kind == "boolean" else 0).cast(kind)
    field = lambda name, value: value.cast(_EPISODE[name]).alias(name)
    none = F.struct(*(field(n, blank(kind)) for n, kind in _EPISODE.items()))
    state = lambda until, episode, out: F.struct(until.cast("int").alias("until"), episode.alias("now"), out.alias("out"))

    def step(a: Column, r: Column) -> Column:
        goes_on = r["launched"] | (r["passive"] & (a["until"] > NEVER))
        until = lambda frame: F.when(r["calm"], NEVER).when(goes_on, frame + LAUNCH_FRAMES).otherwise(a["until"])
        last = r["frame"] + r["spell"] - 1
        more = let(F.struct(until(last).cast("int").alias("until"), last.alias("last"), (~a["now"]["on"] & r["leaves"] & (until(r["frame"]) >= r["frame"])).alias("opens")), lambda u: opened(a, r, u))
        return F.when(a["now"]["on"] | r["launched"] | (a["until"] > NEVER), more).otherwise(a)

    def opened(a: Column, r: Column, u: Column) -> Column:
        fresh = {"on": F.lit(True), "side": r["side"], "started": r["frame"], "o_stocks": r["o_stocks"]}
        first = F.struct(*(field(n, fresh.get(n, blank(kind))) for n, kind in _EPISODE.items()))
        return F.when(a["now"]["on"] | u["opens"], let(F.when(u["opens"], first).otherwise(a["now"]), lambda e: seen(a, r, u, e))).otherwise(state(u["until"], a["now"], a["out"]))

    def seen(a: Column, r: Column, u: Column, e: Column) -> Column:
        later = u["last"] > e["started"]
        lost = e["o_lost"] | (r["o_stocks"] < e["o_stocks"]) | r["o_dead"]
        approached = e["approached"] | r["cliff"] | r["lands"]
        eligible = e["eligible"] | r["cliff"] | r["acts"]
        tactic = F.when(eligible & later & ~lost, F.when(e["side"] > 0, r["right"]).otherwise(r["left"])).otherwise(0)
        landed = r["steady"] & (e["landed"] | ~r["airborne"])
        stable = F.when(landed & ~r["hit"], e["stable"] + r["spell"]).otherwise(0)
        new = {"was_hit": e["was_hit"] | (r["hit"] & later), "o_lost": lost, "ledge": e["ledge"] | r["cliff"], "eligible": eligible, "approached": approached, "high": e["high"] | (r["high"] & ~approached), "low": e["low"] | (r["low"] & ~approached), "tactics": e["tactics"].bitwiseOR(tactic), "landed": landed, "stable": stable}
        return let(F.struct(*(field(n, new.get(n, e[n])) for n in _EPISODE)), lambda f: ended(a, r, u, f))

    def ended(a: Column, r: Column, u: Column, f: Column) -> Column:
        outcome = F.when(r["died"], "died").when(f["stable"] >= RETURN_FRAMES, "returned")
        at = F.when(r["died"], r["frame"]).otherwise(u["last"] - (f["stable"] - RETURN_FRAMES))
        over = state(F.lit(NEVER), none, F.when(f["eligible"], F.concat(a["out"], F.array(_record(f, outcome, at)))).otherwise(a["out"]))
        return F.when(outcome.isNull(), state(u["until"], f, a["out"])).otherwise(over)

    return F.aggregate(rows, state(F.lit(NEVER), none, F.array().cast(f"array<{_RECORD}>")), step)


def recovery_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes by route: attempts, reached_ledge, hit_during, returned, died, incomplete."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return found.groupBy(*keys, "route").agg(F.count("*").alias("attempts"), F.count_if("ledge").alias("reached_ledge"), F.count_if("hit").alias("hit_during"), of("returned"), of("died"), of("incomplete"))


def edgeguard_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes by the opponent's tactic; only completed contests are a base for stocks taken."""
    c = F.col
    contested, open_ = c("tactic") != "unknown", (c("outcome") == "incomplete") | c("opponent_lost")
    return found.groupBy(*keys, "tactic").agg(
        F.count("*").alias("opportunities"), F.count_if(contested).alias("contested"), F.count_if(contested & ~open_).alias("completed"), F.count_if(contested & ~open_ & (c("outcome") == "died")).alias("stocks_taken"),
        F.count_if(~open_ & (c("outcome") == "returned")).alias("opponent_returned"), F.count_if(~contested & ~open_ & (c("outcome") == "died")).alias("uncontested_deaths"), F.count_if(open_).alias("incomplete"),
    )


# --- special moves ---------------------------------------------------------------------------------------------


def special_attempts(frames: DataFrame, capabilities: DataFrame, characters: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """game, player, move, attempts, hit, no_hit, incomplete.

    frames also hold: character, counter (position in the animation), last_attack, instance, instance_hit_by (null: not recorded).
    capabilities: character, move, states, starts, restarts (arrays of states), outcomes (whether damage tells of a hit), most (greatest
    counter of a start), same_state (whether the same state's animation may begin anew); every task gets them whole.  characters: game, player, expected;
    without them, frames hold expected.

    An attempt begins in a start state with a counter of most at the highest while none is under way, or anew when the counter falls; it lasts
    until the first frame outside of the move's states.  Attempts are null where the stream has a gap, another character, or is joined within the
    move; outcomes are null where damage does not tell or a measurement is missing.
    """
    c = F.col
    rows = with_opponent(frames, ["state", "percent", "last_hit_by", "hitlag", "instance_hit_by"])
    rows = rows if characters is None else rows.join(characters, ["game", "player"])
    w = Window.partitionBy("game", "player").orderBy("frame")
    rows = rows.withColumns({"p_frame": F.lag(end()).over(w), "p_counter": F.lag(c("counter") + c("spell") - 1).over(w)} | {f"p_{x}": F.lag(x).over(w) for x in ("state", "character", "instance", "o_percent")})
    gap = F.when(c("p_frame").isNull(), c("frame") != first).otherwise(c("frame") != c("p_frame") + 1)
    broken = gap | c("state").isNull() | c("character").isNull() | (c("character") != c("expected"))
    damage = (c("o_percent") > c("p_o_percent")) & (c("o_last_hit_by") == c("player")) & (damaged(c("o_state")) | (F.coalesce("o_hitlag", F.lit(0.0)) > 0))
    same = F.when(c("o_instance_hit_by").isNotNull() & c("instance").isNotNull(), (c("o_instance_hit_by") != 0) & ((c("o_instance_hit_by") == c("instance")) | F.coalesce(c("o_instance_hit_by") == c("p_instance"), F.lit(False)))).otherwise(True)
    player = Window.partitionBy("game", "player")
    missing = c("o_percent").isNull() | c("o_last_hit_by").isNull() | c("last_attack").isNull()
    rows = rows.withColumns({"broken": F.max(broken).over(player), "missing": F.max(missing).over(player), "touch": F.coalesce(damage & same, F.lit(False))})
    # Of the rows outside of a move and not right after it only the stream's first is kept, so that a move without attempts has a count.
    moves = F.broadcast(capabilities.withColumnRenamed("character", "expected"))
    inside = lambda state: F.coalesce(F.array_contains("states", state), F.lit(False))
    rows = rows.join(moves, "expected").withColumns({"inside": inside(c("state")), "p_inside": inside(c("p_state"))}).where(c("inside") | c("p_inside") | c("p_frame").isNull())
    starts = c("inside") & F.coalesce(F.array_contains("starts", c("state")) & (c("counter") <= c("most")), F.lit(False))
    v = Window.partitionBy("game", "player", "move").orderBy("frame")
    again = c("p_inside") & starts & F.coalesce(c("counter") < c("p_counter"), F.lit(False)) & (c("p_character") == c("character")) & (((c("state") == c("p_state")) & c("same_state")) | F.coalesce(F.array_contains("restarts", c("p_state")), F.lit(False)))
    begins = (c("inside") & ~c("p_inside") & starts) | F.coalesce(again, F.lit(False))
    joined = (c("inside") & ~c("p_inside") & ~starts) | (c("inside") & c("counter").isNull())
    rows = rows.withColumns({"begins": begins, "joined": joined, "unknown": ~c("outcomes") | c("missing") | (begins & c("p_frame").isNull())})
    rows = rows.withColumn("attempt", F.sum(c("begins").cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    counted = c("inside") | c("p_inside")  # the frame after the move still tells of its hit
    per = rows.groupBy("game", "player", "move", "attempt").agg(
        F.max("begins").alias("is_attempt"), F.max(F.coalesce(counted & c("touch") & (c("last_attack") == c("move")), F.lit(False))).alias("hit"), F.max_by("inside", "frame").alias("open"), F.max("frame").alias("at"),
        F.max(c("broken") | c("joined")).alias("invalid"), F.max("unknown").alias("unknown"),
    )
    last = F.max("at").over(Window.partitionBy("game", "player", "move"))
    per = per.withColumn("open", c("open") & (c("at") == last))
    good, told = ~F.max("invalid"), ~F.max("invalid") & ~F.max("unknown")
    n = lambda x: F.count_if(c("is_attempt") & x)
    return per.groupBy("game", "player", "move").agg(F.when(good, n(F.lit(True))).alias("attempts"), F.when(told, n(c("hit"))).alias("hit"), F.when(told, n(~c("hit") & ~c("open"))).alias("no_hit"), F.when(told, n(~c("hit") & c("open"))).alias("incomplete"))
