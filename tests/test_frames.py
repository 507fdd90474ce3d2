"""Interactions of frame streams against plain loops over a thousand random streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlake.operators import frames as K

EDGE = 68.4000015259
POOLS = [[14, 14, 20, 50], [85, 80, 88, 38], [252, 253], [254, 256, 258, 261, 27, 29, 30, 65, 70], [179, 181, 178], [180, 212, 233, 235, 25, 29, 244], [236, 43, 43, 15], [341, 343, 347], [227, 270], [0, 4], [190, 251, 12], [24, 25, 29, 33, 66]]


def stream(rng, game, length, first=K.FIRST):
    """Two players whose states linger, with hits, deaths and now and then a fault."""
    rows, who = [], [dict(state=14, percent=0.0, stocks=4, by=6, x=rng.uniform(-60, 60), y=0.0, counter=0.0, character=rng.choice([1, 1, 24])) for _ in range(2)]
    fault, calm = rng.random() < 0.15, 0.1 if game % 2 else 1.0
    for f in range(first, first + length):
        for p, s in enumerate(who):
            s["counter"] += 1
            if s.setdefault("plan", []):
                s["state"] = s["plan"].pop(0)
            elif rng.random() < 0.03:
                s["plan"] = rng.choice([[181, 179, 25, 236, 43, 43], [179, 25, 25, 43, 14], [252, 29, 27, 236, 43], [252, 252, 29, 30, 252], [181, 178, 24, 66, 15]])[:]
            elif rng.random() < 0.25 * calm:
                s["state"], s["counter"] = rng.choice(rng.choice(POOLS)), rng.choice([0.0, 0.0, 1.0, 4.0])
            elif rng.random() < 0.05:
                s["counter"] = 0.0
            if rng.random() < 0.08 * calm:
                s["percent"] += rng.choice([3.0, 8.0])
                s["by"] = rng.choice([1 - p, 1 - p, 6])
                s["state"] = rng.choice([85, 80, 14, 227])
            if rng.random() < 0.01 * calm:
                s["stocks"], s["percent"], s["state"] = s["stocks"] - 1, 0.0, 0
            s["x"] += rng.choice([0.0, 3.0, -3.0, 25.0, -25.0]) if rng.random() < 0.3 else 0.0
            s["x"] = max(-130.0, min(130.0, s["x"]))
            s["y"] = rng.choice([0.0, 0.0, 12.0, -12.0, -25.0]) if rng.random() < 0.2 else s["y"]
            air = s["state"] in (25, 27, 28, 29, 30, 33, 65, 66, 236, 85, 88, 252, 253) or rng.random() < 0.05
            row = dict(game=game, player=p, frame=f, state=s["state"], percent=s["percent"], stocks=s["stocks"], last_hit_by=s["by"], airborne=air, hitlag=rng.choice([0.0, 0.0, 3.0, None]), x=s["x"], y=s["y"])
            row |= dict(character=s["character"], counter=s["counter"], last_attack=rng.choice([18, 18, 19]), instance=rng.choice([None, 5, 6]), instance_hit_by=rng.choice([None, 0, 5, 6]), landed_dodge=rng.random() < 0.3, c_stick=rng.choice([None, True, False]))
            if fault and rng.random() < 1 / length:
                kind = rng.choice(["gap", "state", "percent", "character", "counter"])
                if kind == "gap":
                    continue
                row[kind] = None
            rows.append(row)
    return rows


def calm_stream(rng, game, length):
    """Longer quiet spells, so that episodes return and phases are cut."""
    rows = stream(rng, game, length)
    at = {}
    for r in rows:
        key = (r["player"], (r["frame"] + r["player"] * 7) // 45 % 2)
        at.setdefault(key, rng.choice([0.0, 20.0, -30.0]))
        if key[1]:
            r.update(state=14 if r["state"] is not None else None, x=at[key], y=0.0, airborne=False, percent=0.0, hitlag=0.0)
    return rows


SCHEMA = "game int, player int, frame int, state int, percent double, stocks int, last_hit_by int, airborne boolean, hitlag double, x double, y double, character int, counter double, last_attack int, instance int, instance_hit_by int, landed_dodge boolean, c_stick boolean"


def load(spark, rows):
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(object).where(lambda d: d.notna(), None)
    return spark.createDataFrame([tuple(int(v) if k in (0, 1, 2, 3, 5, 6, 11, 13, 14, 15) and v is not None else v for k, v in enumerate(r)) for r in pdf.itertuples(index=False)], SCHEMA)


def games_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["game"], {}).setdefault(r["frame"], {})[r["player"]] = r
    return out


def hurt(s):
    return 75 <= s <= 91 or s in (38, 185, 193)


def held(s):
    return 223 <= s <= 232 or ((266 <= s <= 304 or 327 <= s <= 338) and s != 293)


def upset(s):
    return 0 <= s <= 10 or hurt(s) or held(s) or 205 <= s <= 211 or s == 251


# choices


def plain_choices(rows):
    found = []
    for game, by in games_of(rows).items():
        span = range(min(by), max(by) + 1)
        for p in (0, 1):
            need = ("state", "percent", "stocks", "last_hit_by")
            if min(by) != K.FIRST or any(f not in by or any(q not in by[f] or any(by[f][q][c] is None for c in need) for q in (0, 1)) or by[f][p]["character"] is None for f in span):
                continue
            mine, theirs = [by[f][p] for f in span], [by[f][1 - p] for f in span]
            shield_hit, i = None, 0
            starts = []
            for i, m in enumerate(mine):
                if i and m["stocks"] == mine[i - 1]["stocks"] and not upset(m["state"]):
                    was = mine[i - 1]["state"]
                    if was in (252, 253) and m["state"] not in (252, 253):
                        starts.append((i, "ledge"))
                    elif was in K.SHIELDS and m["state"] not in K.SHIELDS:
                        starts.append((i, "oos" if shield_hit is not None and i - shield_hit <= 30 else "shieldExits"))
                shield_hit = i if m["state"] == 181 else shield_hit if m["state"] in K.SHIELDS else None
            for k, (at, section) in enumerate(starts):
                until = starts[k + 1][0] if k + 1 < len(starts) else len(mine)
                option, goes, jumped, dodged = opening(section, mine[at])
                told, end = None, None
                first = option
                for i in range(at, until):
                    m, t, m0, t0 = mine[i], theirs[i], mine[i - 1], theirs[i - 1]
                    if i > at and goes:
                        option, goes, jumped, dodged = going(section, option, jumped, dodged, m, i - at)
                    hit = lambda a, b, who: a["stocks"] == b["stocks"] and ((held(a["state"]) and not held(b["state"])) or (a["percent"] > b["percent"] and a["last_hit_by"] == who and (hurt(a["state"]) or (a["hitlag"] or 0) > 0)))
                    taken, given = hit(m, m0, 1 - p), hit(t, t0, p)
                    if taken or given:
                        told = "traded" if taken and given else "punished" if taken else "hit"
                    elif m["stocks"] != m0["stocks"] or t["stocks"] != t0["stocks"] or 0 <= m["state"] <= 10 or 0 <= t["state"] <= 10 or upset(m["state"]):
                        told = "incomplete"
                    elif i - at >= 29:
                        told = "noHit"
                    if told:
                        end = i
                        break
                moves = ("jump", "aerial", "wavedash", "rollForward", "rollBackward", "spotDodge")
                stick = mine[at]["c_stick"] if section != "ledge" and first in moves and option in moves else None
                last = end if told else until if k + 1 < len(starts) else len(mine) - 1
                found.append((game, p, section, option, at + K.FIRST, last + K.FIRST, told or "incomplete", stick))
    return found


def opening(section, m):
    s, fall, jump = m["state"], 29 <= m["state"] <= 34, m["state"] in (27, 28)
    if section == "ledge":
        named = {254: "getup", 255: "getup", 256: "attack", 257: "attack", 258: "roll", 259: "roll", 260: "jump", 261: "jump", 262: "jump", 263: "jump"}
        o = named.get(s) or ("dropJump" if jump else "drop" if fall else "dropAerial" if flying(m) else "unknown")
        return o, o in ("drop", "dropJump"), jump, False
    named = {212: "grab", 214: "grab", 233: "rollForward", 234: "rollBackward", 235: "spotDodge", 244: "fall", 180: "shieldRelease", 14: "shieldRelease"}
    o = named.get(s) or ("jump" if 24 <= s <= 28 else "fall" if fall else "unknown")
    return o, o == "jump", 24 <= s <= 28, False


def flying(m):
    return 65 <= m["state"] <= 69 or (m["character"] == 24 and 347 <= m["state"] <= 349)


def going(section, option, jumped, dodged, m, since):
    s = m["state"]
    if since >= (30 if section == "ledge" else 15):
        return option, False, jumped, dodged
    if upset(s):
        return option, True, jumped, dodged
    ledge, fall = section == "ledge", 29 <= s <= 34
    if ledge and s in (252, 253):
        return "regrab", False, jumped, dodged
    if ledge and s in (27, 28):
        return "dropJump", True, True, dodged
    if flying(m):
        return "dropAerial" if ledge else "aerial", False, jumped, dodged
    if s == 236:
        return option, True, jumped, True
    if not ledge and (24 <= s <= 28 or fall):
        return option, True, True, dodged
    if not m["airborne"]:
        dash = jumped and (dodged or m["landed_dodge"]) and s == 43
        return ("ledgedash" if ledge else "wavedash") if dash else "unknown" if s >= 341 else option, False, jumped, dodged
    return (option, True, jumped, dodged) if ledge and fall else ("unknown", False, jumped, dodged)


def test_choices(spark):
    rng = random.Random(1)
    rows = [r for g in range(1000) for r in stream(rng, g, 90)]
    got = sorted((tuple(r) for r in K.defensive_choices(load(spark, rows)).collect()), key=str)
    expected = sorted(plain_choices(rows), key=str)
    assert len(expected) > 3000 and {x[2] for x in expected} == {"ledge", "oos", "shieldExits"} and {x[6] for x in expected} == {"traded", "punished", "hit", "noHit", "incomplete"}
    assert {"ledgedash", "wavedash", "regrab", "dropAerial", "aerial", "unknown"} <= {x[3] for x in expected}
    assert got == expected


# recoveries


def plain_recoveries(rows):
    found = []
    for game, by in games_of(rows).items():
        span = range(min(by), max(by) + 1)
        if any(f not in by or len(by[f]) < 2 or any(by[f][q][c] is None for q in (0, 1) for c in ("state", "percent")) for f in span):
            continue
        for p in (0, 1):
            until, ep, was = None, None, None
            for f in span:
                m, t = by[f][p], by[f][1 - p]
                if f < K.FIRST_PLAYABLE:
                    was = m
                    continue
                s = m["state"]
                bad = lambda s: 75 <= s <= 91 or held(s) or 0 <= s <= 10 or s in (12, 13, 251) or 183 <= s <= 204
                out = lambda a: abs(a["x"]) > EDGE + 2 or (abs(a["x"]) > EDGE - 4 and a["y"] < -5) or a["y"] < -20
                home = lambda a: abs(a["x"]) <= EDGE and a["y"] >= -5
                hit = bool(was) and m["stocks"] == was["stocks"] and m["percent"] > was["percent"] and m["last_hit_by"] == 1 - p and (75 <= s <= 91 or held(s) or (m["hitlag"] or 0) > 0)
                died = 0 <= s <= 10 or (was is not None and m["stocks"] < was["stocks"])
                passive = 183 <= s <= 204 or 29 <= s <= 38 or s in (42, 43)
                if hit or (75 <= s <= 91 and m["last_hit_by"] == 1 - p) or s == 251:
                    until = f + 15
                if until is not None and passive:
                    until = f + 15
                if not out(m) and not bad(s) and not m["airborne"] and not passive:
                    until = None
                sign = lambda v: (v > 0) - (v < 0)
                if ep is None and not died and out(m) and m["airborne"] and until is not None and until >= f:
                    ep = dict(side=sign(m["x"]) or sign((was or {"x": 1})["x"]) or 1, at=f, ok=False, ledge=False, hit=False, landed=False, n=0, high=False, low=False, done=False, tactics=set(), stock=t["stocks"], lost=False)
                if ep is not None:
                    cliff = s in (252, 253)
                    if hit and f > ep["at"]:
                        ep["hit"] = True
                    if t["stocks"] < ep["stock"] or 0 <= t["state"] <= 10:
                        ep["lost"] = True
                    if cliff:
                        ep["ledge"] = ep["ok"] = ep["done"] = True
                    if not m["airborne"] and home(m):
                        ep["done"] = True
                    if out(m) and not bad(s) and not cliff:
                        ep["ok"] = True
                        if not ep["done"] and abs(m["x"]) <= EDGE + 40:
                            ep["high"] |= m["y"] > 5
                            ep["low"] |= m["y"] < -5
                    if ep["ok"] and f > ep["at"] and not ep["lost"] and (hit or not bad(t["state"])):
                        same = t["x"] * (sign(m["x"]) or ep["side"]) > 0
                        coming = out(m) or cliff
                        far = ((t["x"] - m["x"]) ** 2 + (t["y"] - m["y"]) ** 2) ** 0.5
                        swing = 44 <= t["state"] <= 69 or 212 <= t["state"] <= 222 or t["state"] >= 341
                        if coming and t["state"] in (252, 253) and same and abs(abs(t["x"]) - EDGE) <= 12:
                            ep["tactics"].add("holdLedge")
                        elif not same:
                            if hit and home(t):
                                ep["tactics"].add("onstage")
                        elif out(t) and (hit or (coming and far <= 60)):
                            ep["tactics"].add("low" if t["y"] < 0 else "high")
                        elif home(t) and (hit or (swing and abs(t["x"]) >= EDGE - 25 and far <= 60)):
                            ep["tactics"].add("onstage")
                    outcome = "died" if died else None
                    if not died:
                        if home(m) and not bad(s) and not cliff:
                            ep["landed"] |= not m["airborne"]
                            ep["n"] = ep["n"] + 1 if ep["landed"] and not hit else 0
                        else:
                            ep["n"], ep["landed"] = 0, False
                        if ep["n"] >= 30:
                            outcome = "returned"
                    if outcome:
                        if ep["ok"]:
                            found.append(told(game, p, f, ep, outcome))
                        ep = until = None
                was = m
            if ep and ep["ok"]:
                found.append(told(game, p, max(span), ep, "incomplete"))
    return found


def told(game, p, f, ep, outcome):
    route = "mixed" if ep["high"] and ep["low"] else "high" if ep["high"] else "low" if ep["low"] else "unknown"
    tactic = "mixed" if len(ep["tactics"]) > 1 else next(iter(ep["tactics"]), "unknown")
    return (game, p, ep["at"], f, route, tactic, outcome, ep["ledge"], ep["hit"], ep["lost"])


@pytest.mark.parametrize(("make", "length", "n", "outcomes"), [(stream, 200, 500, {"died", "incomplete"}), (calm_stream, 320, 500, {"died", "incomplete", "returned"})])
def test_recoveries(spark, make, length, n, outcomes):
    rng = random.Random(2)
    rows = [r for g in range(n) for r in make(rng, g, length)]
    for r in rows:
        r["state"] = 14 if r["state"] is None and r["game"] % 3 else r["state"]
    games = spark.createDataFrame([(g, EDGE) for g in range(n)], "game int, edge double")
    got = sorted(tuple(r) for r in K.recoveries(load(spark, rows), games).collect())
    expected = sorted(plain_recoveries(rows))
    assert len(expected) > 300 and outcomes <= {x[6] for x in expected} and {"low", "high", "mixed", "unknown"} <= {x[4] for x in expected}
    assert got == expected
    assert K.recoveries(load(spark, rows[:400]), games.withColumn("edge", F.lit(None).cast("double"))).count() == 0


def test_counts_of_choices_and_recoveries(spark):
    c = spark.createDataFrame([("a", "oos", "jump", "hit", True), ("a", "oos", "jump", "noHit", None), ("a", "ledge", "roll", "incomplete", None)], "k string, section string, option string, outcome string, c_stick boolean")
    got = {r["option"]: r.asDict() for r in K.choice_counts(c, ["k"]).collect()}
    assert got["jump"]["attempts"] == 2 and got["jump"]["c_samples"] == 1 and got["jump"]["c_inputs"] == 1 and got["roll"]["incomplete"] == 1 and got["roll"]["c_samples"] == 0
    r = spark.createDataFrame([("a", "low", "unknown", "died", True, False, False), ("a", "low", "high", "died", False, True, False), ("a", "low", "high", "died", False, True, True)], "k string, route string, tactic string, outcome string, ledge boolean, hit boolean, opponent_lost boolean")
    one = K.recovery_counts(r, ["k"]).first()
    assert (one["attempts"], one["died"], one["reached_ledge"], one["hit_during"]) == (3, 3, 1, 2)
    by = {x["tactic"]: x for x in K.edgeguard_counts(r, ["k"]).collect()}
    assert by["unknown"]["uncontested_deaths"] == 1 and by["high"]["contested"] == 2 and by["high"]["completed"] == 1 and by["high"]["stocks_taken"] == 1 and by["high"]["incomplete"] == 1


# special moves

MOVES = {18: ({341, 343, 347}, {341, 347}, {343}, True, 1.0, True), 19: ({343, 50}, {343}, set(), False, 1.0, False)}


def plain_specials(rows):
    found = []
    for game, by in games_of(rows).items():
        for p in (0, 1):
            frames = sorted(f for f in by if p in by[f])
            if not frames:
                continue
            expected = next((by[f][p]["character"] for f in frames if by[f][p]["character"] is not None), None)
            if expected != 1:
                continue
            for move, (states, starts, restarts, outcomes, most, same) in MOVES.items():
                good, sure, n, active, was, otherwas = True, True, [0, 0, 0], None, None, None
                before = None
                for f in frames:
                    m, t = by[f][p], by[f].get(1 - p)
                    if (before is None and f != K.FIRST) or (before is not None and f != before + 1):
                        good = False
                    before = f
                    s = m["state"]
                    if s is None or m["character"] is None or m["character"] != expected:
                        good = False
                        was, otherwas = m, t
                        continue
                    if not outcomes or t is None or t["percent"] is None or t["last_hit_by"] is None or m["last_attack"] is None:
                        sure = False
                    inside, low = s in states, m["counter"] is not None and m["counter"] <= most
                    if inside and m["counter"] is None:
                        good = False
                    if active is not None and s in starts and low and was and was["counter"] is not None and m["counter"] < was["counter"] and was["character"] == m["character"] and ((s == was["state"] and same) or was["state"] in restarts):
                        n[1 if active else 2] += 1
                        active = None
                    if inside and active is None:
                        if s in starts and low:
                            n[0], active = n[0] + 1, False
                            if was is None:
                                sure = False
                        else:
                            good = False
                    if active is not None and t and otherwas and t["percent"] is not None and otherwas["percent"] is not None and t["percent"] > otherwas["percent"] and t["last_hit_by"] == p and m["last_attack"] == move and t["state"] is not None and (hurt(t["state"]) or (t["hitlag"] or 0) > 0):
                        if t["instance_hit_by"] is None or m["instance"] is None or (t["instance_hit_by"] != 0 and (t["instance_hit_by"] == m["instance"] or (was is not None and t["instance_hit_by"] == was["instance"]))):
                            active = True
                    if not inside and active is not None:
                        n[1 if active else 2] += 1
                        active = None
                    was, otherwas = m, t
                hit, left = n[1] + (active is True), int(active is False)
                found.append((game, p, move, n[0] if good else None, hit if good and sure else None, n[2] if good and sure else None, left if good and sure else None))
    return found


def test_specials(spark):
    rng = random.Random(4)
    rows = []
    for g in range(1000):
        own = stream(rng, g, 60)
        for r in own:  # moves are entered by their starts most of the time
            r["character"] = 1 if r["character"] is not None else None
            if r["state"] in (341, 343, 347, 50):
                r["state"] = r["state"] if rng.random() < 0.03 else 341
        was = {}
        for r in own:
            p = r["player"]
            if r["state"] == 341 and was.get(p) != 341:
                r["counter"] = 0.0 if rng.random() < 0.97 else 7.0
            was[p] = r["state"]
        rows += own
    capabilities = spark.createDataFrame([(1, m, sorted(a), sorted(b), sorted(c), o, k, s) for m, (a, b, c, o, k, s) in MOVES.items()], "character int, move int, states array<int>, starts array<int>, restarts array<int>, outcomes boolean, most double, same_state boolean")
    frames = load(spark, rows)
    characters = frames.groupBy("game", "player").agg(F.min("character").alias("expected"))
    got = sorted((tuple(r) for r in K.special_attempts(frames, capabilities, characters).collect()), key=str)
    expected = sorted(plain_specials(rows), key=str)
    assert sum(x[3] or 0 for x in expected) > 1000 and sum(x[4] or 0 for x in expected) > 20 and any(x[3] is None for x in expected)
    assert got == expected
