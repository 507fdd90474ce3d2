"""Spells of frames alike give what their frames give, and the queries on scripted frames deal the events out once."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_frames import EDGE, MOVES, SCHEMA, load, plain_choices, plain_recoveries, plain_specials, stream

from matchlake.operators import frames as K
from matchlake.plans import interactions as I
from matchlake.plans import registry


def spells(seed, games, length, longest, first=K.FIRST, specials=False):
    """Rows of spells, each with its spell, and the rows of their frames; specials: moves are entered by their starts most of the time."""
    rng, short, whole = random.Random(seed), [], []
    for g in range(games):
        own, at = stream(rng, g, length, first), {}
        frame = first
        for f in range(first, first + length):
            at[f] = frame, rng.randint(1, rng.choice([1, 3, longest]))
            frame += at[f][1]
        was = {}
        for r in own:
            if specials and r["state"] in (341, 343, 347, 50):
                r["state"] = r["state"] if rng.random() < 0.03 else 341
                r["counter"] = r["counter"] if was.get(r["player"]) == 341 or rng.random() < 0.03 else 0.0
            was[r["player"]] = r["state"]
            start, n = at[r["frame"]]
            r["character"] = 1 if r["character"] is not None and g % 2 else r["character"]
            r["x"] = 0.0 if g % 3 == 0 and abs(r["x"]) < 25 else r["x"]
            short.append(r | {"frame": start, "spell": n})
            whole += [r | {"frame": start + j, "counter": None if r["counter"] is None else r["counter"] + j} for j in range(n)]
    return short, whole


def load_spells(spark, rows):
    """With the opponent's columns, as far as the opponent has the row."""
    pdf = pd.DataFrame([(r["game"], r["player"], r["frame"], r["spell"]) for r in rows], columns=["game", "player", "frame", "spell"])
    out = load(spark, rows).join(spark.createDataFrame(pdf, "game int, player int, frame int, spell int"), ["game", "player", "frame"])
    return out, K.with_opponent(out, [c.split()[0] for c in SCHEMA.split(", ")[3:]])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_spells_of_choices(spark):
    short, whole = spells(5, 300, 60, 33)
    expected = sorted(plain_choices(whole), key=str)
    assert len(expected) > 1000 and {x[2] for x in expected} == {"ledge", "oos", "shieldExits"} and {x[6] for x in expected} == {"traded", "punished", "hit", "noHit", "incomplete"}
    for frames in load_spells(spark, short):
        assert rows_of(K.defensive_choices(frames)) == expected


@pytest.mark.parametrize("longest", [6, 45])
def test_spells_of_recoveries(spark, longest):
    short, whole = spells(6, 300, 150, longest)
    expected = sorted(plain_recoveries(whole), key=str)
    assert len(expected) > 300 and {"died", "incomplete", "returned"} <= {x[6] for x in expected} and {"low", "high", "mixed", "unknown"} <= {x[4] for x in expected}
    for frames in load_spells(spark, short):
        assert rows_of(K.recoveries(frames.withColumn("edge", F.lit(EDGE)))) == expected


def test_spells_of_specials(spark):
    short, whole = spells(7, 600, 60, 9, specials=True)
    capabilities = spark.createDataFrame([(1, m, sorted(a), sorted(b), sorted(c), o, k, s) for m, (a, b, c, o, k, s) in MOVES.items()], "character int, move int, states array<int>, starts array<int>, restarts array<int>, outcomes boolean, most double, same_state boolean")
    characters = load(spark, short).groupBy("game", "player").agg(F.min("character").alias("expected"))
    expected = sorted(plain_specials(whole), key=str)
    assert sum(x[3] or 0 for x in expected) > 300 and sum(x[4] or 0 for x in expected) > 5 and any(x[3] is None for x in expected)
    for frames in load_spells(spark, short):
        assert rows_of(K.special_attempts(frames, capabilities, characters)) == expected
        assert rows_of(K.special_attempts(frames.join(characters, ["game", "player"]), capabilities)) == expected


def test_scripted_frames_are_whole(spark, sf, duck):
    """Every frame of every event, in one row for each part and player."""
    events = duck.execute("SELECT event_id, event_type, CAST(floor(abs(value) % 7) AS INT) FROM events").fetchall()
    frames = parts = 0
    for game, mode, more in events:
        base = {"view": 0, "click": 4, "purchase": 6, "error": 1}.get(mode, 3)
        script = I.SCRIPTS[(base + 1) % len(I.SCRIPTS) if game % 5 == 0 else 2 if game % 7 == 0 else base]
        frames, parts = frames + sum(p[0] + more % 3 for p in script), parts + len(script)
    got = I.frames(spark, sf).agg(F.count("*").alias("rows"), F.sum("spell").alias("frames"), F.count_distinct("game", "player", "frame").alias("starts")).first()
    assert (got["rows"], got["frames"], got["starts"]) == (2 * parts, 2 * frames, 2 * parts)


@pytest.mark.parametrize("name", ["k07_choice_counts", "k07_choice_machine", "k08_edgeguard_counts", "k08_recovery_counts", "k08_recovery_episodes", "k10_k11_specials"])
def test_events_are_dealt_out_once(spark, sf, name, monkeypatch):
    """Neither frames nor spells are shuffled or written: one exchange of events, one more of counts over all matches."""
    monkeypatch.setattr(I, "EVENTS", 100)
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"\bExchange (\w+)", plan)
    assert dealt == ["hashpartitioning"] * (2 if name.endswith("counts") else 1) and "SortMergeJoin" not in plan
    assert len(re.findall(r"FileScan parquet|Scan parquet", plan)) == 1 and "events.parquet" in plan
