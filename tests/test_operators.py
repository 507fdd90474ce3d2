import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlake.functions import names as N
from matchlake.functions import scalar as S
from matchlake.operators import aggregate, community, dedupe, forecast, impact, keeping, resolve, sequence, stats, teams
from matchlake.sources import tables
from matchlake.streaming import incremental


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 5.0, None), ("b", 5.0, None)], "k string, minutes double, x double")
    got = {r["k"]: r for r in aggregate.averages(df, ["k"], ["x"], "minutes").collect()}
    assert got["a"]["coverage"] == 1 and got["a"]["per_game"] == 1.0 and math.isclose(got["a"]["per_minute"], 0.1)
    assert got["b"]["per_game"] is None and got["b"]["per_minute"] is None


def test_session_gap_runs_from_previous_end(spark):
    rows = [(1, 0, 100), (2, 10, 5), (3, 40, 5)]  # the second ends early: the third is too far from it
    df = spark.createDataFrame(rows, "id int, s int, d int").select("id", F.lit(1).alias("k"), F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds(F.col("s") + F.col("d")).alias("e"))
    got = sequence.sessions(df, ["k"], "ts", F.col("e"), "20 SECONDS", ["ts"])
    assert [r["session"] for r in got.orderBy("id").collect()] == [1, 1, 2]


def test_best_of_three_resets(spark):
    rows = [(i, w) for i, w in enumerate([1, 1, 0, None, 0, 1, 0])]
    df = spark.createDataFrame(rows, "i int, w int").select(F.lit(1).alias("p"), F.timestamp_seconds("i").alias("ts"), "i", "w", F.lit("x").alias("o"))
    got = sequence.best_of_three(df, ["p"], ["i"], "ts", F.col("ts"), "o", "1 HOUR").orderBy("set_no").collect()
    assert [(r["games"], r["wins"], r["losses"], r["opened"]) for r in got] == [(2, 2, 0, 1), (3, 0, 2, 0)]


def test_sets_run_from_the_end_and_skip_unknown_opponents(spark):
    rows = [(0, 1, "x", 50), (1, 0, None, 1), (55, 1, "x", 1), (70, 0, "x", 1), (71, 0, "x", 1), (200, 1, "x", 1)]
    df = spark.createDataFrame(rows, "i int, w int, o string, d int").select(F.lit(1).alias("p"), F.timestamp_seconds("i").alias("ts"), F.timestamp_seconds(F.col("i") + F.col("d")).alias("e"), "i", "w", "o")
    got = sequence.best_of_three(df, ["p"], ["i"], "ts", F.col("e"), "o", "10 SECONDS").orderBy("block", "set_no").collect()
    assert [(r["games"], r["wins"], r["losses"], r["first_pos"]) for r in got] == [(2, 2, 0, 1), (2, 0, 2, 3)]


def test_median_split_drops_the_middle(spark):
    df = spark.createDataFrame([(1, v, w) for v, w in ((1, 0), (2, 0), (3, 1), (4, 1), (5, 1))], "k int, v int, w int")
    r = sequence.median_split(df, ["k"], "v", ["w"]).first()
    assert (r["n"], r["low"], r["high"]) == (5, 0.0, 1.0)


def test_range_errors():
    assert resolve.date_range_error("2020-01-02", "2020-01-01") and resolve.date_range_error("2020-02-30", "2020-03-01") and resolve.date_range_error(None, "2020-01-01")
    assert resolve.date_range_error("2020-01-01", "2020-01-01") is None


def test_irls_recovers_a_known_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - x[:, 1])))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y.astype(int)}))
    got = stats.irls(df, ["a", "b"], "y")
    assert abs(got["a"] - 1.5) < 0.2 and abs(got["b"] + 1) < 0.2 and abs(got["intercept"] - 0.5) < 0.2
    assert stats.irls(df.withColumn("y", F.lit(1)), ["a"], "y") is None


def test_double_elimination_against_a_plain_bracket():
    power, n = np.array([1.0, 0.8, 0.5, 0.3, 0.0, -0.2, -0.5, -1.0]), np.arange(400)
    u = [forecast._uniform(7, n, m) for m in range(15)]
    got = forecast.double_elimination(power, n, 7)
    for i in n.tolist():
        k = iter(range(15))

        def play(a, b):
            first = u[next(k)][i] < 1 / (1 + math.exp(-(power[a] - power[b])))
            return (a, b) if first else (b, a)

        one = [play(*x) for x in ((0, 7), (3, 4), (1, 6), (2, 5))]
        two = [play(one[0][0], one[1][0]), play(one[2][0], one[3][0])]
        low = [play(one[0][1], one[1][1])[0], play(one[2][1], one[3][1])[0]]
        low = [play(low[0], two[1][1])[0], play(low[1], two[0][1])[0]]
        top, dropped = play(two[0][0], two[1][0])
        below = play(play(*low)[0], dropped)[0]
        first, other = play(top, below)
        assert got[i] == (first if first == top else play(first, other)[0])


def test_bracket_reads_its_strengths(spark):
    rows = [(f"e{i}", float(i)) for i in range(8)]
    r = {x["entrant"]: x["titles"] for x in forecast.bracket_titles(spark.createDataFrame(rows, "entrant string, strength double"), 500).collect()}
    assert sum(r.values()) == 500 and max(r, key=r.get) == "e7"
    with pytest.raises(ValueError):
        forecast.bracket_titles(spark.createDataFrame(rows[:7], "entrant string, strength double"), 10)


def test_upsert_stream_is_repeatable(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    for i, rows in enumerate(([(1, 1, "a"), (2, 1, "a")], [(1, 2, "b"), (2, 0, "c")])):
        spark.createDataFrame(rows, "k int, v int, x string").withColumn("o", F.lit(i)).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    incremental.run_available(incremental.file_stream(spark, src, schema, 1), incremental.upsert_sink(dst, ["k"], "v", "o"), ck)
    last = max(int(p.name[6:]) for p in (tmp_path / "dst").iterdir())
    assert {(r["k"], r["x"]) for r in spark.read.parquet(f"{dst}/batch={last}").collect()} == {(1, "b"), (2, "a")}


def test_publish_checks_before_replacing(spark, tmp_path):
    old, new = spark.range(3), spark.range(5).select((F.col("id") - 1).alias("id"))
    target = str(tmp_path / "t")
    assert tables.publish(old, target, {"positive": "id >= 0"}) == 3
    with pytest.raises(ValueError):
        tables.publish(new, target, {"positive": "id >= 0"})
    assert tables.published(spark, target).count() == 3
    assert tables.publish(new, target, {}) == 5 and tables.published(spark, target).count() == 5


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for kind in ("parquet", "orc", "json", "csv"):
        tables.write_shards(df.withColumn("s", F.col("a")), str(tmp_path / kind), ["s"], kind)
        got = tables.read_any(spark, str(tmp_path / kind), kind, "a int, b string, s int")
        assert sorted(map(tuple, got.select("a", "b").collect())) == [(1, "x"), (2, None)]


def test_digest_ignores_order_and_sees_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    d = lambda df: df.first()["digest"]
    assert d(tables.content_digest(a, ["a"])) == d(tables.content_digest(a.orderBy(F.desc("a")), ["a"])) != d(tables.content_digest(a.fillna("y"), ["a"]))


def test_tri_state_conflict(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (2, None), (3, None)], "k int, f boolean")
    assert {r["k"]: (r["f"], r["conflict"]) for r in dedupe.tri_state(df, ["k"], "f").collect()} == {1: (None, True), 2: (True, False), 3: (None, False)}


def test_best_of_edges(spark):
    r = spark.range(1).select(S.best_of(F.lit(1.0), 5).alias("a"), S.best_of(F.lit(0.0), 3).alias("b"), S.best_of(F.lit(0.5), 7).alias("c")).first()
    assert (r["a"], r["b"]) == (1.0, 0.0) and abs(r["c"] - 0.5) < 1e-12


def test_dimensions_beyond_the_bound_fail(spark):
    from matchlake.plans.sequences import bounded

    assert len(bounded(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        bounded(spark.range(6), 5)


def _generator(text):
    """The seeded generator in plain 32-bit arithmetic."""
    state = 2166136261
    for c in text:
        state = ((state ^ ord(c)) * 16777619) & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        v = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        v ^= (v + ((v ^ (v >> 7)) * (v | 61))) & 0xFFFFFFFF
        yield ((v ^ (v >> 14)) & 0xFFFFFFFF) / 4294967296


def test_random_numbers_need_no_state(spark):
    df = spark.createDataFrame([(t, n) for t in ("", "a", "seed 42", "\u00e9") for n in range(1, 6)], "t string, n int")
    for r in df.select("t", "n", N.counted_random(N.seed_hash(F.col("t")), F.col("n")).alias("u")).collect():
        g = _generator(r["t"])
        assert [next(g) for _ in range(r["n"])][-1] == r["u"]


def test_names(spark):
    df = spark.createDataFrame([(" \uff26ox\u2460 ", None), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(N.strict_alias(F.col("a"))).collect()] == ["fox1", None]
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(N.tier(F.array(F.lit("Master Player"), F.lit("diamond player")))) is None and get(N.tier(F.array().cast("array<string>"))) is None
    assert get(N.template_fields(F.lit("{{P|a| b }}{{Q|c}}{{P|d}}"), "P")) == [["a", "b"], ["d"]] and get(N.earnings(F.lit("none"))) is None
    assert get(N.roster(F.array(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit(None))))) is None
    assert get(N.roster(F.array(F.array(F.lit("d"), F.lit("c")), F.array(F.lit("b"), F.lit("a"))))) == "a+b vs c+d"
    assert get(N.zoned(F.lit("2024-01-01T00:00:00"))) is None and get(N.mode_of_match(F.lit(None).cast("string"))) == "offline"
    assert abs(get(N.two_sided(F.lit(1.959964))) - 0.05) < 1e-6 and abs(get(N.normal_upper_tail(F.lit(0.0))) - 0.5) < 1e-6


def test_unused_moves_count_as_zero(spark):
    df = spark.createDataFrame([(1, 1, "a", 3.0), (1, 2, "b", 1.0), (1, 2, "a", 1.0), (2, 3, "c", 0.0)], "k int, g int, m string, l double")
    got = {(r["g"], r["m"]): r["share"] for r in impact.dense_shares(df, ["k"], "g", "m", "l").collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): 0.5, (2, "b"): 0.5}


def test_detectors_keep_their_gates(spark):
    rows = [("k", "x", 1)] * 40 + [("k", "x", 0)] * 10 + [("k", "y", 0)] * 25 + [("k", "z", 0)] * 5 + [("few", "x", 0)] * 30
    got = impact.detect(spark.createDataFrame(rows, "k string, c string, w int"), ["k"], ["c"], 20).collect()
    assert [(r["k"], r["c"], r["decided"]) for r in got] == [("k", "y", 25)]


def test_contributed_games(spark):
    row = lambda owner, players, version=3, stage=1, error=None: (owner, version, players, error, "2024-01-01", stage, False)
    g = spark.createDataFrame([row(1, ["A", "B"]), row(1, ["A", "A2"]), row(1, ["C", "D"]), row(2, ["E", "F"]), row(1, ["A", "B"], 2), row(1, ["A", "B"], stage=9), row(1, ["A", "B"], error="x")], "owner int, pack_version int, players array<string>, error string, ts string, stage int, is_teams boolean")
    consent = spark.createDataFrame([(1, True), (2, False)], "owner int, enabled boolean")
    codes = spark.createDataFrame([(1, ["A", "A2"]), (2, ["E"])], "owner int, codes array<string>")
    assert community.eligible(g, consent, codes, "owner", 3, [1]).count() == 1
    assert spark.range(1).select(community.count_members(F.array(F.array(F.lit("a"), F.lit("")), F.array(F.lit("a"), F.lit("b"))))).first()[0] == 2


def test_small_helpers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    won = lambda s, p, a, b, q: get(keeping.winner(F.lit(s), F.lit(p).cast("int"), F.lit(a), F.lit(b), F.lit(q).cast("int")))
    assert [won(10, 1, False, True, None), won(60, 1, True, False, None), won(60, None, True, False, None), won(60, None, False, False, 0), won(60, None, True, True, None)] == [None, 1, 1, 1, None]
    assert get(teams.taken([F.lit(1), F.lit(None).cast("int")])) is None and get(S.optional_count(F.create_map(F.lit("a"), F.lit(1)), "b")) == 0
    bad = keeping.validate(spark.createDataFrame([(1,), (None,)], "x int"), {"positive": "x > 0"}).collect()
    assert [(r["check"], r["broken"]) for r in bad] == [("positive", 1)]
    f = {r["field"]: r["rows"] for r in keeping.forbidden(spark.createDataFrame([("u", "x#1")], "user_uuid string, n string"), "(?i)uuid", "#1").collect()}
    assert f == {"user_uuid": 1, "n": 1}


def test_a_character_is_judged_only_where_there_is_a_choice(spark):
    rows = [("k", "x", 1)] * 40 + [("k", "x", 0)] * 10 + [("k", "y", 0)] * 30 + [("one", "x", 0)] * 40 + [("one", "y", 1)] * 20
    got = impact.worst_character(spark.createDataFrame(rows, "k string, c string, w int"), ["k"], "c").collect()
    assert [(r["k"], r["c"], r["decided"]) for r in got] == [("k", "y", 30)]


def test_move_habits_need_share_evidence_and_overuse(spark):
    row = lambda k, m, n, low, high, use: (k, m, n, low, high, high - low, use)
    rows = [row("a", "x", 100, 0.7, 0.4, 0.2), row("a", "y", 100, 0.7, 0.3, 0.04), row("a", "z", 50, 0.9, 0.1, 0.2), row("b", "x", 100, 0.55, 0.5, 0.2), row("c", "x", 100, 0.7, 0.4, 0.2)]
    df = spark.createDataFrame(rows, "k string, m string, n long, low double, high double, delta double, mean_use double")
    assert {(r["k"], r["m"]) for r in impact.move_habit(df, ["k"], "m").collect()} == {("a", "x"), ("c", "x")}
    archive = spark.createDataFrame([("a", "x", 0.15, 500), ("c", "x", 0.02, 500), ("b", "x", 0.0, 500)], "k string, m string, archive_share double, games long")
    assert [(r["k"], r["m"]) for r in impact.move_habit(df, ["k"], "m", archive).collect()] == [("c", "x")]
    assert impact.move_habit(df, ["k"], "m", archive.withColumn("games", F.lit(99))).count() == 0


def test_owners_who_hold_too_little_hand_on_again_and_again(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 2), ("c", 3), ("d", 3), ("e", 4)]
    got = {r["k"]: r["o"] for r in keeping.settle(spark.createDataFrame(rows, "k string, o int"), ["k"], "o", 2).collect()}
    assert got == {"a": 2, "b": 2, "c": 2}  # 1 drops out, then 3 and 4 hold one key each and drop out too


def test_event_days(spark):
    cases = {"Nov 20 - 21, 2010": "2010-11-21", "Aug 9, 2026": "2026-08-09", "Dec 30, 2003 - Jan 2, 2004": "2004-01-02", "none": "1999-01", "May 5": "1999-05-05", "Foo 3, 2001": "1999-01"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", S.event_end(F.col("t"), F.lit(1999)).alias("d")).collect()} == cases
    nested = "<" * 30 + "b" + ">" * 30
    assert spark.range(1).select(S.html_text(F.lit(f"a {nested} c")).alias("x")).first()["x"] == "a c"


def test_paths_and_bundles(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    tell = lambda b, p: tuple(get(c) for c in N.path_evidence(F.lit(b), F.lit(p)).values())
    assert tell("x-Streams.7z", "a/b") == (True, False, True, False) and tell("x.zip", "Top 8/1.slp") == (False, True, True, False)
    assert tell("x-stream.rar", "warm-ups/g") == (False, False, False, True) and tell("x.zip", "poolside") == (False, False, False, False)
    assert get(N.event_of_bundle(F.lit("big-one-R2-Offstream.ZIP"))) == "big-one" and get(N.event_of_bundle(F.lit("big-one-pools.zip"))) == "big-one-pools"
