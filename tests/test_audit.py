import datetime as dt
import random

from pyspark.sql import functions as F

from matchlake.operators import audit as A


def test_other_owners_equals_a_self_join(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(30), rng.randrange(12), rng.random() < 0.1) for _ in range(150)]
    df = spark.createDataFrame(rows, "game long, owner long, changed boolean")
    got = {r[0] for r in A.other_owners(df, df.where("changed"), "game", "owner").collect()}
    assert got == {b for g, a, c in rows if c for h, b, _ in rows if g == h and a != b}


def test_counters_round_trip_keeps_null_apart_from_zero(spark):
    rows = [("a", "x", 0, None), ("a", "y", None, 2), ("b", "x", 3, 0)]
    df = spark.createDataFrame(rows, "k string, name string, n int, m int")
    packed = A.encode_counters(df, ["k"], "name", ["n", "m"])
    assert packed.count() == 2
    assert sorted(map(str, (tuple(r) for r in A.decode_counters(packed, ["k"], "name", ["n", "m"]).collect()))) == sorted(map(str, rows))
    assert A.encode_counters(df.where("k = 'c'"), ["k"], "name", ["n", "m"]).count() == 0


def test_periods_end_now_and_include_their_first_instant(spark):
    now = dt.datetime(2020, 3, 1, 12)
    rows = [("m", now - dt.timedelta(days=30), 1), ("m", now - dt.timedelta(days=30, seconds=1), 1), ("m", now - dt.timedelta(days=400), 1), ("m", None, 1)]
    df = spark.createDataFrame(rows, "mode string, ts timestamp_ntz, w int")
    got = {r["days"]: r["n"] for r in A.in_periods(df, ["mode"], "ts", F.lit("2020-03-01 12:00:00").cast("timestamp_ntz"), [30, 90], {"n": F.sum("w")}).collect()}
    assert got == {30: 1, 90: 2, None: 4}


def test_backtest_shares_credit_between_ties(spark):
    rows = [("e", "a", 0.6, 3.0), ("e", "b", 0.6, 1.0), ("e", "c", 0.2, 2.0)]
    r = A.backtest(spark.createDataFrame(rows, "event string, who string, score double, wins double"), ["event"], "who", "score", "wins").first()
    assert (r["top1"], r["precision8"], r["worst_rank"]) == (0.5, 3 / 8, 2)


def test_integrity_and_receipts(spark):
    f = spark.createDataFrame([("e", 0.5), ("e", 0.5), ("x", 0.5), ("x", 0.4)], "event string, t double")
    got = {r["event"]: (r["players"], r["title_ok"], r["top8_ok"]) for r in A.forecast_integrity(f, ["event"], "t").collect()}
    assert got == {"e": (2, True, True), "x": (2, False, True)}
    p = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0), ("t", 2), ("t", 2)], "source string, page int")
    assert {tuple(r) for r in A.page_receipts(p, "source", F.col("page")).collect()} == {("s", 2, True, 2), ("t", 2, False, 3)}
    assert spark.createDataFrame([(" A b__C! ",)], "x string").select(A.slug(F.col("x"))).first()[0] == "a-b-c"
