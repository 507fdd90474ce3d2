"""Fits, ratings, tuning and bootstraps against plain loops and NumPy."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlake.operators import effects as E
from matchlake.operators import forecast, ratings, tuning


def plain_fit(rows, effects):
    """The optimum of one fit by Newton's method with the whole Hessian."""
    names = sorted(effects)
    at = {n: i for i, n in enumerate(names)}
    ridge, prior = (np.array([effects[n][k] for n in names]) for k in (0, 1))
    observations = sorted({r[0] for r in rows})
    x, games, wins = np.zeros((len(observations), len(names))), np.zeros(len(observations)), np.zeros(len(observations))
    for o, n, w, effect, v in rows:
        i = observations.index(o)
        x[i, at[effect]] += v
        games[i], wins[i] = n, w
    b = prior.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (wins - games * p) - ridge * (b - prior)
        h = x.T @ (x * (games * p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(h, g)
        b = b + step * min(1, 1 / np.abs(step).max()) if np.abs(step).max() > 0 else b
        if np.abs(step).max() < 1e-13:
            break
    return dict(zip(names, b, strict=True)), dict(zip(names, np.diag(h), strict=True))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_fits_equal_numpy(spark, seed):
    """Three tables of several fits: sparse and dense players, strong priors, a feature, an effect without observations."""
    rng = np.random.default_rng(seed)
    rows, effects = [], []
    for fit in range(3):
        players = [f"player|{i}" for i in range(4 + 5 * fit)]
        for o in range(12 * (fit + 1)):
            a, b = rng.permutation(len(players))[:2]
            n = int(rng.integers(1, 40))
            for effect, x in ((players[a], 1.0), (players[b], -1.0), ("feature|f", float(rng.normal()))):
                rows.append((fit, o, n, rng.integers(0, n + 1) if effect == players[a] else rows[-1][3], effect, x))
        effects += [(fit, e, float(rng.choice([0.5, 2.0, 12.0])), float(rng.choice([0.0, 1.0, -3.0])) if seed == 2 else 0.0) for e in [*players, "feature|f", "player|never"]]
    rows = [(f, o, float(n), float(w), e, x) for f, o, n, w, e, x in rows]
    got = E.fit_effects(spark.createDataFrame(rows, "fit int, observation int, games double, wins double, effect string, x double"), spark.createDataFrame(effects, "fit int, effect string, ridge double, prior double"))
    by = {(r["fit"], r["effect"]): r for r in got.collect()}
    assert len(by) == len(effects) and all(r["converged"] for r in by.values())
    for fit in range(3):
        value, information = plain_fit([r[1:] for r in rows if r[0] == fit], {e: (k, p) for f, e, k, p in effects if f == fit})
        for e, v in value.items():
            assert abs(by[fit, e]["value"] - v) < 1e-6 and abs(by[fit, e]["information"] - information[e]) < 1e-4 * information[e]


def _history(rng, players=5, events=3, games=20):
    rows = [(e, 100 * e + int(rng.integers(0, 5)), *map(int, rng.permutation(players)[:2]), int(rng.integers(0, 2))) for e in range(events) for _ in range(games)]
    return pd.DataFrame(rows, columns=["event", "day", "a", "b", "won"])


def test_ratings_against_plain_loops_over_games(spark):
    h = _history(np.random.default_rng(3))
    pairs = forecast.event_pairs(spark.createDataFrame(h.assign(fit=1)), ["fit"], "event", "day", "a", "b", "won").cache()
    ends, cutoff = h.groupby("event")["day"].max().to_dict(), 300.0
    rating, skill, seen, form, formed = {}, {}, {}, {}, {}
    for e, day in sorted(ends.items(), key=lambda x: x[1]):
        mine, change, left, count = [g for g in h.itertuples(index=False) if g.event == e], {}, {}, {}
        at = lambda x, t: form[x][0] * 2 ** (-(t - form[x][2]) / 180) / (form[x][1] * 2 ** (-(t - form[x][2]) / 180) + 6) if x in form else 0.0
        for g in mine:
            d = 32 * 2 ** (-(cutoff - day) / 730) * (g.won - 1 / (1 + 10 ** ((rating.get(g.b, 0) - rating.get(g.a, 0)) / 400)))
            change[g.a], change[g.b] = change.get(g.a, 0) + d, change.get(g.b, 0) - d
            formed[e, g.a, g.b] = at(g.a, day) - at(g.b, day)
            r = g.won - 1 / (1 + 10 ** ((form.get(g.b, [0] * 4)[3] - form.get(g.a, [0] * 4)[3]) / 400))
            for x, s in ((g.a, 1), (g.b, -1)):
                left[x], count[x] = left.get(x, 0) + s * r, count.get(x, 0) + 1
        for x, d in change.items():
            rating[x] = rating.get(x, 0) + d
        for x, r in left.items():
            old = form.get(x, [0, 0, day, 0])
            fade = 2 ** (-(day - old[2]) / 180)
            form[x] = [old[0] * fade + r, old[1] * fade + count[x], day, old[3] + 24 * r]
        names = sorted(change)
        prior = {x: skill.get(x, 0) * 2 ** (-(day - seen.get(x, day)) / 365) for x in names}
        value, _ = plain_fit([t for i, g in enumerate(mine) for t in ((i, 1, g.won, g.a, 1.0), (i, 1, g.won, g.b, -1.0))], {x: (1.0, prior[x]) for x in names})
        for x in names:
            skill[x], seen[x] = value[x], day
    options = spark.createDataFrame([(1, cutoff, 32.0, 400.0, 730.0)], "fit int, cutoff double, k double, scale double, half_life double")
    got = {r["player"]: r["rating"] for r in ratings.elo(pairs, options).collect()}
    assert got.keys() == rating.keys() and all(math.isclose(got[x], rating[x], rel_tol=1e-9, abs_tol=1e-9) for x in got)
    early = ratings.elo(pairs, options.withColumn("cutoff", F.lit(float(ends[1])))).collect()
    assert 0 < len(early) <= 5 and ratings.elo(pairs, options.withColumn("cutoff", F.lit(0.0))).count() == 0  # strictly before the cutoff
    dynamic = {r["player"]: r["strength"] for r in ratings.dynamic_bradley_terry(pairs, spark.createDataFrame([(1, cutoff, 365.0, 1.0)], "fit int, cutoff double, half_life double, ridge double")).collect()}
    assert dynamic.keys() == skill.keys() and all(abs(dynamic[x] - skill[x] * 2 ** (-(cutoff - seen[x]) / 365)) < 1e-6 for x in skill)
    sets, past = ratings.rolling_form(pairs)
    assert all(abs(r["form"] - formed[r["event"], r["a"], r["b"]]) < 1e-9 for r in sets.collect())
    now = {r["player"]: r["form"] for r in ratings.form_at(past, spark.createDataFrame([(1, cutoff)], "fit int, cutoff double")).collect()}
    assert now.keys() == form.keys() and all(abs(now[x] - at(x, cutoff)) < 1e-9 for x in form)


def test_glicko2_published_example(spark):
    # the worked example of the method's description: 1500/200 against 1400/30, 1550/100 and 1700/300
    got = ratings._volatility(*(np.array([x]) for x in (200 / 173.7178, 1.7785, -0.4834, 0.06)), 0.5)
    assert abs(got[0] - 0.05999) < 1e-4


def test_glicko2_against_a_plain_loop(spark):
    h = _history(np.random.default_rng(5), games=12)
    pairs = forecast.event_pairs(spark.createDataFrame(h.assign(fit=1)), ["fit"], "event", "day", "a", "b", "won")
    state = {}
    g = lambda phi: 1 / math.sqrt(1 + 3 * phi * phi / math.pi**2)
    for _, games in h.groupby("event"):
        met = {}
        for r in games.itertuples():
            met.setdefault(r.a, []).append((r.b, r.won))
            met.setdefault(r.b, []).append((r.a, 1 - r.won))
        old = {x: state.get(x, (0.0, 350 / 173.7178, 0.06)) for x in met}
        for x, results in met.items():
            mu, phi, vol = old[x]
            e = [(g(old[o][1]), 1 / (1 + math.exp(-g(old[o][1]) * (mu - old[o][0]))), s) for o, s in results]
            v = 1 / sum(w * w * p * (1 - p) for w, p, _ in e)
            drift = sum(w * (s - p) for w, p, s in e)
            vol = ratings._volatility(*(np.array([z]) for z in (phi, v, v * drift, vol)), 0.5)[0]
            phi = 1 / math.sqrt(1 / (phi * phi + vol * vol) + 1 / v)
            state[x] = (mu + phi * phi * drift, phi, vol)
    for r in ratings.glicko2(pairs).collect():
        mu, phi, vol = state[r["player"]]
        assert abs(r["rating"] - 1500 - 173.7178 * mu) < 1e-6 and abs(r["deviation"] - 173.7178 * phi) < 1e-6 and abs(r["volatility"] - vol) < 1e-9


def _scores(rng, events, candidates):
    rows = []
    for e in range(events):
        base = rng.random()
        for m, name, _ in candidates:
            n = rng.randint(3, 9)
            valid = rng.random() > (0.15 if m == "c" else 0.02)
            rows.append((m, name, e, valid, 5, 5 * (0.6 + 0.1 * base + 0.05 * rng.random()), 5 * (0.2 + 0.05 * rng.random()), n))
    return [r[:7] for r in rows]


def plain_choice(scores, events, candidates, least):
    out = {}
    ll = {(m, c, e): (v, a / n, b / n) for m, c, e, v, n, a, b in scores}
    for m in {x[0] for x in candidates}:
        mine = {c: d for model, c, d in candidates if model == m}
        standard = next(c for c, d in mine.items() if d == 0)
        for e, (cutoff, _) in events.items():
            past = [i for i in events if events[i][1] < cutoff]
            assert e not in past
            if len(mine) == 1:
                out[m, e] = ("fixed", standard, len(past))
                continue
            if len(past) < least:
                out[m, e] = ("warmup-default", standard, len(past))
                continue
            fine = {c: (sum(ll[m, c, i][1] for i in past) / len(past), sum(ll[m, c, i][2] for i in past) / len(past)) for c in mine if all(ll[m, c, i][0] for i in past)}
            if not fine:
                out[m, e] = ("inner-unavailable-default", standard, len(past))
                continue
            best = min(fine, key=lambda c: (*fine[c], c))
            near = []
            for c in fine:
                d = [ll[m, c, i][1] - ll[m, best, i][1] for i in past]
                mean = sum(d) / len(d)
                se = math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d)) if len(d) > 1 else math.inf
                if mean <= se + 2.220446049250313e-16:
                    near.append(c)
            out[m, e] = ("inner-selected", min(near, key=lambda c: (mine[c], fine[c][1], c)), len(past))
    return out


def test_nested_choice_against_a_plain_loop_and_its_leaks(spark):
    rng = random.Random(7)
    candidates = [("a", "a0", 0), ("a", "a1", 1), ("a", "a2", 1), ("a", "a3", 2), ("b", "b0", 0), ("c", "c0", 1), ("c", "c1", 0)]
    events = {e: (10 * e, 10 * e + rng.choice([3, 9, 15, 40])) for e in range(40)}
    scores = _scores(rng, 40, candidates)
    frame = lambda s: spark.createDataFrame(s, "model string, candidate string, event int, valid boolean, n int, log_loss double, brier double")
    dates = spark.createDataFrame([(e, *x) for e, x in events.items()], "event int, cutoff int, available int")
    run = lambda s: {(r["model"], r["event"]): (r["mode"], r["chosen"], r["inner_events"]) for r in tuning.nested_choice(frame(s), dates, candidates, 6).collect()}
    got = run(scores)
    assert got == plain_choice(scores, events, candidates, 6)
    assert {x[0] for x in got.values()} == {"fixed", "warmup-default", "inner-unavailable-default", "inner-selected"} and len({x[1] for x in got.values()}) > 4
    # no event sees a later result: other scores for all that was known only from day 200 on leave every choice before it as it was
    later = [(m, c, e, v, n, a * rng.uniform(0.5, 2), b) if events[e][1] >= 200 else (m, c, e, v, n, a, b) for m, c, e, v, n, a, b in scores]
    changed = run(later)
    assert all(changed[k] == x for k, x in got.items() if events[k[1]][0] <= 200) and changed != got


def test_bootstrap_draws(spark):
    from test_operators import _generator

    from matchlake.functions import names as N

    rows = [("x", k, float(k * k % 7), k + 1) for k in range(9)] + [("y", 0, 2.0, 4)]
    got = {r["k"]: r for r in tuning.bootstrap(spark.createDataFrame(rows, "k string, c int, total double, n int"), ["k"], "c", "total", "n", N.seed_hash(F.col("k")), 200).collect()}
    g, means = _generator("x"), []
    for _ in range(200):
        pick = [int(next(g) * 9) for _ in range(9)]
        means.append(sum(rows[i][2] for i in pick) / sum(rows[i][3] for i in pick))
    assert math.isclose(got["x"]["low"], np.quantile(means, 0.025)) and math.isclose(got["x"]["high"], np.quantile(means, 0.975))
    assert got["y"]["low"] == got["y"]["high"] == got["y"]["mean"] == 0.5


def test_fitted_tuning_scores_against_plain_fits(spark, sf):
    """The scores of one year for each candidate, from ratings and fits of its own past alone."""
    from matchlake.plans import models as P

    events, scores = P.fitted_scores(spark, sf)
    dates = {r["event"]: r for r in events.collect()}
    pairs = [r for r in P.half_years(spark, sf, "year")[1].collect()]
    got = {(r["candidate"], r["event"]): r for r in scores.collect()}
    target = max(e for _, e in got)
    past = sorted({p["event"] for p in pairs if dates[p["event"]]["available"] < dates[target]["cutoff"]}, key=lambda e: dates[e]["available"])
    assert target not in past and len(past) >= 3
    for k, half_life, name in ((32, 730, "elo-32-730"), (64, 365, "elo-64-365")):
        rating = {}
        for e in past:
            change = {}
            for p in pairs:
                if p["event"] == e:
                    w = k * 2 ** (-(dates[target]["cutoff"] - dates[e]["available"]) / half_life)
                    d = w * (p["wins"] - p["games"] / (1 + 10 ** ((rating.get(p["b"], 0) - rating.get(p["a"], 0)) / 400)))
                    change[p["a"]], change[p["b"]] = change.get(p["a"], 0) + d, change.get(p["b"], 0) - d
            for x, d in change.items():
                rating[x] = rating.get(x, 0) + d
        total = n = 0
        for p in pairs:
            if p["event"] == target:
                q = 1 / (1 + 10 ** ((rating.get(p["b"], 0) - rating.get(p["a"], 0)) / 400))
                total -= p["wins"] * math.log(q) + (p["games"] - p["wins"]) * math.log(1 - q)
                n += p["games"]
        r = got[name, target]
        assert r["valid"] and r["n"] == n and abs(r["log_loss"] - total) < 1e-6
    assert got["regularised-2", target]["valid"] and got["regularised-8", target]["valid"]
