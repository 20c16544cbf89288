"""Histories, features and rankings on random tables against plain Python."""

import itertools
import math
import random
from dataclasses import replace
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from quillspan.config import CONFIG
from quillspan.operators import features as feat
from quillspan.operators import history as hist
from quillspan.operators import ranking as rank
from quillspan.operators.grid import bounds, cell, dilate, neighbour_mean

BINS = CONFIG.bins


def place(k):
    return max(i for i, b in enumerate(BINS) if (k or 0) >= b)


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(31)
    rows = []
    for i, j, y in itertools.product(range(6), range(7), range(1998, 2002)):
        k = rng.choice([0, 1, 2, 2, 4, 7, 9, 12, 30])
        rows.append((i, j, y, int(rng.random() < 0.1 + k / 20), k + rng.randrange(3), k))
    return rows


PANEL = "ci long, cj long, year int, count_a long, raw_b long, celldays_b long"


def brute_curve(rows):
    p, best = [], None
    for b in range(len(BINS)):
        seen = [a >= 1 for *_, a, _, k in rows if place(k) == b]
        best = max(x for x in (best, mean(seen) if seen else None) if x is not None) if seen or best is not None else None
        p.append(best)
    return p


def test_curve_never_falls_and_fills_empty_bins(spark, panel):
    for rows in (panel, [r for r in panel if r[5] > 3], panel[:3]):
        got = [r.p for r in hist.curve_fit(spark.createDataFrame(rows, PANEL)).orderBy("bin").collect()]
        want = brute_curve(rows)
        assert got == pytest.approx(want, nan_ok=True) or [x is None for x in got] == [x is None for x in want]
        assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])


def test_history_as_of_knows_nothing_later(spark, panel):
    """Later seasons, however different, change no row of an origin before them."""
    months = [(y, m, "hills", 5 + y % 3, 10, 9 + m, "burn") for y in range(1998, 2002) for m in (2, 3, 4, 5)]
    schema = "year int, month int, region string, count_a long, raw_b long, celldays_b long, season string"

    def known(rows, monthly):
        out = hist.history_as_of(spark.createDataFrame(rows, PANEL), spark.createDataFrame(monthly, schema), [2000]).filter("year < 2000")
        return sorted(map(tuple, out.collect()))

    later = [(i, j, y, 1 - a if y >= 2000 else a, b, k + 5 if y >= 2000 else k) for i, j, y, a, b, k in panel]
    assert known(panel, months) == known(later, [(*m[:3], m[3] * (9 if m[0] >= 2000 else 1), *m[4:]) for m in months])


def test_summary_against_brute_force(spark):
    cfg, rng = replace(CONFIG, first_year=1991, overlap_from=1996, last_year=2002), random.Random(5)
    kinds = {0: lambda y: 1.0, 1: lambda y: float(y >= 1999), 2: lambda y: rng.choice([0.0, 0.2, 0.7, 1.0]), 3: lambda y: 0.0}
    rows = [(c, c, y, kinds[c % 4](y), float(rng.random() < 0.6), round(rng.random() * 9, 2)) for c in range(24) for y in range(1991, 2003)]
    df = spark.createDataFrame(rows, "ci long, cj long, year int, active double, active_naive double, activity_eq double")
    got = {r.ci: r for r in hist.cell_summary(df, cfg, 1999).collect()}
    assert {r.pattern for r in got.values()} >= {"chronic", "new", "rare"}
    for c, r in got.items():
        mine = sorted((y, a, n) for i, _, y, a, n, _ in rows if i == c)
        streak = len(list(itertools.takewhile(lambda x: x[1] >= 0.5, reversed(mine))))
        likely = [y for y, a, _ in mine if a >= 0.5]
        assert (r.streak, r.first_likely, r.last_likely) == (streak, min(likely, default=None), max(likely, default=None))
        assert r.active_seasons == pytest.approx(sum(a for _, a, _ in mine), abs=0.051) and r.active_seasons_naive == sum(n for *_, n in mine)
        early = round(sum(a for y, a, _ in mine if y < 1996), 1) / 5
        assert r.looks_worse_naive == (sum(n for y, _, n in mine if y >= 1996) / 7 - early >= 0.25)
    streaks = {r.ci: r.streak for r in hist.streak(df, F.col("active") >= 0.5).collect()}
    assert streaks == {c: r.streak for c, r in got.items()}


def test_features_against_brute_force(spark):
    cfg, rng = replace(CONFIG, first_year=1990, overlap_from=1994), random.Random(77)
    cells = [(i, j) for i in range(4) for j in range(5)]
    days = {(i, j, y): rng.randrange(1, 7) for i, j in cells for y in range(1994, 2001) if rng.random() < 0.35}
    hist_rows = [(t, i, j, y, round(rng.random(), 3), round(rng.random() * 5, 2)) for t in (1998, 2000) for i, j in cells for y in range(1990, 2001)]
    grid = spark.createDataFrame([(i, j, 10.0 * i, 100.0 * j, 3.0 * i + j, 0.1 * j) for i, j in cells], "ci long, cj long, population double, elev_mean double, slope_mean double, steep_frac double")
    table = spark.createDataFrame([(*k, v) for k, v in days.items()], "ci long, cj long, year int, days int")
    history = spark.createDataFrame(hist_rows, "origin int, ci long, cj long, year int, active double, activity_eq double")
    got = {(r.ci, r.cj, r.year): r for r in feat.dataset(grid, table, history, [1998, 2000], cfg).collect()}
    assert len(got) == 40 and len(feat.FEATURES) == 17 and set(feat.FEATURES) <= set(next(iter(got.values())).asDict())

    def plain(i, j, t):
        past = [days.get((i, j, y), 0) for y in range(1994, t)]
        fired = [y for y in range(1994, t) if days.get((i, j, y), 0) > 0]
        own = [(y, a, q) for o, a_, b_, y, a, q in hist_rows if (o, a_, b_) == (t, i, j) and y < t]
        return {
            "lag1_days": past[-1], "lag1": int(past[-1] > 0), "lag2": int(past[-2] > 0), "lag3": int(past[-3] > 0), "freq": mean(x > 0 for x in past),
            "freq_heavy": mean(x >= 3 for x in past), "mean_days": mean(past), "years_since_burn": t - max(fired) if fired else 15,
            "long_share": mean(a for _, a, _ in own), "long_activity": mean(q for *_, q in own), "long_recent3": mean(a for y, a, _ in own if y >= t - 3),
            "log_pop": math.log1p(10 * i), "elev_mean": 100.0 * j, "slope_mean": 3.0 * i + j, "steep_frac": 0.1 * j, "burned": int(days.get((i, j, t), 0) >= 3),
        }

    flat = {k: plain(*k) for k in got}
    for (i, j, t), r in got.items():
        want = flat[i, j, t]
        near = [(a, b, t) for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) if (a, b) != (i, j) and (a, b, t) in flat]
        want |= {"nbr_lag1": sum(flat[k]["lag1"] for k in near) / 8, "nbr_freq": sum(flat[k]["freq"] for k in near) / 8}
        assert {k: r[k] for k in want} == pytest.approx(want)


def test_ranking_measures_against_every_order_of_ties(spark):
    rng = random.Random(8)
    for _ in range(3):
        rows = [(int(rng.random() < 0.4), rng.randrange(3) / 4) for _ in range(6)]
        if len({y for y, _ in rows}) < 2:
            continue
        df = spark.createDataFrame(rows, "y int, s double")
        orders = [o for o in itertools.permutations(rows) if all(a[1] >= b[1] for a, b in zip(o, o[1:], strict=False))]
        for k in (1, 3, 5):
            assert rank.precision_at_k(df, "s", "y", k).first().precision == pytest.approx(mean(sum(y for y, _ in o[:k]) / k for o in orders))
        assert rank.precision_at_k(df, "s", "y", 7).first().precision is None
        hits, misses = [s for y, s in rows if y], [s for y, s in rows if not y]
        assert rank.roc_auc(df, "s", "y").first().auc == pytest.approx(mean((a > b) + (a == b) / 2 for a in hits for b in misses))
        steps, found = sorted({s for _, s in rows}, reverse=True), 0
        ap = 0.0
        for s in steps:
            above = [y for y, t in rows if t >= s]
            ap += (sum(above) - found) / len(hits) * sum(above) / len(above)
            found = sum(above)
        assert rank.average_precision(df, "s", "y").first().avg_precision == pytest.approx(ap)


def test_choice_by_tolerance_against_brute_force(spark):
    rng, order = random.Random(2), ["plain", "older", "longer", "trees"]
    for _ in range(8):
        rows = [(m, round(rng.uniform(0.3, 0.36), 3), round(rng.uniform(0.2, 0.25), 3)) for m in order]
        near = [m for m, p, a in rows if p >= max(r[1] for r in rows) - 0.02 and a >= max(r[2] for r in rows) - 0.02]
        got = rank.choose_default(spark.createDataFrame(rows, "method string, p50 double, ap double"), order, fallback="none of them").first().chosen
        assert got == (near[0] if near else "none of them")


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(19)
    return [(i, j, rng.randrange(8), rng.choice([None, rng.uniform(0, 40)]), rng.uniform(0, 30_000), rng.uniform(0, 60_000), rng.random()) for i in range(9) for j in range(8)]


CELLS = "ci long, cj long, fire_days int, fire_slope double, people_r1 double, people_r2 double, forecast_score double"


def brute_score(r, kind, p, limit=None):
    _, _, days, slope, r1, r2, fc = r
    if slope is None:
        return 0.0
    unit = lambda x: max(0.0, min(1.0, x))
    burn = days / p["heavy_days"] if kind == "observed" else fc / limit[p["forecast_q"]]
    return unit(burn) * unit(slope / p["slope_full"]) * unit(math.log1p(r1 if p["pop_radius"] == 1 else r2) / math.log1p(p["people_full"]))


@pytest.mark.parametrize("kind", ["observed", "forecast"])
def test_robustness_and_priority_against_brute_force(spark, cells, kind):
    df, n = spark.createDataFrame(cells, CELLS), 12
    scores = sorted(r[6] for r in cells)

    def quantile(q):
        at = q * (len(scores) - 1)
        return scores[math.floor(at)] + (at % 1) * (scores[math.ceil(at)] - scores[math.floor(at)])

    limit = {q: quantile(q) for q in rank.VARIANTS["forecast_q"]}
    tops = []
    for p in rank.settings(kind):
        s = {r[:2]: brute_score(r, kind, p, limit) for r in cells}
        tops.append([c for c in sorted(s, key=lambda c: (-s[c], -c[0], c[1])) if s[c] > 0][:n])
    assert len(tops) == 55
    share = {r[:2]: sum(r[:2] in t for t in tops[1:]) / 54 for r in cells}
    got = {(r.ci, r.cj): r for r in rank.prioritise(df, kind, n).collect()}
    for r in cells:
        g = got[r[:2]]
        assert g.robustness == pytest.approx(share[r[:2]]) and g.score == pytest.approx(brute_score(r, kind, rank.DEFAULT, limit), abs=6e-5)
        inspect = g["rank"] <= 3 * n and (r[3] or 0) >= 15 and g.score > 0
        active = (r[2] if kind == "observed" else r[6]) > 0
        assert g.priority == ("inspect first" if share[r[:2]] >= 0.8 else "inspect" if inspect else "monitor" if active else "none")
        assert g.action == rank.ACTIONS[g.priority]
    assert sorted(g["rank"] for g in got.values()) == list(range(1, len(cells) + 1))
    one = rank.robustness_summary(df, kind, n).first()
    jaccard = [len(set(t) & set(tops[0])) / len(set(t) | set(tops[0])) for t in tops[1:]]
    assert (one.variants, one.jaccard_median, one.jaccard_min) == (54, pytest.approx(median(jaccard)), pytest.approx(min(jaccard)))
    assert one.robust_anywhere == sum(v >= 0.8 for v in share.values()) and one.default_top_robust == sum(share[c] >= 0.8 for c in tops[0])


def test_settings_are_arguments(spark, cells):
    df = spark.createDataFrame(cells, CELLS)
    few = {"heavy_days": [2], "forecast_q": [0.9], "slope_full": [10.0], "people_full": [10.0], "pop_radius": [2]}
    assert {r.robustness for r in rank.robustness(df, "observed", 5, few).collect()} == {0.0, 1.0}


def test_neighbours_dilation_and_bounds(spark):
    rng = random.Random(3)
    rows = [(i, j, rng.choice([None, rng.uniform(0, 9)])) for i in range(5) for j in range(5) if rng.random() < 0.7]
    value = {(i, j): v or 0.0 for i, j, v in rows}
    got = {(r.ci, r.cj): r.m for r in neighbour_mean(spark.createDataFrame(rows, "ci long, cj long, population double"), "population", "m").collect()}
    near = lambda i, j: [(a, b) for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1)]
    assert got == pytest.approx({c: sum(value.get(x, 0.0) for x in near(*c) if x != c) / 8 for c in value})
    wide = dilate(spark.createDataFrame(rows, "fi long, fj long, v double")).collect()
    assert {(r.fi, r.fj) for r in wide} == {x for c in value for x in near(*c)} and len(wide) == len(set(wide))
    one = spark.range(1).select(cell(F.lit(-0.001), 0.01).alias("c"), F.array(*bounds(F.lit(3), F.lit(-2), 0.5)).alias("b")).first()
    assert one.c == -1 and one.b == [-1.0, 1.5, -0.5, 2.0]


def test_boosted_trees_are_fitted_before_each_origin(spark):
    """The season itself decides nothing: its labels turned round, the scores stay."""
    rng = random.Random(6)
    rows = [(t, y, rng.random(), rng.randrange(2)) for t in (3, 4) for y in range(1, t + 1) for _ in range(30)]
    rows = [(t, y, x, int(x > 0.5)) for t, y, x, _ in rows]
    schema = "origin int, year int, lag1_days double, burned int"
    score = lambda data: [(r.year, r.lag1_days, r.score_boosted) for r in feat.boosted_by_origin(spark.createDataFrame(data, schema), [1, 3, 4], columns=["lag1_days"], rounds=3).collect()]
    a, b = score(rows), score([(t, y, x, 1 - z if y == t else z) for t, y, x, z in rows])
    assert sorted(a) == sorted(b) and len(a) == 60
    assert all((s > 0.5) == (x > 0.5) for _, x, s in a if abs(x - 0.5) > 0.1)


def test_chance_is_the_base_rate(spark):
    pts = [(1, c, 2000, f"2000-03-0{d}", s, 1.0, 300.0, 0.0) for c, n, s in ((0, 4, 20.0), (1, 3, 2.0), (2, 1, 30.0)) for d in range(1, n + 1)]
    points = spark.createDataFrame(pts, "ci long, cj long, year int, date string, slope double, steep double, people_r1 double, people_r2 double")
    grid = spark.createDataFrame([(1, c) for c in range(10)], "ci long, cj long")
    got = {r.outcome: (r.base_rate, r.expected) for r in rank.chance(points, grid, [2000], 5).collect()}
    assert got == {"heavy": (0.2, 1.0), "steep": (0.1, 0.5), "steep_people": (0.1, 0.5)}
