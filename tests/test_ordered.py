"""Ranks, places and quantiles that no task works out alone."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import ordered, stats
from quillspan.operators import ranking


def rows_of(rng, n):
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, 1.5, rng.randrange(50) / 4, rng.uniform(-9, 9)]), rng.random() < 0.3) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of(random.Random(1), 3000)
    return rows, spark.createDataFrame(rows, "k string, v double, hit boolean").repartition(5)


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("down", [False, True])
def test_running_sums(spark, table, keys, down):
    rows, df = table
    counts = df.groupBy(*keys, "v").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("h"), F.lit("mine").alias("range_"))
    got = ordered.running_before(counts, "v", {"n0": "n", "h0": "h"}, keys, down).collect()
    assert len(got) == counts.count() and all(r.range_ == "mine" for r in got)
    place = lambda v: (v is not None, v or 0.0)
    for r in got:
        mine = [x for x in rows if (not keys or x[0] == r.k) and (place(x[1]) > place(r.v) if down else place(x[1]) < place(r.v))]
        assert (r.n0, r.h0) == (len(mine), sum(x[2] for x in mine))
    assert ordered.running_before(counts.limit(0), "v", {"n0": "n"}, keys).count() == 0


def test_sums_are_made_range_by_range(spark, table, monkeypatch):
    """Each key's values are spread over ranges, and what one task adds up in order is one range."""
    seen = []
    real = ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, label: seen.append(real(df, label)) or seen[-1])
    _, df = table
    for ask in (lambda: stats.spearman(df.na.fill(0.0, ["v"]).withColumn("w", F.col("v") * 2), "v", "w"), lambda: ranking.roc_auc(df.na.fill(0.0, ["v"]).withColumn("y", F.col("hit").cast("int")), "v", "y"), lambda: stats.mann_whitney(df, "k", "v", "a", "b")):
        seen.clear()
        plan = ask()._jdf.queryExecution().executedPlan().toString()
        assert seen and all(t.select("range_").distinct().count() == 4 for t in seen)
        assert all(t.groupBy("range_").count().agg(F.max("count") / F.sum("count")).first()[0] < 0.6 for t in seen)
        assert "CartesianProduct" not in plan
    assert ask().first().n1 > 0


def test_numbers_of_rows(spark, table):
    rows, df = table
    got = ordered.numbered(df, [F.col("v").desc(), F.col("k").asc_nulls_last()], "place").collect()
    assert sorted(r.place for r in got) == list(range(1, len(rows) + 1))
    order = [(r.v is None, -(r.v or 0), r.k is None, r.k or "") for r in sorted(got, key=lambda r: r.place)]
    assert order == sorted(order)


def test_average_ranks_and_measures(spark, table):
    rows, df = table
    known = [r for r in rows if r[1] is not None]
    v = np.array([r[1] for r in known])
    want = {x: (v < x).sum() + ((v == x).sum() + 1) / 2 for x in set(v.tolist())}
    got = stats.average_rank(df.filter("v is not null"), "v", "r")
    assert Counter((x.v, x.r) for x in got.collect()) == Counter((x, want[x]) for x in v.tolist())
    hit = np.array([r[2] for r in known])
    pairs = sum(((v[hit][:, None] > v[~hit][None]) + 0.5 * (v[hit][:, None] == v[~hit][None])).ravel())
    auc = ranking.roc_auc(df.filter("v is not null").withColumn("y", F.col("hit").cast("int")), "v", "y").first().auc
    assert auc == pytest.approx(pairs / (hit.sum() * (~hit).sum()))


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_quantiles(spark, table, keys):
    rows, df = table
    levels = [0.0, 0.025, 0.5, 0.9, 0.975, 1.0]
    got = ordered.quantiles(df, "v", levels, "q", keys).collect()
    assert len(got) == (3 if keys else 1)
    for r in got:
        assert r.q == pytest.approx(np.quantile([x[1] for x in rows if x[1] is not None and (not keys or x[0] == r.k)], levels).tolist())
    one = df.filter("v is not null").limit(1)
    assert len(set(ordered.quantiles(one, "v", levels, "q").first().q)) == 1
    assert ordered.quantiles(df.limit(0), "v", levels, "q", ("k",)).count() == 0


def test_codes_follow_a_hidden_order(spark):
    df = spark.range(120).select(F.col("id").alias("ci"), (F.col("id") * 3).alias("cj"))
    codes = {r.ci: r.code for r in ranking.blind_codes(df, 7, ["ci", "cj"]).collect()}
    assert sorted(codes.values(), key=lambda c: int(c[1:])) == [f"P{k:02d}" for k in range(1, 121)]
    assert [codes[k] for k in sorted(codes)] != sorted(codes.values(), key=lambda c: int(c[1:]))
