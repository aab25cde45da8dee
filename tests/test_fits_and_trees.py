"""Mixtures and fit quality against NumPy on the sample, the hash tree, rolling medians."""

import hashlib
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflux.operators import distributions, stats, windows
from mesoflux.operators.distributions import Fit

SIGMA = distributions.STEFAN_BOLTZMANN


def plain_em(x, mu, sd, w, rounds):
    for _ in range(rounds):
        d = w * np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / sd
        r = d / np.maximum(d.sum(axis=1, keepdims=True), 1e-300)
        mass = r.sum(axis=0)
        w, mu = mass / len(x), (r * x[:, None]).sum(axis=0) / mass
        sd = np.sqrt((r * (x[:, None] - mu) ** 2).sum(axis=0) / mass)
    o = np.argsort(mu)
    return w[o], mu[o], sd[o]


@pytest.mark.parametrize("tail", [False, True])
def test_power_normal_mixture_equals_em_on_the_sample(spark, tail):
    rng = np.random.default_rng(3)
    t = np.where(rng.random(4000) < 0.4, rng.normal(280, 3, 4000), rng.normal(297, 2, 4000))
    if tail:  # a few values far away, which fill most of a histogram's span
        t[:12] = rng.uniform(300, 900, 12)
    flux = spark.createDataFrame([(float(SIGMA * v**4),) for v in t] + [(None,)], "f double")
    got = distributions.fit_distribution(flux, "f", "power_normal_mixture", components=2).params
    sample = (np.array([SIGMA * v**4 for v in t]) / SIGMA) ** 0.25
    w, mu, sd = plain_em(sample, np.array([np.quantile(sample, 0.25), np.quantile(sample, 0.75)]), np.full(2, sample.std() / 2), np.full(2, 0.5), 3000)
    assert got["mu"] == pytest.approx(mu, rel=1e-5) and got["sigma"] == pytest.approx(sd, rel=1e-4) and got["weights"] == pytest.approx(w, rel=1e-4)


def test_directions_equal_em_on_the_sample(spark):
    rng = np.random.default_rng(4)
    d = np.degrees(np.concatenate([rng.vonmises(math.radians(5), 5, 2000), rng.vonmises(math.radians(200), 2, 1000)])) % 360
    df = spark.createDataFrame([(float(v),) for v in d] + [(None,)], "d double")
    got = distributions.fit_von_mises_mixture(df, "d")
    t, w, mu, kappa = np.radians(d)[:, None], np.full(2, 0.5), np.array([0.0, math.pi]), np.ones(2)
    for _ in range(800):
        e = w * np.exp(kappa * np.cos(t - mu)) / np.i0(kappa)
        r = e / e.sum(axis=1, keepdims=True)
        mass, c, s = r.sum(axis=0), (r * np.cos(t)).sum(axis=0), (r * np.sin(t)).sum(axis=0)
        w, mu, kappa = mass / len(d), np.arctan2(s, c), np.array([distributions._kappa(x) for x in np.hypot(c, s) / mass])
    o = np.argsort(-w)
    assert got["weights"] == pytest.approx(w[o], rel=1e-5) and got["mu"] == pytest.approx(np.degrees(mu[o]) % 360, abs=1e-3) and got["kappa"] == pytest.approx(kappa[o], rel=1e-4)
    assert all(math.isnan(x) for x in distributions.fit_von_mises_mixture(df.where("d > 999"), "d")["mu"])


@pytest.mark.parametrize("whole", [100, 10**6])
def test_goodness_of_fit_is_exact(spark, whole):
    rnd = random.Random(5)
    v = [round(rnd.gammavariate(2.0, 3.0), 1) for _ in range(700)]  # many ties
    df = spark.createDataFrame(list(enumerate(v)) + [(1000, None), (1001, float("nan"))], "i int, v double")
    fit, edges = Fit("gamma", {"shape": 2.1, "scale": 2.9}, 700), [0.0, 2.0, 4.0, 8.0, 16.0]
    got = distributions.goodness_of_fit(df, "v", fit, "i", edges, whole).first()
    x, n = np.sort(v), len(v)
    model = distributions.cdf(fit, x)
    ks = max(np.abs(np.arange(1, n + 1) / n - model).max(), np.abs(model - np.arange(n) / n).max())
    gap = np.abs(x - distributions.ppf(fit, (np.arange(1, n + 1) - 0.5) / n)).mean()
    counts, _ = np.histogram(v, edges)
    density, fitted = counts / counts.sum() / np.diff(edges), distributions.pdf(fit, (np.array(edges[1:]) + edges[:-1]) / 2)
    r1 = np.corrcoef(v[1:], v[:-1])[0, 1]
    assert got.n == n and got.ks == pytest.approx(ks, abs=1e-9) and got.quantile_gap == pytest.approx(gap, abs=1e-9)
    assert got.density_r2 == pytest.approx(1 - ((density - fitted) ** 2).sum() / ((density - density.mean()) ** 2).sum(), abs=1e-9)
    assert got.r1 == pytest.approx(r1, abs=1e-9) and got.n_eff == pytest.approx(n * (1 - r1) / (1 + r1), rel=1e-9)


def test_goodness_of_fit_without_a_sample(spark):
    fit = Fit("normal", {"mean": 0.0, "std": 1.0}, 0)
    for rows in ([], [(1.0,)]):
        got = distributions.goodness_of_fit(spark.createDataFrame(rows, "v double"), "v", fit).first()
        assert (got.n, got.ks, got.quantile_gap) == (len(rows), None, None)


def hash_brute(rows, leaf):
    """rows: (key, json)"""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digits = 3
    while len(rows) > leaf * 16**digits:
        digits += 1
    level = {}
    for k, text in rows:
        level.setdefault(hashlib.md5(k.encode()).hexdigest()[:digits], []).append((k, sha(text)))
    level = {p: sha("".join(h for _, h in sorted(x))) for p, x in level.items()}
    for n in range(digits - 1, 2, -1):
        up = {}
        for p, h in level.items():
            up.setdefault(p[:n], []).append((p, h))
        level = {p: sha("".join(h for _, h in sorted(x))) for p, x in up.items()}
    return sha("".join(h for _, h in sorted(level.items())))


@pytest.mark.parametrize("leaf", [1024, 1e-3])
def test_the_hash_tree_is_the_same_however_rows_are_partitioned(spark, monkeypatch, leaf):
    monkeypatch.setattr(stats, "LEAF_ROWS", leaf)
    df = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id") * 7 % 31).alias("t"))
    want = hash_brute([(str(i), json.dumps({"id": i, "t": f"t{i * 7 % 31}"}, separators=(",", ":"))) for i in range(500)], leaf)
    for same in (df, df.repartition(7), df.orderBy(F.desc("t")).coalesce(1)):
        assert tuple(stats.content_hash(same, ["id"]).first()) == (500, want)
    assert stats.content_hash(df.withColumn("t", F.when(F.col("id") != 77, F.col("t"))), ["id"]).first().hash != want
    assert stats.content_hash(df.limit(0), ["id"]).count() == 1


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_rolling_medians_equal_the_exact_percentile(spark, keys):
    rnd = random.Random(6)
    rows = [(k, i, rnd.choice([None, float(rnd.randrange(5)), rnd.random()])) for k in ("ab" if keys else "a") for i in range(150)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = windows.add_rolling(df, ["v"], [1, 4, 30], ["median", "max"], keys, "i")
        assert got.columns == ["k", "i", "v", *[f"v_roll_{n}_{h}" for n in (1, 4, 30) for h in ("median", "max")]]
        want = df.withColumns({f"w{n}": F.percentile("v", F.lit(0.5)).over(windows.ordered(keys, "i").rowsBetween(-(n - 1), 0)) for n in (1, 4, 30)})
        for a in got.join(want, ["k", "i"]).collect():
            for n in (1, 4, 30):
                assert a[f"v_roll_{n}_median"] == (None if a[f"w{n}"] is None else pytest.approx(a[f"w{n}"], abs=1e-12))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rolling_medians_of_a_million_rows(spark):
    df = spark.range(1_000_000).select("id", (F.xxhash64("id") % 1000).cast("double").alias("v"))
    began = time.time()
    assert windows.add_rolling(df, ["v"], [500], ["median"], ts="id").agg(F.count("v_roll_500_median")).first()[0] == 1_000_000
    assert time.time() - began < 60
