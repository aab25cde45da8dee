"""Distribution fits. Spark reduces a column to sufficient statistics, for mixtures anew in every round; only those reach a solver."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.atmosphere import STEFAN_BOLTZMANN
from ..sources.scratch import scratch_path
from . import ranks, stats

BINS = 8192
NAN = math.nan


@dataclass(frozen=True)
class Fit:
    family: str
    params: Mapping[str, object]
    n: int


def binned(df: DataFrame, column: str, low: float | None = None, high: float | None = None, bins: int = BINS, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean of each bin, count, or sum of ``weight``): at most ``bins`` rows on the driver, whatever the input. Bounds are exclusive."""
    c = F.col(column)
    ok = df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf) & (c > low if low is not None else F.lit(True)) & (c < high if high is not None else F.lit(True)))
    lo, hi = ok.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return np.zeros(0), np.zeros(0)
    width = (hi - lo) / bins or 1.0
    rows = ok.groupBy(F.least(F.floor((c - lo) / width), F.lit(bins - 1)).alias("b")).agg((F.avg(c) if weight is None else F.sum(c * F.col(weight)) / F.sum(weight)).alias("x"), (F.count("*") if weight is None else F.sum(weight)).alias("n")).orderBy("b").collect()
    return np.array([r.x for r in rows]), np.array([r.n for r in rows], float)


def _moments(df: DataFrame, *cols: Column) -> tuple:
    return tuple(df.agg(F.count("*"), *cols).first())


def fit_weibull(df: DataFrame, column: str) -> dict:
    """Newton on the shape, in logs; started from Justus's rule. Each step is one aggregate over the positive sample, with no bins between."""
    c = F.col(column)
    ok = df.where(c > 0)
    n, mean, std, mean_log, top = _moments(ok, F.avg(c), F.stddev_samp(c), F.avg(F.log(c)), F.max(F.log(c)))
    if n < 2 or not std:
        return {"shape": NAN, "scale": NAN}
    logs = F.log(c)

    def sums(k: float) -> tuple[float, float, float]:
        w = F.exp(F.lit(k) * (logs - F.lit(top)))
        return tuple(ok.agg(F.sum(w), F.sum(w * logs), F.sum(w * logs * logs)).first())

    k = (std / mean) ** -1.086
    for _ in range(60):
        w, wl, wll = sums(k)
        a = wl / w
        step = (1 / k + mean_log - a) / (-1 / (k * k) - (wll / w - a * a))
        k = max(k - step, k / 2)
        if abs(step) < 1e-10:
            break
    return {"shape": k, "scale": math.exp(top + math.log(sums(k)[0] / n) / k)}


def fit_gamma(df: DataFrame, column: str) -> dict:
    n, mean, mean_log = _moments(df.where(F.col(column) > 0), F.avg(column), F.avg(F.log(column)))
    if n < 2 or math.log(mean) - mean_log <= 0:
        return {"shape": NAN, "scale": NAN}
    s = math.log(mean) - mean_log
    k = (1 + math.sqrt(1 + 4 * s / 3)) / (4 * s)
    for _ in range(100):
        step = (math.log(k) - special.digamma(k) - s) / (1 / k - special.trigamma(k))
        k = max(k - step, k / 2)
        if abs(step) < 1e-12 * k:
            break
    return {"shape": k, "scale": mean / k}


def fit_beta(df: DataFrame, column: str) -> dict:
    c = F.col(column)
    n, mean, var, g1, g2 = _moments(df.where((c > 0) & (c < 1)), F.avg(c), F.var_pop(c), F.avg(F.log(c)), F.avg(F.log(1 - c)))
    if n < 2 or not var:
        return {"a": NAN, "b": NAN}
    both = mean * (1 - mean) / var - 1
    a, b = max(mean * both, 1e-3), max((1 - mean) * both, 1e-3)
    for _ in range(200):
        d, t = special.digamma(a + b), special.trigamma(a + b)
        f1, f2 = special.digamma(a) - d - g1, special.digamma(b) - d - g2
        h11, h22 = special.trigamma(a) - t, special.trigamma(b) - t
        det = h11 * h22 - t * t
        da, db = (h22 * f1 + t * f2) / det, (t * f1 + h11 * f2) / det
        a, b = max(a - da, a / 2), max(b - db, b / 2)
        if abs(da) + abs(db) < 1e-11 * (a + b):
            break
    return {"a": a, "b": b}


def fit_normal(df: DataFrame, column: str) -> dict:
    n, mean, std = _moments(df.where(F.col(column).isNotNull()), F.avg(column), F.stddev_samp(column))
    return {"mean": mean, "std": std} if n >= 2 and std else {"mean": NAN, "std": NAN}


def _hollands_constant(lam: float, top: float) -> tuple[float, float]:
    """(constant, mean) of C (1 - x / top) exp(lam x)."""
    s = lam * top
    if abs(s) < 1e-4:
        return 2 / top, top / 3
    e = math.exp(s)
    c = top * lam * lam / (e - 1 - s)
    m1 = top * e / lam - (e - 1) / lam**2
    m2 = top * top * e / lam - 2 * m1 / lam
    return c, c * (m1 - m2 / top)


def fit_hollands_huget(df: DataFrame, column: str, kt_max: float | None = None) -> dict:
    ok = df.where(F.col(column) >= 0)
    top = kt_max
    if top is None:
        drawn = ranks.quantiles(ok, column, [0.995]).first()
        top = drawn.q[0] if drawn and drawn.q else None
    if not top or top <= 0:
        return {"lambda": NAN, "kt_max": NAN}
    n, mean = _moments(ok.where(F.col(column) < top), F.avg(column))
    if n < 2:
        return {"lambda": NAN, "kt_max": top}
    low, high = -60.0, 60.0
    while high - low > 1e-10:
        mid = (low + high) / 2
        low, high = (mid, high) if _hollands_constant(mid, top)[1] < mean else (low, mid)
    return {"lambda": (low + high) / 2, "kt_max": top}


#: EM stops when no parameter moves by more than this share of its size.
TOLERANCE = 1e-8


def _sums(values: DataFrame, of) -> np.ndarray:
    """The sum over all rows (x, n) of ``of(x, n)``, a vector: every task adds its rows up, the driver adds a vector a task."""

    def task(batches):
        total = 0.0
        for b in batches:
            total = total + of(b.column("x").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False).astype(float))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    return np.sum([r.s for r in values.mapInArrow(task, "s array<double>").collect()], axis=0)


def _settled(theta: np.ndarray, step, valid, rounds: int) -> np.ndarray:
    """The fixed point of EM steps: after every two steps the path is extrapolated (squared extrapolation), if that is ``valid``."""
    done = 0
    while done < rounds:
        one = step(theta)
        two = step(one)
        done += 2
        if np.all(np.abs(two - one) <= TOLERANCE * np.maximum(1.0, np.abs(two))):
            return two
        r, v = one - theta, (two - one) - (one - theta)
        far = np.linalg.norm(r) / max(np.linalg.norm(v), 1e-300)
        leap = theta + 2 * far * r + far * far * v
        theta = step(leap) if far > 1 and np.all(np.isfinite(leap)) and valid(leap) else two
        done += 1
    return theta


def _normal_sums(theta: np.ndarray, components: int):
    w, mu, sd = np.split(theta, 3)

    def of(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        logs = np.log(np.maximum(w, 1e-300)) - 0.5 * ((x[:, None] - mu) / sd) ** 2 - np.log(sd)
        d = np.exp(logs - logs.max(axis=1, keepdims=True))
        r = d / d.sum(axis=1, keepdims=True) * n[:, None]
        z = x[:, None] - mu  # moments about the present means lose no digits
        return np.concatenate([r.sum(axis=0), (r * z).sum(axis=0), (r * z * z).sum(axis=0)])

    return of


def em_normal(values: DataFrame | tuple[np.ndarray, np.ndarray], components: int, rounds: int = 600, start: np.ndarray | None = None) -> dict:
    """Normal mixture by EM over rows (x, n), n their weights; components by ascending mean. Without a start: quantiles of an array."""
    if start is None:
        x, n = values
        total = n.sum()
        cum = (np.cumsum(n) - n / 2) / total
        mean = (n * x).sum() / total
        sd = np.full(components, (math.sqrt((n * (x - mean) ** 2).sum() / total) or 1.0) / components)
        start = np.concatenate([np.full(components, 1 / components), np.interp(np.linspace(0.5 / components, 1 - 0.5 / components, components), cum, x), sd])

    def step(theta: np.ndarray) -> np.ndarray:
        of = _normal_sums(theta, components)
        mass, first, second = np.split(of(*values) if isinstance(values, tuple) else _sums(values, of), 3)
        mass = np.maximum(mass, 1e-300)
        shift = first / mass
        return np.concatenate([mass / mass.sum(), np.split(theta, 3)[1] + shift, np.sqrt(np.maximum(second / mass - shift**2, 1e-12))])

    theta = _settled(start, step, lambda t: (np.split(t, 3)[0] > 0).all() and (np.split(t, 3)[2] > 0).all(), rounds)
    w, mu, sd = np.split(theta, 3)
    o = np.argsort(mu)
    return {"weights": w[o].tolist(), "mu": mu[o].tolist(), "sigma": sd[o].tolist()}


def _weighted(df: DataFrame, value: Column) -> DataFrame:
    """(x, n): the distinct values with their counts, written once for all rounds."""
    path = scratch_path(df.sparkSession, "mixture")
    df.select(value.cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(F.count("*").alias("n")).write.parquet(path)
    return df.sparkSession.read.schema("x double, n long").parquet(path)


def fit_power_normal_mixture(df: DataFrame, column: str, components: int = 2) -> dict:
    """A normal mixture of the brightness temperature (F / sigma)^(1/4): EM over all rows, from where EM over a histogram has come."""
    rows = _weighted(df, F.pow(F.greatest(F.col(column), F.lit(0.0)) / STEFAN_BOLTZMANN, F.lit(0.25)))
    x, n = binned(rows.withColumnRenamed("x", "t").withColumn("_w", F.col("n")), "t", weight="_w")
    if n.sum() < components:
        return {k: [NAN] * components for k in ("weights", "mu", "sigma")}
    first = em_normal((x, n), components)
    return em_normal(rows, components, start=np.concatenate([first["weights"], first["mu"], first["sigma"]]))


def fit_compound(df: DataFrame | None, column: str | None, *, lam: float, kt_max: float, scales: Sequence[float], weights: Sequence[float], gain: float = 1.0) -> dict:
    """A clearness law carried to flux units by a discrete mixture of scales; nothing is estimated."""
    return {"lambda": lam, "kt_max": kt_max, "gain": gain, "scales": [float(s) for s in scales], "weights": [float(w) for w in weights]}


def fit_gaussian_compound(df: DataFrame | None, column: str | None, *, slope: float, intercept: float, residual_sd: float, **shape) -> dict:
    """The compound law through a linear relation with normal residuals."""
    return fit_compound(None, None, **shape) | {"slope": slope, "intercept": intercept, "residual_sd": residual_sd}


def _hollands(p, x):
    c, top, x = _hollands_constant(p["lambda"], p["kt_max"])[0], p["kt_max"], np.asarray(x, float)
    inside = (x >= 0) & (x <= top)
    s = np.where(inside, x, 0.0)
    return np.where(inside, c * (1 - s / top) * np.exp(p["lambda"] * s), 0.0)


def _hollands_cdf(p, x):
    lam, top = p["lambda"], p["kt_max"]
    v = np.clip(np.asarray(x, float), 0, top)
    if abs(lam * top) < 1e-4:
        return v / top * (2 - v / top)
    c, e = _hollands_constant(lam, top)[0], np.exp(lam * v)
    return np.clip(c * ((e - 1) / lam - ((v / lam - 1 / lam**2) * e + 1 / lam**2) / top), 0, 1)


def _scales(p):
    return p.get("gain", 1.0) * np.asarray(p["scales"]), np.asarray(p["weights"])


def _gauss_terms(p):
    nodes, w = np.polynomial.legendre.leggauss(96)
    k = 0.5 * p["kt_max"] * (nodes + 1)
    share = 0.5 * p["kt_max"] * w * _hollands(p, k)
    s, sw = _scales(p)
    return (p["slope"] * np.multiply.outer(k, s) + p["intercept"]).ravel(), np.multiply.outer(share, sw).ravel()


def _mix(p, z, fn):
    return sum(w * fn((z - m) / s, s) for w, m, s in zip(p["weights"], p["mu"], p["sigma"]))


_phi = lambda z, s=1.0: np.exp(-0.5 * np.asarray(z) ** 2) / (s * math.sqrt(2 * math.pi))


def _power(p, x, cdf: bool):
    x = np.asarray(x, float)
    t = (np.maximum(x, 0) / STEFAN_BOLTZMANN) ** 0.25
    if cdf:
        return np.clip(_mix(p, t, lambda z, s: special.normal_cdf(z)), 0, 1)
    safe = np.where(x > 0, x, 1.0)
    return np.where(x > 0, _mix(p, t, _phi) * 0.25 * STEFAN_BOLTZMANN**-0.25 * safe**-0.75, 0.0)


def _over_scales(p, x, fn, divide: bool):
    s, w = _scales(p)
    return sum(fn(p, np.asarray(x, float) / si) * wi / (si if divide else 1) for si, wi in zip(s, w))


def _around_terms(p, x, fn):
    """Sum over the quadrature terms of their weight times ``fn`` of the standardised gap."""
    sd = p["residual_sd"]
    return np.array([sum(w * fn((v - m) / sd) for m, w in zip(*_gauss_terms(p))) for v in np.atleast_1d(x)])


@dataclass(frozen=True)
class Family:
    fit: Callable[..., dict]
    pdf: Callable
    cdf: Callable
    support: tuple[float, float]
    options: tuple[str, ...] = field(default=())


_SHAPE = ("lam", "kt_max", "scales", "weights", "gain")
FAMILIES: dict[str, Family] = {
    "weibull": Family(fit_weibull, lambda p, x: np.where(np.asarray(x) > 0, p["shape"] / p["scale"] * (np.maximum(x, 1e-300) / p["scale"]) ** (p["shape"] - 1) * np.exp(-((np.maximum(x, 0) / p["scale"]) ** p["shape"])), 0.0), lambda p, x: 1 - np.exp(-((np.maximum(x, 0) / p["scale"]) ** p["shape"])), (0, math.inf)),
    "gamma": Family(fit_gamma, lambda p, x: np.where(np.asarray(x) > 0, np.exp((p["shape"] - 1) * np.log(np.maximum(x, 1e-300)) - np.asarray(x) / p["scale"] - math.lgamma(p["shape"]) - p["shape"] * math.log(p["scale"])), 0.0), lambda p, x: special.gamma_cdf(p["shape"], np.asarray(x) / p["scale"]), (0, math.inf)),
    "beta": Family(fit_beta, lambda p, x: np.where((np.asarray(x) > 0) & (np.asarray(x) < 1), np.exp((p["a"] - 1) * np.log(np.clip(x, 1e-300, 1)) + (p["b"] - 1) * np.log(np.clip(1 - np.asarray(x), 1e-300, 1)) + math.lgamma(p["a"] + p["b"]) - math.lgamma(p["a"]) - math.lgamma(p["b"])), 0.0), lambda p, x: special.beta_cdf(p["a"], p["b"], x), (0, 1)),
    "normal": Family(fit_normal, lambda p, x: _phi((np.asarray(x) - p["mean"]) / p["std"], p["std"]), lambda p, x: special.normal_cdf((np.asarray(x) - p["mean"]) / p["std"]), (-math.inf, math.inf)),
    "hollands_huget": Family(fit_hollands_huget, _hollands, _hollands_cdf, (0, math.inf), ("kt_max",)),
    "compound_hollands": Family(fit_compound, lambda p, x: _over_scales(p, x, _hollands, True), lambda p, x: np.clip(_over_scales(p, x, _hollands_cdf, False), 0, 1), (0, math.inf), _SHAPE),
    "power_normal_mixture": Family(fit_power_normal_mixture, lambda p, x: _power(p, x, False), lambda p, x: _power(p, x, True), (0, math.inf), ("components",)),
    "gaussian_compound": Family(fit_gaussian_compound, lambda p, x: _around_terms(p, x, lambda z: _phi(z) / p["residual_sd"]), lambda p, x: np.clip(_around_terms(p, x, special.normal_cdf), 0, 1), (-math.inf, math.inf), (*_SHAPE, "slope", "intercept", "residual_sd")),
}


def fit_distribution(df: DataFrame, column: str, family: str, **options) -> Fit:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    spec = FAMILIES[family]
    wrong = set(options) - set(spec.options)
    if wrong:
        raise ValueError(f"{family} takes no {sorted(wrong)}")
    low, high = spec.support
    c = F.col(column)
    ok = df.where(c.isNotNull() & ~F.isnan(c) & (c >= low if low > -math.inf else F.lit(True)) & (c <= high if high < math.inf else F.lit(True)))
    return Fit(family, spec.fit(ok, column, **options), ok.count())


def pdf(fit: Fit, x) -> np.ndarray:
    return FAMILIES[fit.family].pdf(fit.params, np.asarray(x, float))


def cdf(fit: Fit, x) -> np.ndarray:
    return np.asarray(FAMILIES[fit.family].cdf(fit.params, np.asarray(x, float)))


def ppf(fit: Fit, q, rounds: int = 100) -> np.ndarray:
    """From a bracket that is widened until it holds every quantile, narrowed on grids, then by inverse quadratic steps inside each quantile's
    own bracket (Chandrupatla); by bisection at 0 and 1. Some ten values of the distribution function a quantile, for a hundred of bisection alone."""
    q = np.clip(np.atleast_1d(np.asarray(q, float)), 0, 1)
    inner = np.clip(q, 1e-12, 1 - 1e-12)
    if not q.size:
        return q
    low_end, high_end = FAMILIES[fit.family].support
    high, low = 1.0 if high_end == math.inf else float(high_end), low_end if low_end > -math.inf else -1.0
    of = lambda x: float(cdf(fit, np.array([x]))[0])
    for _ in range(200):
        if high_end < math.inf or not of(high) < inner.max():
            break
        high *= 2
    for _ in range(200):
        if low_end > -math.inf or not of(low) > inner.min():
            break
        low *= 2
    ends = (q <= 0) | (q >= 1)
    out = np.empty_like(q)
    out[ends] = _bisected(fit, q[ends], low, high, rounds)
    out[~ends] = _inverted(fit, q[~ends], low, high, rounds)
    return out


def _bisected(fit: Fit, q: np.ndarray, low: float, high: float, rounds: int) -> np.ndarray:
    low, high = np.full_like(q, low), np.full_like(q, high)
    for _ in range(rounds if q.size else 0):
        mid = (low + high) / 2
        over = cdf(fit, mid) > q
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    return (low + high) / 2


def _inverted(fit: Fit, q: np.ndarray, low: float, high: float, rounds: int, cells: int = 256) -> np.ndarray:
    if not q.size:
        return q
    for _ in range(6 if q.size > cells else 1):
        grid = np.linspace(low, high, cells + 1)
        values = np.maximum.accumulate(cdf(fit, grid))
        first, last = max(np.searchsorted(values, q.min(), "right") - 1, 0), min(np.searchsorted(values, q.max(), "right"), cells)
        if last - first > cells // 2:
            break
        low, high = grid[first], grid[last]
    grid = np.linspace(low, high, cells + 1)
    values = np.maximum.accumulate(cdf(fit, grid))
    k = np.clip(np.searchsorted(values, q, "right") - 1, 0, cells - 1)
    a, b = grid[k + 1].copy(), grid[k].copy()
    fa, fb = values[k + 1] - q, values[k] - q
    c, fc, t = a.copy(), fa.copy(), np.full_like(q, 0.5)
    out, live = np.where(np.abs(fa) < np.abs(fb), a, b), np.arange(q.size)
    for _ in range(rounds):
        x = a + t * (b - a)
        fx = cdf(fit, x) - q[live]
        same = np.sign(fx) == np.sign(fa)
        c, fc = np.where(same, a, b), np.where(same, fa, fb)
        b, fb = np.where(same, b, a), np.where(same, fb, fa)
        a, fa = x, fx
        best = np.where(np.abs(fa) < np.abs(fb), a, b)
        out[live] = best
        width = np.abs(b - a)
        tolerance = np.divide(2 * np.finfo(float).eps * np.abs(best) + 1e-300, width, out=np.ones_like(width), where=width > 0)
        go = (tolerance < 0.5) & (fa != 0) & (fb != 0)
        if not go.any():
            break
        live, a, b, c, fa, fb, fc, tolerance = (v[go] for v in (live, a, b, c, fa, fb, fc, tolerance))
        with np.errstate(divide="ignore", invalid="ignore"):
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            quadratic = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
        smooth = (phi * phi < xi) & ((1 - phi) * (1 - phi) < 1 - xi) & np.isfinite(quadratic)
        t = np.clip(np.where(smooth, quadratic, 0.5), tolerance, 1 - tolerance)
    return out


#: Ranks whose quantiles are computed at once.
RANKS = 65_536


def goodness_of_fit(df: DataFrame, column: str, fit: Fit, order: str | None = None, edges: Sequence[float] | None = None, whole: int = ranks.WHOLE) -> DataFrame:
    """One row: n, ks, quantile_gap, density_r2, n_eff, r1. All but n are null for fewer than two values.

    The distribution function and its inverse are evaluated at every value, in Arrow batches over the distinct values with their counts: ks is the largest
    distance of the two distribution functions, quantile_gap the mean distance of the i-th of n values from the quantile of (i - 1/2) / n.
    density_r2 compares the densities over ``edges`` with the fitted one at the centres; n_eff and r1 need the ``order`` of the series.
    """
    low_end, high_end = FAMILIES[fit.family].support
    c = F.col(column).cast("double")
    sound = df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    ok = sound.where((c >= low_end if low_end > -math.inf else F.lit(True)) & (c <= high_end if high_end < math.inf else F.lit(True)))

    def distances(batches):
        for b in batches:
            v, m, before, n = (b.column(k).to_numpy(zero_copy_only=False) for k in ("v", "_m", "_before", "_n"))
            model = cdf(fit, v)
            # the step at a value goes from before / n to (before + m) / n
            ks = np.maximum(np.abs((before + m) / n - model), np.abs(model - before / n))
            total, gap, last = int(m.sum()), np.zeros(len(v)), np.cumsum(m)
            for start in range(0, total, RANKS):  # so many ranks at once, however often a value is there
                place = np.arange(start, min(start + RANKS, total))
                k = np.searchsorted(last, place, "right")
                rank = before[k] + place - (last[k] - m[k])
                np.add.at(gap, k, np.abs(v[k] - ppf(fit, (rank + 0.5) / n[k])))
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(ks), pa.array(gap)], ["m", "ks", "gap"])

    # dealt anew: a few distinct values may stand for any number of ranks
    points = ranks.counted(ok.select(c.alias("v")), "v", whole=whole).select("v", "_m", "_before", "_n").repartition(ranks.PARTS, "v")
    got = points.mapInArrow(distances, "m long, ks double, gap double")
    n = F.coalesce(F.sum("m"), F.lit(0).cast("long"))
    out = got.agg(n.alias("n"), F.when(n > 1, F.max("ks")).alias("ks"), F.when(n > 1, F.sum("gap") / n).alias("quantile_gap"))
    none = F.lit(None).cast("double")
    out = out.crossJoin(F.broadcast(_density_fit(sound, column, fit, edges))) if edges is not None else out.withColumn("density_r2", none)  # one row each
    if order is None:
        return out.withColumns({"n_eff": none, "r1": none})
    return out.crossJoin(F.broadcast(stats.effective_sample_size(sound, column, order).select("n_eff", "r1")))


def _density_fit(df: DataFrame, column: str, fit: Fit, edges: Sequence[float]) -> DataFrame:
    """One row with density_r2: 1 - residual over total square, over the bins of a histogram."""
    edges = [float(e) for e in edges]
    centres = (np.array(edges[1:]) + np.array(edges[:-1])) / 2
    model = F.array(*[F.lit(float(x)) for x in pdf(fit, centres)])
    bars = stats.histogram(df, column, edges).withColumn("_m", F.get(model, F.col("bin")))
    total = F.sum(F.col("density") * F.col("density")) - F.sum("density") * F.sum("density") / F.count("*")
    return bars.agg(F.when(total > 0, 1 - F.sum((F.col("density") - F.col("_m")) * (F.col("density") - F.col("_m"))) / total).alias("density_r2"))


def _direction_sums(theta: np.ndarray, components: int):
    w, mu, kappa = np.split(theta, 3)
    norm = np.array([special.log_i0(k) for k in kappa])

    def of(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        t = np.radians(x)[:, None]
        logs = np.log(np.maximum(w, 1e-300)) + kappa * np.cos(t - mu) - norm
        d = np.exp(logs - logs.max(axis=1, keepdims=True))
        r = d / d.sum(axis=1, keepdims=True) * n[:, None]
        return np.concatenate([r.sum(axis=0), (r * np.cos(t)).sum(axis=0), (r * np.sin(t)).sum(axis=0)])

    return of


def fit_von_mises_mixture(df: DataFrame, column: str, components: int = 2, rounds: int = 600, bins: int = 720, seed: int = 0) -> dict:
    """Mixture of directions in degrees by EM, from evenly spaced starts with a seeded jitter; components by falling weight.

    EM over a histogram of ``bins`` bins goes first; EM over all rows goes on from there until it settles.
    """
    rows = _weighted(df, F.pmod(F.col(column), F.lit(360.0)))
    bars = rows.groupBy(F.floor(F.col("x") / (360.0 / bins)).alias("b")).agg(F.sum("n").alias("n")).collect()
    if not bars:
        return {k: [NAN] * components for k in ("weights", "mu", "kappa")}
    coarse = (np.array([r.b for r in bars]) + 0.5) * 360.0 / bins, np.array([r.n for r in bars], float)

    def step(sums):
        def once(theta: np.ndarray) -> np.ndarray:
            mass, c, s = np.split(sums(_direction_sums(theta, components)), 3)
            mass = np.maximum(mass, 1e-300)
            turned = np.arctan2(s, c)
            before = np.split(theta, 3)[1]
            mu = before + np.remainder(turned - before + np.pi, 2 * np.pi) - np.pi  # the nearest turn, so that the path has no jumps
            return np.concatenate([mass / mass.sum(), mu, [_kappa(min(x, 0.9999)) for x in np.hypot(c, s) / mass]])

        return once

    valid = lambda t: (np.split(t, 3)[0] > 0).all() and (np.split(t, 3)[2] > 0).all()
    start = np.concatenate([np.full(components, 1 / components), np.linspace(0, 2 * np.pi, components, endpoint=False) + np.random.default_rng(seed).uniform(0, 0.1, components), np.ones(components)])
    theta = _settled(_settled(start, step(lambda of: of(*coarse)), valid, rounds), step(lambda of: _sums(rows, of)), valid, rounds)
    w, mu, kappa = np.split(theta, 3)
    o = np.argsort(-w)
    return {"weights": w[o].tolist(), "mu": (np.degrees(mu[o]) % 360).tolist(), "kappa": kappa[o].tolist()}


def _kappa(r: float) -> float:
    k = max(r * (2 - r * r) / (1 - r * r), 1e-6)
    for _ in range(50):
        a = special.bessel_ratio(k)
        step = (a - r) / max(1 - a / k - a * a, 1e-12)
        k = max(k - step, k / 2)
        if abs(step) < 1e-12 * max(k, 1):
            break
    return k


def von_mises_pdf(params: Mapping, degrees) -> np.ndarray:
    """Per degree."""
    t = np.radians(np.asarray(degrees, float))
    parts = [w * np.exp(k * np.cos(t - math.radians(m)) - special.log_i0(k)) / (2 * math.pi) for w, m, k in zip(params["weights"], params["mu"], params["kappa"])]
    return sum(parts) * math.pi / 180
