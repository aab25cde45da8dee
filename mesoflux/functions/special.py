"""Special functions in NumPy, for solvers and distribution functions over a few thousand points."""

from __future__ import annotations

import math

import numpy as np



def _lgamma(x) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)  # made here, since such objects can't be sent to workers


def _erf(x) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def normal_cdf(z):
    return 0.5 * (1 + _erf(np.asarray(z, float) / math.sqrt(2)))


def digamma(x: float) -> float:
    """Recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def gamma_cdf(a: float, x):
    """Regularised lower incomplete gamma: series below a + 1, continued fraction (Lentz) above."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.zeros_like(x)
    for i, v in enumerate(x):
        if v <= 0:
            continue
        front = math.exp(-v + a * math.log(v) - math.lgamma(a))
        if v < a + 1:
            term = total = 1 / a
            n = a
            for _ in range(2000):
                n += 1
                term *= v / n
                total += term
                if abs(term) < abs(total) * 1e-16:
                    break
            out[i] = front * total
        else:
            b, c = v + 1 - a, 1e300
            d = h = 1 / b
            for k in range(1, 2000):
                an = -k * (k - a)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out[i] = 1 - front * h
    return np.clip(out, 0, 1)


def beta_cdf(a: float, b: float, x):
    """Regularised incomplete beta by its continued fraction."""

    def fraction(a: float, b: float, v: float) -> float:
        c, d = 1.0, 1 / ((1 - (a + b) * v / (a + 1)) or 1e-300)
        h = d
        for m in range(1, 500):
            for even in (True, False):
                num = m * (b - m) * v / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * v / ((a + 2 * m) * (a + 2 * m + 1))
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    out = []
    for v in np.clip(np.atleast_1d(np.asarray(x, float)), 0, 1):
        if v in (0.0, 1.0):
            out.append(v)
            continue
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(v) + b * math.log(1 - v))
        out.append(front * fraction(a, b, v) / a if v < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - v) / b)
    return np.array(out)


def lgamma(x):
    return _lgamma(x)


def bessel_ratio(kappa: float) -> float:
    """I1 / I0: power series up to 20, asymptotic expansion beyond."""
    if kappa < 20:
        q = kappa * kappa / 4
        i0 = t0 = 1.0
        i1 = t1 = kappa / 2
        for k in range(1, 200):
            t0 *= q / (k * k)
            t1 *= q / (k * (k + 1))
            i0 += t0
            i1 += t1
            if t0 < i0 * 1e-17:
                break
        return i1 / i0
    z = 1 / kappa
    return 1 - z * (0.5 + z * (0.125 + z * (0.125 + z * 0.1953125)))


def log_i0(kappa: float) -> float:
    if kappa < 20:
        q, total, term = kappa * kappa / 4, 1.0, 1.0
        for k in range(1, 200):
            term *= q / (k * k)
            total += term
            if term < total * 1e-17:
                break
        return math.log(total)
    z = 1 / kappa
    return kappa - 0.5 * math.log(2 * math.pi * kappa) + math.log1p(z * (0.125 + z * (0.0703125 + z * 0.0732421875)))
