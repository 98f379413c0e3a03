"""Option values: the normal distribution and Black-Scholes-Merton as expressions; implied volatility and the binomial tree
as Arrow functions, vectorised over the rows of a batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import bound

# Coefficients of G. West's published double-precision approximation of the normal distribution (2005)
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_FAR = 7.07106781186547
TREE_CELLS = 1 << 20


def _poly(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Held at 38, where the tail is 0 either way. The argument is bound, as the polynomials name it two dozen times."""

    def low(a: Column) -> Column:
        e = F.exp(-a * a / 2)
        f = a + 0.65
        for n in (4, 3, 2, 1):  # the continued fraction of the far tail
            f = a + F.lit(float(n)) / f
        return F.when(a > 37, 0.0).when(a < _FAR, e * _poly(a, _TOP) / _poly(a, _BOTTOM)).otherwise(e / f / 2.506628274631)

    return bound(x, lambda x: F.abs((x > 0).cast("double") - bound(F.least(F.abs(x), F.lit(38.0)), low)))


def black_scholes(right: Column, spot: Column, strike: Column, rate: Column, dividend: Column, vol: Column, time: Column) -> Column:
    """Struct (price, delta, gamma, vega, theta, rho) of a European call or put; spot, strike, vol and time above 0, else null."""
    sign = F.when(right == "call", 1.0).when(right == "put", -1.0)
    d1 = (F.log(spot / strike) + (rate - dividend + vol * vol / 2) * time) / (vol * F.sqrt(time))
    good = (spot > 0) & (strike > 0) & (vol > 0) & (time > 0) & sign.isNotNull()

    def greeks(x: Column) -> Column:
        sign, root, fd, rd, n1, n2, density = (x[k] for k in ("sign", "root", "fd", "rd", "n1", "n2", "density"))
        return F.struct(
            (sign * (spot * fd * n1 - strike * rd * n2)).alias("price"),
            (sign * fd * n1).alias("delta"),
            (fd * density / (spot * vol * root)).alias("gamma"),
            (spot * fd * density * root).alias("vega"),
            (-spot * fd * density * vol / (2 * root) - sign * (rate * strike * rd * n2 - dividend * spot * fd * n1)).alias("theta"),
            (sign * strike * time * rd * n2).alias("rho"),
        )

    parts = lambda d: F.struct(
        sign.alias("sign"), F.sqrt(time).alias("root"), F.exp(-dividend * time).alias("fd"), F.exp(-rate * time).alias("rd"),
        norm_cdf(sign * d).alias("n1"), norm_cdf(sign * (d - vol * F.sqrt(time))).alias("n2"), norm_pdf(d).alias("density"),
    )
    return F.when(good, bound(d1, lambda d: bound(parts(d), greeks)))


def _cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    e = np.exp(-a * a / 2)
    f = a + 0.65
    for n in (4, 3, 2, 1):
        f = a + n / f
    low = np.where(a > 37, 0.0, np.where(a < _FAR, e * _poly(a, _TOP) / _poly(a, _BOTTOM), e / f / 2.506628274631))
    return np.where(x > 0, 1 - low, low)


@F.pandas_udf(DoubleType())
def implied_vol(right: pd.Series, price: pd.Series, spot: pd.Series, strike: pd.Series, rate: pd.Series, dividend: pd.Series, time: pd.Series) -> pd.Series:
    """By bisection within [1e-6, 20]; null for prices outside of the bounds without arbitrage, or beyond that bracket."""
    sign = np.where(right == "call", 1.0, np.where(right == "put", -1.0, np.nan))
    p, s, k, r, q, t = (x.to_numpy(dtype=float) for x in (price, spot, strike, rate, dividend, time))
    with np.errstate(all="ignore"):
        fs, dk = s * np.exp(-q * t), k * np.exp(-r * t)

        def value(v):
            d1 = (np.log(s / k) + (r - q + v * v / 2) * t) / (v * np.sqrt(t))
            return sign * (fs * _cdf(sign * d1) - dk * _cdf(sign * (d1 - v * np.sqrt(t))))

        low, high = np.full(len(p), 1e-6), np.full(len(p), 20.0)
        fits = (p >= value(low)) & (p <= value(high)) & (s > 0) & (k > 0) & (t > 0)
        for _ in range(200):
            mid = (low + high) / 2
            up = value(mid) < p
            low, high = np.where(up, mid, low), np.where(up, high, mid)
            if np.all((high - low <= 1e-14 * high) | ~fits):
                break
    return pd.Series(np.where(fits, (low + high) / 2, np.nan)).astype(object).where(fits, None)


def american(steps: int):
    """An Arrow function (right, spot, strike, rate, dividend, vol, time) -> value on a binomial tree of ``steps``; null where
    the tree's probability leaves [0, 1]."""
    from ..errors import whole

    whole(steps, "steps")

    @F.pandas_udf("double")
    def value(right: pd.Series, spot: pd.Series, strike: pd.Series, rate: pd.Series, dividend: pd.Series, vol: pd.Series, time: pd.Series) -> pd.Series:
        sign = np.where(right == "call", 1.0, np.where(right == "put", -1.0, np.nan))
        s, k, r, q, v, t = (x.to_numpy(dtype=float) for x in (spot, strike, rate, dividend, vol, time))
        out = np.full(len(s), np.nan)
        with np.errstate(all="ignore"):
            dt = t / steps
            up = np.exp(v * np.sqrt(dt))
            p, less = (np.exp((r - q) * dt) - 1 / up) / (up - 1 / up), np.exp(-r * dt)
        fits = np.nonzero((p >= 0) & (p <= 1) & (s > 0) & (k > 0) & (v > 0) & (t > 0) & ~np.isnan(sign))[0]
        # the trees of many rows at once, in matrices of bounded size
        for rows in np.array_split(fits, max(1, len(fits) * (steps + 1) // TREE_CELLS)):
            col = lambda x, rows=rows: x[rows, None]
            prices = col(s) * col(up) ** np.arange(-steps, steps + 1, 2, dtype=float)
            held = np.maximum(col(sign) * (prices - col(k)), 0)
            for _ in range(steps):
                prices = prices[:, 1:] / col(up)
                held = np.maximum(col(less) * (col(p) * held[:, 1:] + (1 - col(p)) * held[:, :-1]), col(sign) * (prices - col(k)))
            out[rows] = held[:, 0]
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return value
