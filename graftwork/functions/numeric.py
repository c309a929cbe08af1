"""Numbers: tolerant casts, bands, beliefs and their tails; built-in expressions but for Beta tails and exact rounding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(c: Column) -> Column:
    """A finite number or null; text that is no number is null."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def to_flag(c: Column) -> Column:
    """True for 1, 1.0 and their texts; false for all else, null too."""
    return F.coalesce(to_float(c) == 1.0, F.lit(False))


def banded(c: Column, cuts: list[float], labels: list[str], missing: str) -> Column:
    """The label of the first cut above the value, the last label beyond all; ``missing`` for null and NaN."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one label more than cuts")
    out = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(missing))
    for cut, name in zip(cuts, labels):
        out = out.when(c < cut, F.lit(name))
    return out.otherwise(F.lit(labels[-1]))


def relative_to(c: Column, base: Column) -> Column:
    """(c - base) / base; null unless base > 0."""
    return F.when(base > 0, (c - base) / base)


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def belief_mean(alpha: Column, beta: Column) -> Column:
    """alpha / (alpha + beta); 0.5 if the sum is not above zero."""
    return F.when(alpha + beta > 0, alpha / (alpha + beta)).otherwise(F.lit(0.5))


#: Fixed value: sums of Beta parameters beyond it take the normal approximation.
EXACT = 2000


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function above 0, by Stirling's series from 10 on."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift = shift + np.where(low, np.log(np.where(low, y, 1.0)), 0.0)
        y = np.where(low, y + 1, y)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _beta_below(a: np.ndarray, b: np.ndarray, x: float, steps: int = 200) -> np.ndarray:
    """The regularized incomplete Beta function by its continued fraction; ``steps`` are enough up to ``EXACT``."""
    swap = x > (a + 1) / (a + b + 2)  # where the fraction of the other side converges faster
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(t), 1 / away(1 - (p + q) * t / (p + 1))
    h = d.copy()
    for m in range(1, steps):
        for n in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / away(1 + n * d), away(1 + n / c)
            h = h * d * c
    front = _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(t) + q * np.log(1 - t)
    part = np.exp(front) * h / p
    return np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)


def beta_above(alpha: Column, beta: Column, threshold: float = 0.5) -> Column:
    """P(theta > threshold) for Beta parameters above 0, in a fixed number of steps whatever their size; beyond ``EXACT``
    by the normal approximation. Null for null parameters."""
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.float64, na_value=np.nan), b.to_numpy(np.float64, na_value=np.nan)
        return pd.Series(1 - _beta_below(x, y, threshold))

    exact = run(alpha.cast("double"), beta.cast("double"))
    return F.when(alpha + beta <= EXACT, exact).when(alpha + beta > EXACT, beta_above_normal(alpha, beta, threshold))


def wilson_low(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower Wilson bound of a proportion; 0 without trials."""
    p = successes / trials
    centre = p + z * z / (2 * trials)
    spread = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return F.when(trials > 0, (centre - spread) / (1 + z * z / trials)).otherwise(F.lit(0.0))


def rounded(c: Column, places: int) -> Column:
    """Half-even rounding of the exact binary value, as Python rounds; the built-in functions round its decimal text."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if pd.isna(v) else round(v, places))

    return run(c.cast("double"))


def beta_above_normal(alpha: Column, beta: Column, threshold: float = 0.5) -> Column:
    """P(theta > threshold) by the normal approximation, for counts that are not whole or very large."""

    @F.pandas_udf("double")
    def run(mean: pd.Series, deviation: pd.Series) -> pd.Series:
        z = (threshold - mean) / deviation
        return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))

    n = alpha + beta
    return run((alpha / n).cast("double"), F.sqrt(alpha * beta / (n * n * (n + 1))).cast("double"))
