"""Numeric expressions that never raise on a zero divisor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent; 0 where the earlier value is missing or not positive."""
    return F.when(before > 0, F.try_divide(now - before, before) * 100).otherwise(F.lit(0.0))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Standard score; 0 where the deviation is missing or zero."""
    return F.when(std > 0, F.try_divide(x - mean, std)).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(
        half_lon
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def _beta_tail(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by the modified Lentz continued fraction."""
    from math import lgamma

    log_gamma = np.vectorize(lgamma)

    def fraction(p, q, y):
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1.0 - (p + q) * y / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for step in (
                m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1.0 + step * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-15):
                break
        return h

    b = np.full_like(a, b)
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(y <= 0, 0.0, front * fraction(p, q, y))
    return np.where(swap, 1.0 - value, value)


def regression_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of a correlation ``r`` over ``n`` points (Student t, n - 2 degrees)."""
    df = np.maximum(n - 2.0, 1.0)
    r2 = np.clip(r * r, 0.0, 1.0)
    return _beta_tail(df / 2.0, 0.5, 1.0 - r2)


@F.pandas_udf(T.DoubleType())
def regression_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    values = regression_p_values(r.fillna(0.0).to_numpy(float), n.fillna(3).to_numpy(float))
    return pd.Series(values)
