"""Huber location and its variance, as NumPy and as an Arrow-batched column function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

TINY = 1e-12


def _scale(values: np.ndarray, about: float) -> float:
    return 1.4826 * float(np.median(np.abs(values - about)))


def huber_location(values: np.ndarray, c: float = 1.345, rounds: int = 100, tol: float = 1e-8) -> tuple[float, float, float]:
    """M-location by reweighting at a fixed robust scale: location, scale, variance of the location.

    The scale is the normal-consistent median absolute deviation, or the standard deviation where that
    vanishes. Without any spread the median is returned with scale 0 and variance 1e-12; of one value
    the variance is infinite. The final scale is that of the residuals about the location.
    """
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return float("nan"), float("nan"), float("inf")
    if len(x) == 1:
        return float(x[0]), 0.0, float("inf")
    at = float(np.median(x))
    spread = _scale(x, at)
    if spread <= TINY:
        spread = float(np.std(x, ddof=1))
    if spread <= TINY:
        return at, 0.0, TINY

    def weights(about: float, scale: float) -> np.ndarray:
        return np.minimum(1.0, c / np.maximum(np.abs(x - about) / scale, TINY))

    for _ in range(rounds):
        w = weights(at, spread)
        new = float(np.sum(w * x) / np.sum(w))
        done = abs(new - at) <= tol * max(1.0, abs(at))
        at = new
        if done:
            break
    spread = max(_scale(x, at), TINY)
    w = weights(at, spread)
    effective = float(np.sum(w) ** 2 / np.sum(w * w))
    return at, spread, spread**2 / max(effective, 1.0)


def huber(c: float = 1.345, rounds: int = 100, tol: float = 1e-8):
    """A column function from an array of values to ``struct<location, scale, variance>``; nulls are left out."""

    @F.pandas_udf("location double, scale double, variance double")
    def estimate(values: pd.Series) -> pd.DataFrame:
        found = [huber_location(np.asarray(v, float) if v is not None else np.zeros(0), c, rounds, tol) for v in values]
        frame = pd.DataFrame(found, columns=["location", "scale", "variance"])
        return frame.where(np.isfinite(frame) | (frame == np.inf), None).astype(float)

    return estimate
