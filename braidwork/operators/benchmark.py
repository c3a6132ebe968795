"""Reconciling daily series with lower-frequency periods."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import benchmark_correction
from .panel import DATE, interpolated


@dataclass(frozen=True)
class BenchmarkSettings:
    mode: str = "soft"
    fidelity: float = 1.0
    smoothness: float = 10.0
    ridge: float = 1e-8
    default_se: float = 2.0
    nonnegative: bool = True


def aggregation_matrix(daily: DataFrame, periods: DataFrame) -> DataFrame:
    """Long rows ``series_id, period_id, historical_date, weight``: each period is the mean of its days.

    Periods are exploded into days and equi-joined, so no range join is planned. Periods without a value
    or without a day in the series have no rows. Periods are numbered by start, end and value.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("series_id").orderBy("period_start", "period_end", "value")
    known = periods.where("value is not null").withColumn("period_id", F.row_number().over(order))
    days = known.where("period_start <= period_end").select("series_id", "period_id", F.explode(F.sequence("period_start", "period_end")).alias("historical_date"))
    rows = days.join(daily.select(*DATE).distinct(), DATE)
    return rows.select("series_id", "period_id", "historical_date", (F.lit(1.0) / F.count("*").over(W.partitionBy("series_id", "period_id"))).alias("weight"))


_SERIES = "series_id string, historical_date date, preliminary_value double, value double, benchmark_correction double, clipped boolean"


def corrected_series(daily: DataFrame, periods: DataFrame, settings: BenchmarkSettings = BenchmarkSettings()) -> DataFrame:
    """The daily series of every group with the smooth correction towards its periods.

    Missing daily values are interpolated first; negative results are raised to 0 and marked, if asked.
    A series without periods is left as it is. One series is one group: its days and its periods.
    """
    z = interpolated(daily.select(*DATE, "value"))
    fixed = ["period_start", "period_end", "value"]
    p = periods.select("series_id", *fixed, (F.col("se") if "se" in periods.columns else F.lit(None).cast("double")).alias("se")).where("value is not null")

    def run(days: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("historical_date", ignore_index=True)
        at, value = pd.to_datetime(days["historical_date"]).to_numpy(), days["value"].to_numpy(float)
        rows = rows.sort_values(fixed, ignore_index=True)
        start, end = pd.to_datetime(rows["period_start"]).to_numpy(), pd.to_datetime(rows["period_end"]).to_numpy()
        a = ((at[None, :] >= start[:, None]) & (at[None, :] <= end[:, None])).astype(float)
        has = a.sum(axis=1) > 0
        a, b, se = a[has] / a[has].sum(axis=1, keepdims=True), rows["value"].to_numpy(float)[has], rows["se"].to_numpy(float)[has]
        x = value
        if len(b):
            variance = np.zeros(len(b)) if settings.mode == "exact" else np.where(np.isfinite(se) & (se > 0), se, settings.default_se) ** 2
            x = value + benchmark_correction(value, a, b, variance, settings.fidelity, settings.smoothness, settings.ridge)
        low = x < 0
        x = np.maximum(x, 0) if settings.nonnegative else x
        return pd.DataFrame({"series_id": days["series_id"], "historical_date": days["historical_date"], "preliminary_value": value, "value": x, "benchmark_correction": x - value, "clipped": low & settings.nonnegative})

    out = z.groupBy("series_id").cogroup(p.groupBy("series_id")).applyInPandas(run, _SERIES)
    if "standard_error" in daily.columns:
        se = daily.select(*DATE, "standard_error")
        out = out.join(se, DATE).withColumn("ci_lower_95", F.col("value") - 1.96 * F.col("standard_error")).withColumn("ci_upper_95", F.col("value") + 1.96 * F.col("standard_error"))
    return out


def benchmark_fit(series: DataFrame, periods: DataFrame, default_se: float = 2.0) -> DataFrame:
    """Every usable period with the mean of the series over it, its residual and standardised residual."""
    from pyspark.sql import Window as W

    matrix = aggregation_matrix(series, periods)
    fitted = matrix.join(series.select(*DATE, F.col("value").alias("x")), DATE).groupBy("series_id", "period_id").agg(F.sum(F.col("weight") * F.col("x")).alias("fitted_value"))
    order = W.partitionBy("series_id").orderBy("period_start", "period_end", "value")
    known = periods.where("value is not null").withColumn("period_id", F.row_number().over(order))
    se = F.coalesce(F.when(F.col("se") > 0, F.col("se")), F.lit(default_se)) if "se" in periods.columns else F.lit(default_se)
    rows = known.join(fitted, ["series_id", "period_id"]).withColumn("residual", F.col("fitted_value") - F.col("value"))
    return rows.select("series_id", "period_start", "period_end", "value", "fitted_value", "residual", (F.col("residual") / se).alias("standardized_residual"))


def benchmark_diagnostics(series: DataFrame, fit: DataFrame) -> DataFrame:
    """Errors of the fit and size of the corrections, per series."""
    errors = fit.groupBy("series_id").agg(F.count("*").alias("n_benchmark_constraints"), F.sqrt(F.avg(F.pow("residual", 2))).alias("benchmark_rmse"), F.sqrt(F.avg(F.pow("standardized_residual", 2))).alias("benchmark_standardized_rmse"))
    moves = series.groupBy("series_id").agg(
        F.count("*").alias("n_daily_observations"),
        F.avg(F.abs("benchmark_correction")).alias("mean_absolute_correction"),
        F.max(F.abs("benchmark_correction")).alias("max_absolute_correction"),
        F.count_if("clipped").alias("negative_values_before_clip"),
    )
    return moves.join(errors, "series_id", "left")
