"""Regression on a noisy predictor: reliability-corrected least squares, HAC errors, SIMEX."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import ratio
from ..functions.lineage import checkpointed
from ..functions.linalg import normal_p


class IdentificationError(ValueError):
    """The measurement error leaves no variance of the predictor."""


def _usable(df: DataFrame, controls: tuple[str, ...]) -> DataFrame:
    names = ["y", "x", "sigma2", *controls]
    rows = df.dropna(subset=names)
    for c in names:
        rows = rows.where(~F.isnan(F.col(c).cast("double")))
    return rows


def _dot(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for p, q in zip(a, b):
        total = total + p * q
    return total


def reliability_corrected_by_series(df: DataFrame, controls: tuple[str, ...] = (), hac_lags: int = 7) -> DataFrame:
    """Attenuation-corrected slope of ``y`` on ``x`` with error variances ``sigma2``, ordered by ``t``, per series.

    Exact controls and an intercept are partialled out through their cross products, of which a series has
    as many as controls squared; residuals and leverages are column expressions. Standard errors are
    Newey-West over the corrected moment. One row per series: coefficient, standard_error, t_value, p_value,
    reliability_ratio, denominators, n_observations, identified, and the controls' coefficients. A series with
    too few rows, or whose error variance exceeds the predictor's variance, has null estimates.
    """
    rows = _usable(df, controls)
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in controls]]
    k = len(z)
    sums = [F.coalesce(F.sum(a * b), F.lit(0.0)) for a in z for b in [*z, F.col("x"), F.col("y")]]

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in parts.iterrows():
            table = np.array(row["sums"]).reshape(k, k + 2)
            inverse = np.linalg.pinv(table[:, :k])
            out.append((row["series_id"], row["n"], inverse.ravel(), inverse @ table[:, k], inverse @ table[:, k + 1]))
        return pd.DataFrame(out, columns=["series_id", "n", "inverse", "bx", "by"])

    products = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    fits = products.groupBy("series_id").applyInPandas(solve, "series_id string, n long, inverse array<double>, bx array<double>, by array<double>")
    part = lambda name, b: F.col(name) - _dot([F.col(b)[i] for i in range(k)], z)
    leverage = _dot([_dot([F.col("inverse")[i * k + j] for j in range(k)], z) for i in range(k)], z)
    rows = rows.join(fits, "series_id").withColumn("xr", part("x", "bx")).withColumn("yr", part("y", "by")).withColumn("m", 1 - leverage)
    whole = W.partitionBy("series_id")
    xx, xy, error = [F.sum(c).over(whole) for c in (F.col("xr") * F.col("xr"), F.col("xr") * F.col("yr"), F.col("m") * F.col("sigma2"))]
    rows = rows.withColumn("xx", xx).withColumn("left", xx - error).withColumn("identified", (F.col("n") > k + 2) & (F.col("left") > 0))
    rows = rows.withColumn("beta", F.when(F.col("identified"), xy / F.col("left")))
    moment = F.col("xr") * (F.col("yr") - F.col("beta") * F.col("xr")) + F.col("beta") * F.col("m") * F.col("sigma2")
    rows = checkpointed(rows.withColumn("g", moment).select("series_id", "t", "g", "n", "bx", "by", "xx", "left", "beta", "identified"))
    per = rows.groupBy("series_id").agg(*[F.first(c).alias(c) for c in ("n", "bx", "by", "xx", "left", "beta", "identified")])
    per = per.join(newey_west(rows.select("series_id", "t", "g"), hac_lags).select("series_id", "long_run_variance"), "series_id")
    se = F.sqrt(F.col("long_run_variance") / F.col("n")) / F.abs(F.col("left") / F.col("n"))
    per = per.withColumn("se", F.when(F.col("identified"), se)).withColumn("t_value", F.when(F.col("se") > 0, F.col("beta") / F.col("se")))

    @F.pandas_udf("double")
    def two_sided(t: pd.Series) -> pd.Series:
        return pd.Series([normal_p(v) if pd.notna(v) else None for v in t], dtype=float)

    names = ["intercept", *controls]
    return per.select(
        "series_id",
        F.col("beta").alias("coefficient"),
        F.col("se").alias("standard_error"),
        "t_value",
        F.when(F.col("t_value").isNotNull(), two_sided("t_value")).alias("p_value"),
        F.when(F.col("identified"), F.col("left") / F.col("xx")).alias("reliability_ratio"),
        F.col("xx").alias("denominator_uncorrected"),
        F.col("left").alias("denominator_corrected"),
        F.col("n").alias("n_observations"),
        "identified",
        *[(F.col("by")[i] - F.col("beta") * F.col("bx")[i]).alias(f"control_{c}") for i, c in enumerate(names)],
    )


def reliability_corrected_ols(df: DataFrame, controls: tuple[str, ...] = (), hac_lags: int = 7) -> DataFrame:
    """The regression of ``reliability_corrected_by_series`` on one series, which must be identified: one row."""
    found = reliability_corrected_by_series(df.withColumn("series_id", F.lit("all")), controls, hac_lags)
    row = found.first()
    if row is None or row["n_observations"] <= len(controls) + 3:
        raise ValueError("too few observations")
    if not row["identified"]:
        raise IdentificationError("the error variance exceeds the predictor's variance")
    names = [f for f in found.schema if f.name not in ("series_id", "identified")]
    return df.sparkSession.createDataFrame([tuple(row[f.name] for f in names)], StructType(names))


def newey_west(rows: DataFrame, lags: int) -> DataFrame:
    """Bartlett-weighted long-run variance of ``g``, ordered by ``t``, per series; at least 0.

    One ordered window per series; the lags are columns.
    """
    whole = W.partitionBy("series_id")
    g = F.col("g") - F.avg("g").over(whole)
    rows = rows.select("series_id", "t", g.alias("d"))
    order = whole.orderBy("t")
    lagged = [(F.col("d") * F.lag("d", j).over(order)).alias(f"p{j}") for j in range(1, lags + 1)]
    rows = rows.select("series_id", (F.col("d") * F.col("d")).alias("p0"), *lagged)
    n = F.count("*")
    total = F.sum("p0") / n
    for j in range(1, lags + 1):
        total = total + 2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"p{j}"), F.lit(0.0)) / n
    return rows.groupBy("series_id").agg(F.greatest(total, F.lit(0.0)).alias("long_run_variance"), n.alias("n"))


def simex(df: DataFrame, lambdas: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0), simulations: int = 200, seed: int = 20260727) -> DataFrame:
    """Mean slopes of ``y`` on ``x`` with added noise of each level, all simulations in one job.

    Where ``df`` has a ``series_id`` every series has a curve of its own. Noise is a Box-Muller normal of the
    MD5 digest of seed, level, simulation and ``t``, the same on every run and partitioning. Level 0 is the
    plain slope and is computed once.
    """
    draws = [(float(a), k, s) for k, a in enumerate(lambdas) for s in range(1 if a == 0 else simulations)]
    grid = df.sparkSession.createDataFrame(draws, "lam double, level int, simulation int")
    key = [c for c in ("series_id",) if c in df.columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("level", "simulation", "t")]))
    unit = lambda at: (F.conv(F.substring("digest", at, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)  # noqa: E731 - 13 hex digits
    noise = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * np.pi * unit(14))
    rows = df.select(*key, "t", "y", "x", "sigma2").crossJoin(F.broadcast(grid)).withColumn("digest", digest).withColumn("x", F.col("x") + F.sqrt(F.col("lam") * F.col("sigma2")) * noise)
    slopes = rows.groupBy(*key, "lam", "simulation").agg(ratio(F.covar_samp("x", "y"), F.var_samp("x")).alias("slope"))
    return slopes.groupBy(*key, "lam").agg(F.avg("slope").alias("mean_coefficient"), F.count("*").alias("simulations"))


def simex_estimate(curve: DataFrame) -> float:
    """The quadratic through the mean slopes, at -1."""
    rows = sorted((r["lam"], r["mean_coefficient"]) for r in curve.collect())  # one row per noise level
    return float(np.polyval(np.polyfit(*zip(*rows), deg=2), -1.0))
