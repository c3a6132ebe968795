"""Error-corrected principal factors of several consensus series."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import safe_corr
from ..functions.linalg import broken_stick_count, kaiser_count, principal

TINY = 1e-12
#: The bounds between which standard errors are held upstream.
CLIP_BOUNDS = (0.25, 4.0)


class IndefiniteCovarianceError(ValueError):
    """The measurement errors leave a covariance matrix that is none."""


@dataclass(frozen=True)
class Factors:
    loadings: DataFrame
    scores: DataFrame
    spectrum: DataFrame
    diagnostics: dict


def series_hash(series_ids) -> str:
    """A digest of the sorted requested series."""
    return hashlib.sha256("\n".join(sorted(map(str, series_ids))).encode()).hexdigest()


def joint_panel(values: DataFrame, max_zero_share: float | None = None, epsilon: float = TINY) -> DataFrame:
    """Rows of series that pass the zero screen, on dates on which all of them have value and error."""
    rows = values.select("series_id", "historical_date", "value", "error_variance")
    if max_zero_share is not None:
        share = rows.groupBy("series_id").agg(F.avg((F.abs("value") <= epsilon).cast("double")).alias("share"))
        rows = rows.join(share.where(F.col("share") <= max_zero_share), "series_id", "left_semi")
    k = rows.select("series_id").distinct().agg(F.count("*").alias("k"))
    whole = rows.where("value is not null and error_variance is not null")
    n = F.count("*").over(W.partitionBy("historical_date"))
    return whole.withColumn("n", n).crossJoin(F.broadcast(k)).where("n = k").drop("n", "k")


def standardized(panel: DataFrame) -> DataFrame:
    """Values by their standard deviation and error variances by its square."""
    sd = F.stddev_samp("value").over(W.partitionBy("series_id"))
    sd = F.when(sd > TINY, sd).otherwise(F.raise_error(F.lit("a series does not vary")).cast("double"))
    return panel.withColumn("sd", sd).select("series_id", "historical_date", (F.col("value") / F.col("sd")).alias("value"), (F.col("error_variance") / F.pow("sd", 2)).alias("error_variance"))


def corrected_covariance(panel: DataFrame) -> DataFrame:
    """Sample covariances of all pairs of series, the mean error variance, and their difference."""
    a = panel.toDF("series_a", "historical_date", "xa", "ea")
    b = panel.toDF("series_b", "historical_date", "xb", "eb")
    same = F.col("series_a") == F.col("series_b")
    pairs = a.join(b, "historical_date").groupBy("series_a", "series_b").agg(F.covar_samp("xa", "xb").alias("covariance"), F.avg("ea").alias("error"), F.count("*").alias("n"))
    return pairs.withColumn("mean_error_variance", F.when(same, F.col("error")).otherwise(F.lit(0.0))).drop("error").withColumn("corrected", F.col("covariance") - F.col("mean_error_variance"))


def error_corrected_factors(values: DataFrame, n_factors: int | None = None, standardize: bool = True, max_zero_share: float | None = None, allow_indefinite: bool = False, tolerance: float = 1e-8) -> Factors:
    """Principal factors of the covariance less the mean measurement error, with score errors.

    The covariances are one aggregate; only the K x K matrix reaches the driver, for K series.
    """
    panel = joint_panel(values, max_zero_share)
    panel = standardized(panel) if standardize else panel
    rows = corrected_covariance(panel).collect()  # K x K numbers
    ids = sorted({r["series_a"] for r in rows})
    at, k = {s: i for i, s in enumerate(ids)}, len(ids)
    if not k or rows[0]["n"] < k + 2:
        raise ValueError("too few dates on which all series have a value")
    raw, corrected = np.zeros((k, k)), np.zeros((k, k))
    for r in rows:
        i, j = at[r["series_a"]], at[r["series_b"]]
        raw[i, j], corrected[i, j] = r["covariance"], r["corrected"]
    spectrum, vectors = principal(corrected)
    raw_spectrum, raw_vectors = principal(raw)
    trace = float(np.trace(corrected))
    m = kaiser_count(spectrum, trace) if n_factors is None else n_factors
    if not 1 <= m <= k:
        raise ValueError(f"the number of factors must be between 1 and {k}")
    psd = bool(spectrum[-1] >= -tolerance * max(1.0, abs(spectrum[0])))
    if not psd and not allow_indefinite:
        raise IndefiniteCovarianceError(f"the corrected covariance has the eigenvalue {spectrum[-1]:.3g}")
    lead = np.maximum(spectrum[:m], TINY)
    loadings, raw_first = vectors[:, :m] * np.sqrt(np.maximum(spectrum[:m], 0)), raw_vectors[:, 0] * np.sqrt(max(raw_spectrum[0], 0))
    positive = np.maximum(spectrum, 0)
    attenuation = []
    for i in range(k):
        scaled = loadings[i, 0] / np.sqrt(corrected[i, i]) if corrected[i, i] > TINY else 0.0
        attenuation.append(float(raw_first[i] / np.sqrt(raw[i, i]) / scaled) if raw[i, i] > TINY and abs(scaled) > TINY else None)
    spark = values.sparkSession
    table = spark.createDataFrame([(s, f"F{f + 1}", float(loadings[i, f]), float(vectors[i, f]), float(lead[f]), attenuation[i]) for i, s in enumerate(ids) for f in range(m)], "series_id string, factor string, loading double, vector double, eigenvalue double, attenuation_ratio double")
    centred = panel.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy("series_id")))
    joined = centred.join(F.broadcast(table), "series_id")
    scores = joined.groupBy("historical_date", "factor").agg(
        (F.sum(F.col("value") * F.col("vector")) / F.sqrt(F.first("eigenvalue"))).alias("score"),
        F.sqrt(F.sum(F.col("error_variance") * F.pow("vector", 2)) / F.first("eigenvalue")).alias("score_se"),
    )
    shares = [float(v / positive.sum()) if positive.sum() > TINY else None for v in positive]
    lines = spark.createDataFrame([(i + 1, float(v), shares[i], float(raw_spectrum[i])) for i, v in enumerate(spectrum)], "rank int, eigenvalue double, explained_share double, uncorrected_eigenvalue double")
    gap = float(spectrum[m - 1] / spectrum[m]) if m < k and spectrum[m] > TINY else float("inf")
    diagnostics = {
        "series_hash": series_hash(ids),
        "n_series": k,
        "n_dates": int(rows[0]["n"]),
        "n_factors": m,
        "n_factors_broken_stick": broken_stick_count(spectrum, trace),
        "n_factors_uncorrected": kaiser_count(raw_spectrum, float(np.trace(raw))),
        "eigenvalue_gap_ratio": gap,
        "positive_semidefinite": psd,
        "min_eigenvalue": float(spectrum[-1]),
        "measurement_error_share": float((np.trace(raw) - trace) / np.trace(raw)) if np.trace(raw) > TINY else None,
    }
    return Factors(table, scores, lines, diagnostics)


def weekday_f(series: DataFrame) -> DataFrame:
    """The F statistic of weekday means, a one-way analysis of variance, per series.

    Null under 15 dates or without residual degrees of freedom or variance within weekdays.
    """
    rows = series.where("value is not null").withColumn("weekday", F.weekday("historical_date"))
    day, whole = W.partitionBy("series_id", "weekday"), W.partitionBy("series_id")
    rows = rows.withColumn("d", F.col("value") - F.avg("value").over(day)).withColumn("e", F.col("value") - F.avg("value").over(whole))
    found = rows.groupBy("series_id").agg(F.sum(F.pow("d", 2)).alias("within"), F.sum(F.pow("e", 2)).alias("total"), F.count_distinct("weekday").alias("groups"), F.count("*").alias("n"))
    f = F.try_divide((F.col("total") - F.col("within")) / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups")))
    return found.select("series_id", F.when((F.col("n") >= 15) & (F.col("n") > F.col("groups")) & (F.col("groups") > 1) & (F.col("within") > TINY), f).alias("weekday_f"), "n")


def lag_autocorrelation(series: DataFrame, lag: int = 7) -> DataFrame:
    """Correlation of a series with itself ``lag`` rows later; null with too few rows or no spread."""
    order = W.partitionBy("series_id").orderBy("historical_date")
    rows = series.withColumn("before", F.lag("value", lag).over(order))
    enough = F.count("*") > lag + 2
    return rows.groupBy("series_id").agg(F.when(enough, safe_corr("before", "value", TINY)).alias("autocorrelation"), F.count("*").alias("n"))


def clip_share(errors: DataFrame) -> DataFrame:
    """Share of standard errors whose ratio to their series' median is a bound of the clipping upstream."""
    middle = F.median("standard_error").over(W.partitionBy("series_id"))
    r = F.try_divide(F.col("standard_error"), F.col("middle"))
    near = F.lit(False)
    for bound in CLIP_BOUNDS:
        near = near | (F.abs(r - bound) <= 1e-9 + 1e-6 * bound)
    rows = errors.withColumn("middle", middle).where("standard_error is not null")
    return rows.groupBy("series_id").agg(F.avg(near.cast("double")).alias("clip_share"))
