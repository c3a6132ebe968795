"""Covariance-weighted consensus of pulls, for many series and subsets of pulls in one plan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.linalg import minimum_variance_weights, residual_covariance, spectral_count
from . import panel as P


@dataclass(frozen=True)
class ConsensusSettings:
    collapse_exact: bool = True
    center_bias: bool = False
    covariance: str = "ledoit_wolf"
    nonnegative: bool = True
    cap: float | None = 0.5
    local_uncertainty: bool = True
    baseline_rescale: bool = True
    baseline_start: str | None = None
    baseline_end: str | None = None


_WEIGHTS = (
    "series_id string, pull_id string, weight double, base_se double, condition_number double, spectral_effective_pulls double, kish_effective_pulls double, n_unique_pulls int, feasible boolean"
)


def _weights(settings: ConsensusSettings):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="historical_date", columns="pull_id", values="residual").sort_index()
        x, m = wide.to_numpy(float), wide.shape[1]
        sigma = residual_covariance(x, settings.covariance)
        try:
            w, ok = minimum_variance_weights(sigma, settings.nonnegative, settings.cap), True
        except ValueError:
            w, ok = np.full(m, np.nan), False
        spectral = spectral_count(x)
        return pd.DataFrame(
            {
                "series_id": rows["series_id"].iloc[0],
                "pull_id": wide.columns,
                "weight": w if ok else None,
                "base_se": float(np.sqrt(max(w @ sigma @ w, 0.0))) if ok else None,
                "condition_number": float(np.linalg.cond(sigma)),
                "spectral_effective_pulls": spectral if np.isfinite(spectral) else None,
                "kish_effective_pulls": float(1 / np.sum(w * w)) if ok and (w >= 0).all() else None,
                "n_unique_pulls": m,
                "feasible": ok,
            }
        )

    return run


def prepared(panel: DataFrame, settings: ConsensusSettings = ConsensusSettings()) -> DataFrame:
    """The dense panel of distinct pulls on a common baseline, with residuals about the daily median.

    A calibration error, where the panel has one, is scaled with its value.
    """
    rows = panel if "calibration_se" in panel.columns else panel.withColumn("calibration_se", F.lit(None).cast("double"))
    rows = rows.select(*P.KEY, "value", "calibration_se")
    if settings.collapse_exact:
        rows = P.collapse_exact(rows).select(*P.KEY, "value", "calibration_se")
    if settings.baseline_rescale:
        before = F.col("value")
        scaled = P.baseline_scaled(rows.withColumn("raw", before), settings.baseline_start, settings.baseline_end)
        rows = scaled.withColumn("calibration_se", F.col("calibration_se") * F.try_divide("value", "raw")).drop("raw")
    rows = P.densify(rows)
    if settings.center_bias:
        bias = F.avg("residual").over(W.partitionBy("series_id", "pull_id"))
        rows = P.median_residuals(rows).withColumn("value", F.col("value") - bias).drop("residual")
    return P.median_residuals(rows)


def pull_weights(panel: DataFrame, settings: ConsensusSettings = ConsensusSettings()) -> DataFrame:
    """Minimum-variance weights of every series' pulls with its diagnostics.

    Where the cap admits no weights the series' weights are null and ``feasible`` is false.
    """
    return prepared(panel, settings).groupBy("series_id").applyInPandas(_weights(settings), _WEIGHTS)


@dataclass(frozen=True)
class Consensus:
    series: DataFrame
    weights: DataFrame


def gls_consensus(panel: DataFrame, settings: ConsensusSettings = ConsensusSettings()) -> Consensus:
    """The consensus of every series with standard errors, intervals and propagated calibration errors."""
    rows = checkpointed(prepared(panel, settings))
    weights = checkpointed(rows.groupBy("series_id").applyInPandas(_weights(settings), _WEIGHTS))
    level = P.weighted_consensus(rows, weights)
    base = weights.groupBy("series_id").agg(F.first("base_se").alias("base_se"))
    if settings.local_uncertainty:
        out = P.local_uncertainty(rows, level, base)
    else:
        se = F.col("base_se")
        out = level.join(base, "series_id").select(*P.DATE, "value", F.lit(1.0).alias("multiplier"), se.alias("standard_error"), (F.col("value") - 1.96 * se).alias("ci_lower"), (F.col("value") + 1.96 * se).alias("ci_upper"))
    errors = P.propagated_calibration_se(rows, weights)
    out = out.join(errors, P.DATE, "left").join(level.select(*P.DATE, "n_available_pulls"), P.DATE)
    return Consensus(out.withColumn("calibration_se_exceeds", F.col("calibration_se") > F.col("standard_error")), weights)


def _subsets(panel: DataFrame, members: DataFrame) -> DataFrame:
    """The panel once per subset, keyed by ``series|subset`` so that one plan fits all subsets."""
    rows = panel.join(members, ["series_id", "pull_id"])
    return rows.withColumn("series_id", F.concat_ws("\u0001", "series_id", F.col("subset").cast("string"))).drop("subset")


def _split(frame: DataFrame) -> DataFrame:
    key = F.split("series_id", "\u0001")
    return frame.withColumn("subset", key[1].cast("int")).withColumn("series_id", key[0])


def _levels(panel: DataFrame, settings: ConsensusSettings) -> DataFrame:
    """The consensus values alone. The prepared panel feeds the weights and the means, so it is kept."""
    rows = checkpointed(prepared(panel, settings))
    weights = rows.groupBy("series_id").applyInPandas(_weights(settings), _WEIGHTS)
    return checkpointed(P.weighted_consensus(rows, weights))


def _changes(fits: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    gap = F.abs(F.col("value") - F.col("other"))
    return fits.join(other, on).groupBy("series_id", "subset").agg(F.avg(gap).alias("mae"), (F.avg(gap) / 100).alias("mae_100"), F.max(gap).alias("max_change"))


def _ranked(design: DataFrame) -> DataFrame:
    order = W.partitionBy("series_id").orderBy("collection_day", "stream_id", "replicate_id", "pull_id")
    return design.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(W.partitionBy("series_id")))


def leave_one_out(panel: DataFrame, design: DataFrame, settings: ConsensusSettings = ConsensusSettings()) -> DataFrame:
    """Change of the consensus without each pull in turn: one job for all refits, empty under three pulls."""
    ranked = _ranked(design).where("m >= 3")
    left_out = ranked.select("series_id", F.col("rank").alias("subset"), F.col("pull_id").alias("left_out"))
    members = ranked.select("series_id", "pull_id").join(left_out, "series_id").where("pull_id <> left_out").select("series_id", "pull_id", "subset")
    panel = checkpointed(panel)
    fits = _split(_levels(_subsets(panel, members), settings))
    full = _levels(panel, settings).select(*P.DATE, F.col("value").alias("other"))
    return _changes(fits, full, P.DATE).join(left_out, ["series_id", "subset"]).drop("subset")


def convergence(panel: DataFrame, design: DataFrame, settings: ConsensusSettings = ConsensusSettings(), least: int = 3) -> DataFrame:
    """Change of the consensus as pulls are added in design order, from ``least`` pulls on; one job."""
    ranked = _ranked(design)
    sizes = ranked.select("series_id", F.explode(F.sequence(F.lit(least), F.greatest("m", F.lit(least)))).alias("subset"), "m").where("subset <= m").distinct()
    members = ranked.select("series_id", "pull_id", "rank").join(sizes, "series_id").where("rank <= subset").select("series_id", "pull_id", "subset")
    fits = _split(_levels(_subsets(panel, members), settings)).select(*P.DATE, "subset", "value")
    before = fits.select(*P.DATE, (F.col("subset") + 1).alias("subset"), F.col("value").alias("other"))
    return _changes(fits, before, [*P.DATE, "subset"]).withColumnRenamed("subset", "n_pulls")
