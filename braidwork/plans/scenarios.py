"""Scenario runs of the simulator: unequal noise, shared caches, graph against sequential calibration."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..operators import overlap as O
from ..operators import panel as P
from . import simulation as S
from .config import Protocol

#: Noise ratios between the last and the first pull; shares and weights of a common cache.
LADDERS = (1.0, 5.0, 10.0, 20.0)
CACHES = {"homogeneous": (0.0, 0.0), "third_moderate": (0.33, 0.5), "third_strong": (0.33, 0.8), "half_strong": (0.5, 0.8)}


def run_scenarios(spark: SparkSession, protocol: Protocol, scenarios: dict[str, S.Settings], replications: int, first_seed: int = 1200) -> DataFrame:
    """Metrics of every estimator, replication and scenario."""
    out = None
    for name, settings in scenarios.items():
        rows, _ = S.monte_carlo(spark, protocol, replications, first_seed, settings)
        rows = rows.withColumn("scenario", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def variance_heterogeneity(spark: SparkSession, protocol: Protocol, replications: int, base: S.Settings = S.Settings()) -> DataFrame:
    """Estimators under ever more unequal pulls."""
    return run_scenarios(spark, protocol, {f"ladder_{x:g}": replace(base, noise_ladder=x) for x in LADDERS}, replications)


def dependence(spark: SparkSession, protocol: Protocol, replications: int, base: S.Settings = S.Settings()) -> DataFrame:
    """Estimators when a share of the pulls sees one cached disturbance."""
    return run_scenarios(spark, protocol, {k: replace(base, cache_fraction=f, cache_weight=w) for k, (f, w) in CACHES.items()}, replications)


def calibration_comparison(spark: SparkSession, protocol: Protocol, settings: S.Settings = S.Settings()) -> DataFrame:
    """Errors of every pull's series calibrated on the graph and stitched along neighbours."""
    batch, q = S.simulate(spark, protocol, settings), protocol.query
    chosen = protocol.calibration_settings()
    table = checkpointed(O.edges(batch.raw, chosen))
    graph = O.solve_scales(batch.raw, table, chosen).scales
    path = O.sequential_stitch(batch.raw, table).withColumn("log_scale_variance", F.lit(0.0))
    out = None
    for name, scales in (("graph", graph), ("sequential", path)):
        series = O.normalized(O.daily_series(O.calibrated_observations(batch.raw, scales, table, chosen), chosen), q.baseline_start, q.baseline_end, chosen)
        by_pull = checkpointed(series.select(F.col("pull_id").alias("series_id"), "historical_date", "value"))
        pulls = by_pull.select("series_id").distinct()
        truth = batch.truth.select("historical_date", "value").crossJoin(F.broadcast(pulls))  # a few pulls
        row = P.metrics_against(by_pull, truth).select(F.col("series_id").alias("pull_id"), F.lit(name).alias("estimator"), "rmse", "correlation")
        out = row if out is None else out.unionByName(row)
    return out
