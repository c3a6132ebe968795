"""The acceptance rules of a batch and its status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    unique_pulls: int = 12
    spectral_pulls: float = 4.0
    zero_share: float = 0.8
    level_g: float = 0.8
    innovation_g: float = 0.7
    kappa: float = 0.6
    component_share: float = 0.5
    convergence: float = 0.02
    benchmark: float = 1.5
    require_connected: bool = True
    require_integrity: bool = True


METRICS = ("protocol_passed", "all_connected", "n_unique_pulls", "spectral_effective_pulls", "zero_share", "level_g", "innovation_g", "kappa", "component_share", "convergence_mae_100")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def decision_rules(metrics: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per series and rule: ``rule, observed, threshold, passed, mandatory``.

    ``metrics`` has one row per series with the columns of ``METRICS`` and, where the series was
    benchmarked, ``benchmark_srmse``; a missing column is an error, a null value makes its rule
    indeterminate. Detection agreement is not mandatory where there is nothing to detect.
    """
    if absent := [c for c in METRICS if c not in metrics.columns]:
        raise KeyError(f"the metrics lack {absent}")
    t = thresholds
    number = lambda c: F.col(c).cast("double")
    at_least = lambda c, x: F.when(_finite(c), number(c) >= x)
    at_most = lambda c, x: F.when(_finite(c), number(c) <= x)
    varied = F.coalesce((F.col("zero_share") > 0) & (F.col("zero_share") < 1), F.lit(False))
    none = F.lit(None).cast("boolean")
    rules = [
        ("protocol_integrity", number("protocol_passed"), 1.0, F.col("protocol_passed") if t.require_integrity else none, F.lit(t.require_integrity)),
        ("overlap_graph_connectivity", number("all_connected"), 1.0, F.col("all_connected") if t.require_connected else none, F.lit(t.require_connected)),
        ("minimum_unique_pulls", number("n_unique_pulls"), float(t.unique_pulls), number("n_unique_pulls") >= t.unique_pulls, F.lit(True)),
        ("effective_pull_information", number("spectral_effective_pulls"), t.spectral_pulls, at_least("spectral_effective_pulls", t.spectral_pulls), F.lit(True)),
        ("zero_share", number("zero_share"), t.zero_share, at_most("zero_share", t.zero_share), F.lit(True)),
        ("level_generalizability", number("level_g"), t.level_g, at_least("level_g", t.level_g), F.lit(True)),
        ("innovation_generalizability", number("innovation_g"), t.innovation_g, at_least("innovation_g", t.innovation_g), F.lit(True)),
        ("detection_reliability", F.when(varied, number("kappa")), t.kappa, F.when(varied, at_least("kappa", t.kappa)), varied),
        ("near_duplicate_concentration", number("component_share"), t.component_share, number("component_share") <= t.component_share, F.lit(True)),
        ("consensus_convergence", number("convergence_mae_100"), t.convergence, at_most("convergence_mae_100", t.convergence), F.lit(True)),
    ]
    if "benchmark_srmse" in metrics.columns:
        rules.append(("frequency_consistency", number("benchmark_srmse"), t.benchmark, at_most("benchmark_srmse", t.benchmark), F.lit(True)))
    rows = [F.struct(F.lit(i).alias("rule_order"), F.lit(n).alias("rule"), o.alias("observed"), F.lit(x).alias("threshold"), p.alias("passed"), m.alias("mandatory")) for i, (n, o, x, p, m) in enumerate(rules, 1)]
    return metrics.select("series_id", F.explode(F.array(*rows)).alias("r")).select("series_id", "r.*")


def decision_status(rules: DataFrame) -> DataFrame:
    """FAIL if a mandatory rule failed, REVIEW if one is indeterminate, else PASS; and the counts."""
    must = F.col("mandatory")
    failed, unknown = F.count_if(must & F.coalesce(~F.col("passed"), F.lit(False))), F.count_if(must & F.col("passed").isNull())
    return rules.groupBy("series_id").agg(
        F.when(failed > 0, F.lit("FAIL")).when(unknown > 0, F.lit("REVIEW")).otherwise(F.lit("PASS")).alias("status"),
        F.count("*").alias("n_rules"),
        F.count_if(F.coalesce(F.col("passed"), F.lit(False))).alias("n_passed"),
        F.count_if(F.coalesce(~F.col("passed"), F.lit(False))).alias("n_failed"),
        F.count_if(F.col("passed").isNull()).alias("n_indeterminate"),
    )
