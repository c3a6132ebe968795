"""From raw chunks to a benchmarked series and a decision, and the files of a result."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..operators import benchmark as B
from ..operators import consensus as C
from ..operators import decision as D
from ..operators import diagnostics as X
from ..operators import gstudy as G
from ..operators import overlap as O
from ..operators import panel as P
from ..operators import validation as V
from ..operators.windows import chunk_windows, collection_schedule
from ..sources.tables import write_table
from .config import Protocol


class AuditError(ValueError):
    """The raw table does not pass its audit."""


@dataclass(frozen=True)
class BatchResult:
    """Every stage's tables."""

    audit: V.Audit
    calibration: O.CalibrationResult
    panel: DataFrame
    duplicate_pairs: DataFrame
    duplicate_components: DataFrame
    design_weighted: DataFrame
    consensus: C.Consensus
    components: dict[str, DataFrame]
    reliability_pairs: DataFrame
    leave_one_out: DataFrame
    benchmarked: DataFrame | None
    benchmark_fit: DataFrame | None
    rules: DataFrame
    status: DataFrame

    @property
    def final_series(self) -> DataFrame:
        """The benchmarked series if there is one, else the consensus."""
        return self.benchmarked if self.benchmarked is not None else self.consensus.series

    def tables(self) -> dict[str, DataFrame]:
        out = {
            "audit/issues": self.audit.issues, "audit/summary": self.audit.summary, "calibration/series": self.calibration.series, "calibration/scales": self.calibration.graphs.scales,
            "calibration/edges": self.calibration.graphs.edges, "calibration/diagnostics": self.calibration.graphs.diagnostics, "duplicates/pairs": self.duplicate_pairs, "duplicates/components": self.duplicate_components,
            "consensus/design_weighted": self.design_weighted, "consensus/series": self.consensus.series, "consensus/weights": self.consensus.weights, "reliability/pairs": self.reliability_pairs,
            "reliability/leave_one_out": self.leave_one_out, "decision/rules": self.rules, "decision/status": self.status, "final_series": self.final_series,
        }
        out |= {f"gstudy/{k}": v for k, v in self.components.items()}
        if self.benchmarked is not None:
            out |= {"benchmark/series": self.benchmarked, "benchmark/fit": self.benchmark_fit}
        return out

    def save(self, folder: str, kind: str = "parquet") -> None:
        """Write every table below ``folder``."""
        for name, table in self.tables().items():
            write_table(table, f"{folder}/{name}.{kind}")


def fit(spark: SparkSession, raw: DataFrame, protocol: Protocol, benchmark: DataFrame | None = None, stop_on_errors: bool = True) -> BatchResult:
    """Run a batch: audit, calibration, duplicates, consensus, generalizability, benchmark, decision.

    Tables that several stages read, the panel, the pairs and what the decision needs, are checkpointed.
    """
    audit = V.audit_raw_batch(spark, raw, protocol)
    if stop_on_errors and (found := audit.issues.where("severity = 'error'").collect()):
        raise AuditError("; ".join(f"{r['code']} ({r['rows']})" for r in found))
    data, q = V.coerce_raw_chunks(raw), protocol.query
    calibration = O.calibrate(data, q.baseline_start, q.baseline_end, protocol.calibration_settings())
    design = checkpointed(data.groupBy("series_id", "pull_id").agg(F.min(F.struct("collection_day", "stream_id", "replicate_id")).alias("row")).select("series_id", "pull_id", "row.*"))
    panel = calibration.series.join(design, ["series_id", "pull_id"])
    panel = checkpointed(panel)
    values = panel.select(*P.KEY, "value", "calibration_se")
    d = protocol.duplicates
    pairs = P.duplicate_pairs(values, d.hash_decimals, d.exact_tolerance, d.min_pair_observations, d.raw_correlation_threshold, d.residual_correlation_threshold, d.exact_cell_agreement_threshold, d.mae_100_threshold, d.positive_jaccard_threshold, d.use_residual_rule)
    pairs = checkpointed(pairs)
    parts = checkpointed(X.duplicate_components(pairs, values))
    weighted = P.design_weighted(panel, start=q.baseline_start, end=q.baseline_end)
    settings = protocol.consensus_settings()
    consensus = C.gls_consensus(values, settings)
    g = protocol.gstudy
    studies = {k: checkpointed(G.variance_components(G.anova(G.transformed(panel, k)), g.clip_negative_components)) for k in g.transformations}
    reliability = P.reliability_pairs(values)
    without = checkpointed(C.leave_one_out(values, design, settings))
    sizes = design.groupBy("series_id").agg(*[F.count_distinct(c).alias(n) for n, c in (("n_days", "collection_day"), ("n_streams", "stream_id"), ("n_replicates", "replicate_id"))])
    grids = [sorted(g) for g in sizes.agg(*[F.collect_set(n) for n in ("n_days", "n_streams", "n_replicates")]).first()]  # as many as differ between series
    benchmarked = fitted = None
    if benchmark is not None and protocol.benchmark.enabled:
        b = protocol.benchmark_settings()
        benchmarked = checkpointed(B.corrected_series(consensus.series, benchmark, b))
        fitted = B.benchmark_fit(benchmarked.select(*P.DATE, "value"), benchmark, b.default_se)
    weights = consensus.weights.groupBy("series_id").agg(F.first("n_unique_pulls").alias("n_unique_pulls"), F.first("spectral_effective_pulls").alias("spectral_effective_pulls"))
    metrics = weights.join(calibration.graphs.diagnostics.groupBy("series_id").agg(F.bool_and("connected").alias("all_connected")), "series_id")
    metrics = metrics.join(data.groupBy("series_id").agg(F.avg(F.coalesce((F.col("value") == 0).cast("double"), F.lit(0.0))).alias("zero_share")), "series_id")
    for kind in ("level", "innovation"):
        if kind in studies:
            one = G.d_study(studies[kind], *grids).join(sizes, ["series_id", "n_days", "n_streams", "n_replicates"], "left_semi")
            one = one.select("series_id", F.col("generalizability_coefficient").alias(f"{kind}_g"))
            metrics = metrics.join(one, "series_id", "left")
        else:
            metrics = metrics.withColumn(f"{kind}_g", F.lit(None).cast("double"))
    metrics = metrics.join(P.fleiss_kappa(values).withColumnRenamed("fleiss_kappa", "kappa"), "series_id", "left")
    metrics = metrics.join(parts.groupBy("series_id").agg(F.max("share").alias("component_share")), "series_id")
    metrics = metrics.join(without.groupBy("series_id").agg(F.max("mae_100").alias("convergence_mae_100")), "series_id", "left")
    metrics = metrics.withColumn("protocol_passed", F.lit(bool(audit.summary.first()["passed"])))
    if fitted is not None:
        metrics = metrics.join(fitted.groupBy("series_id").agg(F.sqrt(F.avg(F.pow("standardized_residual", 2))).alias("benchmark_srmse")), "series_id", "left")
    rules = checkpointed(D.decision_rules(checkpointed(metrics), protocol.thresholds()))
    return BatchResult(audit, calibration, panel, pairs, parts, weighted, consensus, studies, reliability, without, benchmarked, fitted, rules, D.decision_status(rules))


def write_protocol_bundle(spark: SparkSession, protocol: Protocol, folder: str, anchor) -> dict:
    """The locked settings, windows and schedule of a study as files, and their manifest."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    q = protocol.query
    windows = chunk_windows(spark, q.historical_start, q.historical_end, protocol.chunking.window_days, protocol.chunking.step_days).toPandas()
    schedule = collection_schedule(spark, protocol, windows["chunk_id"].tolist(), anchor).toPandas()
    protocol.save(to / "protocol.lock.yaml")
    windows.to_csv(to / "chunks.csv", index=False)
    schedule.to_csv(to / "schedule.csv", index=False)
    manifest = {"protocol_hash": protocol.protocol_hash(), "n_chunks": len(windows), "n_pulls": len(schedule), "files": ["protocol.lock.yaml", "chunks.csv", "schedule.csv"]}
    (to / "manifest.json").write_text(json.dumps(manifest, indent=2), encoding="utf-8")
    return manifest


def markdown_table(rows: list[dict]) -> str:
    """A Markdown table of a few rows."""
    if not rows:
        return ""
    names = list(rows[0])
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)])


def report(result: BatchResult) -> str:
    """The decision, its rules, the graphs and the weights of a batch as Markdown."""
    part = lambda df, *c: markdown_table([r.asDict() for r in df.select(*c).collect()])  # noqa: E731 - a few rows each
    status = part(result.status, "series_id", "status", "n_passed", "n_failed", "n_indeterminate")
    rules = part(result.rules.orderBy("series_id", "rule_order"), "rule", "observed", "threshold", "passed", "mandatory")
    graphs = part(result.calibration.graphs.diagnostics.orderBy("series_id", "pull_id"), "pull_id", "connected", "n_nodes", "n_edges", "n_scale_groups", "max_log_scale_variance")
    weights = part(result.consensus.weights.orderBy("series_id", F.col("weight").desc(), "pull_id"), "pull_id", "weight", "kish_effective_pulls")
    return f"# Batch report\n\n## Decision\n\n{status}\n\n{rules}\n\n## Overlap graphs\n\n{graphs}\n\n## Consensus weights\n\n{weights}\n"
