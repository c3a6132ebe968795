"""Command line: design, audit, run, simulate, factor, export-stata."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import factors as FA
from .operators import validation as V
from .plans import pipeline, simulation
from .plans.config import Protocol
from .sources.tables import manifest_scan, read_table, write_table

AUDIT_FAILED, BATCH_FAILED, INDEFINITE = 2, 3, 4


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="braidwork", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, *args):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a, **({"required": True} if a in ("--config", "--out", "--raw", "--manifest") else {}))
        return p

    add("design", "--config", "--out", "--anchor")
    add("audit", "--config", "--raw")
    add("run", "--config", "--raw", "--out", "--benchmark")
    add("simulate", "--config", "--out", "--seed")
    add("factor", "--manifest", "--out", "--n-factors").add_argument("--allow-indefinite", action="store_true")
    p = sub.add_parser("export-stata")
    p.add_argument("source")
    p.add_argument("target")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; returns its exit code."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("braidwork").getOrCreate()
    if args.command == "export-stata":
        write_table(read_table(spark, args.source), args.target)
        return 0
    if args.command == "factor":
        rows = manifest_scan(spark, args.manifest).select("series_id", F.col("historical_date").cast("date"), "value", F.pow("standard_error", 2).alias("error_variance"))
        try:
            found = FA.error_corrected_factors(rows, int(args.n_factors) if args.n_factors else None, allow_indefinite=args.allow_indefinite)
        except FA.IndefiniteCovarianceError as exc:
            print(exc, file=sys.stderr)
            return INDEFINITE
        for name in ("loadings", "scores", "spectrum"):
            write_table(getattr(found, name), f"{args.out}/{name}.csv", single=True)
        return 0
    protocol = Protocol.load(args.config)
    if args.command == "design":
        print(pipeline.write_protocol_bundle(spark, protocol, args.out, args.anchor or protocol.query.historical_end))
        return 0
    if args.command == "audit":
        audit = V.audit_raw_batch(spark, read_table(spark, args.raw), protocol)
        audit.issues.show(truncate=False)
        return 0 if audit.summary.first()["passed"] else AUDIT_FAILED
    if args.command == "simulate":
        batch = simulation.simulate(spark, protocol, simulation.Settings(seed=int(args.seed or 1200)))
        for name in ("raw", "truth", "benchmark"):
            write_table(getattr(batch, name), f"{args.out}/{name}.parquet")
        return 0
    result = pipeline.fit(spark, read_table(spark, args.raw), protocol, read_table(spark, args.benchmark) if args.benchmark else None)
    result.save(args.out)
    statuses = [r["status"] for r in result.status.collect()]
    print(pipeline.report(result))
    return BATCH_FAILED if "FAIL" in statuses else 0


if __name__ == "__main__":
    sys.exit(main())
