"""The batch pipeline end to end on simulated data, its files, the command line, sources and streaming."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from braidwork import cli
from braidwork.operators import overlap as O
from braidwork.operators import panel as P
from braidwork.operators.windows import chunk_windows, collection_schedule
from braidwork.plans import pipeline, simulation
from braidwork.plans.config import Protocol
from braidwork.sources import exports
from braidwork.sources.tables import manifest_scan, monthly_keys, read_table, write_table
from braidwork.streaming import ingest
from pyspark.sql import functions as F


def protocol(**more):
    body = {
        "query": {"series_id": "S", "keyword": "k", "geo": "US", "historical_start": "2024-01-01", "historical_end": "2024-08-31"},
        "design": {"day_offsets": [0, 1, 7], "streams": ["A", "B"]},
        "chunking": {"window_days": 90, "step_days": 30, "min_overlap_days": 10},
        "consensus": {"weight_cap": 0.8},
        "decision": {"min_unique_pulls": 3, "min_spectral_effective_pulls": 1.0, "min_level_generalizability": 0.1, "min_innovation_generalizability": 0.0, "max_convergence_mae_100": 0.5, "max_benchmark_standardized_rmse": 9.0},
    }
    return Protocol.model_validate(body | more)


@pytest.fixture(scope="module")
def batch(spark):
    return simulation.simulate(spark, protocol(), simulation.Settings(seed=5))


def test_protocol_round_trip_hash_and_limits(tmp_path):
    p = protocol()
    p.save(tmp_path / "p.yaml")
    assert Protocol.load(tmp_path / "p.yaml").protocol_hash() == p.protocol_hash()
    text = (tmp_path / "p.yaml").read_text().replace("window_days: 90", "window_days: 95")
    (tmp_path / "q.yaml").write_text(text)
    with pytest.raises(ValueError, match="hash"):
        Protocol.load(tmp_path / "q.yaml")
    for bad in ({"chunking": {"window_days": 20}}, {"design": {"streams": ["A"]}}, {"consensus": {"weight_cap": 0}}, {"calibration": {"reference_strategy": "explicit"}}, {"other": 1}):
        with pytest.raises(ValueError):
            protocol(**bad)


def test_schedule_is_balanced_and_unique(spark):
    rows = collection_schedule(spark, protocol(), ["C0001", "C0002", "C0003"], "2024-09-01").toPandas()
    assert len(rows) == 6 and rows["pull_id"].is_unique
    assert (rows.groupby(["collection_day", "stream_id"]).size() == 1).all()
    assert rows.groupby("stream_id")["stream_order"].nunique().min() == 2
    assert rows["chunk_order_json"].nunique() > 1


def test_schedule_late_in_the_day_goes_on_after_midnight(spark):
    late = protocol(design={"day_offsets": [0, 1], "streams": ["A", "B"], "technical_replicates": 3, "time_slots": ["23:58"]})
    rows = collection_schedule(spark, late, ["C0001"], "2024-09-30").toPandas()
    assert len(rows) == 12 and set(rows["replicate_id"]) == {"1", "2", "3"}
    begins = pd.to_datetime(rows["planned_start_time"])
    behind = (begins - pd.to_datetime(rows["planned_collection_date"] + " 23:58")).dt.total_seconds()
    assert behind.between(0, 240).all() and behind.max() > 120


def test_end_to_end_recovers_the_truth(spark, batch, tmp_path):
    result = pipeline.fit(spark, batch.raw, protocol(), batch.benchmark)
    final = result.final_series.select("historical_date", "value").join(batch.truth.select("historical_date", F.col("value").alias("truth")), "historical_date").toPandas()
    assert len(final) == 244 and np.corrcoef(final["value"], final["truth"])[0, 1] > 0.85
    rules = {r["rule"]: r["passed"] for r in result.rules.collect()}
    assert rules["protocol_integrity"] and rules["overlap_graph_connectivity"] and len(rules) == 11
    assert result.status.first()["status"] in ("PASS", "FAIL", "REVIEW")
    text = pipeline.report(result)
    assert "overlap_graph_connectivity" in text and "P001" in text
    write_table(result.final_series, f"{tmp_path}/final.parquet")
    assert read_table(spark, f"{tmp_path}/final.parquet").count() == 244


def test_errors_stop_the_batch(spark, batch):
    with pytest.raises(pipeline.AuditError, match="missing_chunks"):
        pipeline.fit(spark, batch.raw.where("not (pull_id = 'P002' and chunk_id = 'C0002')"), protocol())


def test_simulator_is_reproducible_and_makes_copies(spark):
    a, b = (simulation.simulate(spark, protocol(), simulation.Settings(seed=9, exact_duplicates=0.9)) for _ in range(2))
    key = [*O.PULL, "chunk_id", "historical_date", "value"]
    assert a.raw.select(key).exceptAll(b.raw.select(key)).count() == 0
    panel = O.calibrate(a.raw, settings=protocol().calibration_settings()).series.select(*P.KEY, "value")
    assert P.exact_groups(panel).where("multiplicity > 1").count() > 0


def test_estimators_are_compared(spark):
    rows, summary = simulation.monte_carlo(spark, protocol(), 2, settings=simulation.Settings(noise_ladder=5.0))
    found = {r["estimator"]: r["mean"] for r in summary.collect()}
    assert len(found) == 8 and found["simple_mean"] < found["single_pull"] * 1.5 and rows.count() == 16


def test_protocol_bundle_and_command_line(spark, batch, tmp_path, capsys):
    p = protocol()
    manifest = pipeline.write_protocol_bundle(spark, p, str(tmp_path / "bundle"), "2024-09-01")
    assert manifest["n_pulls"] == 6 and (tmp_path / "bundle" / "schedule.csv").exists()
    config = str(tmp_path / "bundle" / "protocol.lock.yaml")
    write_table(batch.raw, f"{tmp_path}/raw.parquet")
    assert cli.main(["audit", "--config", config, "--raw", f"{tmp_path}/raw.parquet"], spark) == 0
    write_table(batch.raw.where("chunk_id <> 'C0003'"), f"{tmp_path}/bad.parquet")
    assert cli.main(["audit", "--config", config, "--raw", f"{tmp_path}/bad.parquet"], spark) == cli.AUDIT_FAILED
    assert cli.main(["simulate", "--config", config, "--out", f"{tmp_path}/sim"], spark) == 0
    write_table(batch.truth, f"{tmp_path}/truth.parquet")
    assert cli.main(["export-stata", f"{tmp_path}/truth.parquet", f"{tmp_path}/truth.dta"], spark) == 0
    assert len(pd.read_stata(f"{tmp_path}/truth.dta")) == 244


def test_factor_command_and_manifest(spark, tmp_path):
    rng = np.random.default_rng(0)
    f = rng.normal(size=120)
    for k in range(3):
        rows = [(dt.date(2024, 1, 1) + dt.timedelta(t), float(f[t] + 0.3 * rng.normal()), 0.1) for t in range(120)]
        write_table(spark.createDataFrame(rows, "historical_date date, value double, standard_error double"), f"{tmp_path}/s{k}.parquet")
    (tmp_path / "manifest.csv").write_text("series_id,path\n" + "".join(f"s{k},s{k}.parquet\n" for k in range(3)))
    assert manifest_scan(spark, f"{tmp_path}/manifest.csv").select("series_id").distinct().count() == 3
    assert cli.main(["factor", "--manifest", f"{tmp_path}/manifest.csv", "--out", f"{tmp_path}/out"], spark) == 0
    assert read_table(spark, f"{tmp_path}/out/loadings.csv").count() == 3
    with pytest.raises(ValueError):
        read_table(spark, "a.json")


def test_exports_are_parsed_and_checked(spark, tmp_path):
    head = "Category: All\n\nDay,k: (US)\n"
    (tmp_path / "trend_C0001_2024-01-01_2024-01-03.csv").write_text(head + "2024-01-01,50\n2024-01-02,<1\n2024-01-03,100\n")
    (tmp_path / "trend_C0002_2024-01-03_2024-01-05.csv").write_text("Category: All\n\nDay,k,l\n2024-01-03,5,6\n2024-01-09,7,8\n")
    found = exports.read_exports(spark, str(tmp_path))
    rows = {(r["chunk_id"], str(r["historical_date"])): r["value"] for r in found.observations.collect()}
    assert rows["C0001", "2024-01-02"] == 0.5 and rows["C0001", "2024-01-03"] == 100
    assert {r["chunk_id"]: (r["n_rows"], r["n_censored"]) for r in found.files.collect()} == {"C0001": (3, 1), "C0002": (2, 0)}
    assert {r["code"] for r in exports.export_issues(found).collect()} == {"more_than_one_query", "date_outside_window"}
    old = spark.createDataFrame([("P1", "C0001", 1.0)], "pull_id string, chunk_id string, value double")
    new = spark.createDataFrame([("P1", "C0001", 2.0), ("P1", "C0002", 3.0)], "pull_id string, chunk_id string, value double")
    assert sorted(r["value"] for r in exports.append_new(old, new).collect()) == [1.0, 3.0]
    sheet = spark.createDataFrame([("2024", "1", "5", 1), ("2024", "1", "6", 2), ("2024", "2", "x", 3)], "y string, m string, v string, row_number int")
    assert sorted((r["month_key"], r["value"]) for r in monthly_keys(sheet, "y", "m", "v").collect()) == [(202401, 5.0), (202402, None)]


def test_stream_drops_repeats_counts_and_recalibrates(spark, batch, tmp_path):
    rows = batch.raw.withColumn("retrieved_at", F.lit("2024-09-01 10:00:00").cast("timestamp"))
    rows = rows.select(*[c.split()[0] for c in ingest.SCHEMA.split(", ")])
    rows.where("pull_id in ('P001', 'P002')").write.parquet(f"{tmp_path}/in")
    rows.where("pull_id = 'P001'").write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def sink(series, batch_id):
        seen.append({(r["pull_id"], r["n"]) for r in series.groupBy("pull_id").agg(F.count("*").alias("n")).collect()})

    stream = ingest.chunk_stream(spark, f"{tmp_path}/in")
    run = ingest.recalibrate_touched(lambda: rows, sink, protocol().calibration_settings())
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {("P001", 244), ("P002", 244)} in seen
    counts = ingest.retrieval_counts(ingest.chunk_stream(spark, f"{tmp_path}/in"))
    query = counts.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r["stream_id"]: r["n_rows"] for r in spark.table("counts").collect()}
    n = rows.where("pull_id = 'P001'").count()
    assert sum(found.values()) == 2 * n


def test_windows_reject_bad_input(spark):
    with pytest.raises(ValueError):
        chunk_windows(spark, "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        chunk_windows(spark, "2024-01-01", "2024-02-01", 10, 10)
