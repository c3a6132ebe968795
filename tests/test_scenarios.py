"""Scenario runs of the simulator."""

from braidwork.plans import scenarios, simulation

from .test_batch import protocol


def test_graph_and_sequential_calibration_are_close_and_per_pull(spark):
    got = scenarios.calibration_comparison(spark, protocol(), simulation.Settings(seed=3)).toPandas()
    wide = got.pivot(index="pull_id", columns="estimator", values="rmse")
    assert wide.shape == (6, 2) and wide.notna().all().all()
    assert (wide["graph"] / wide["sequential"]).between(0.7, 1.3).all()


def test_without_noise_both_calibrations_agree(spark):
    quiet = simulation.Settings(seed=3, chunk_noise=0.0, rounding=False)
    wide = scenarios.calibration_comparison(spark, protocol(), quiet).toPandas().pivot(index="pull_id", columns="estimator", values="rmse")
    # The graph corrects for the variance of its scales, of which the floor is 1e-6.
    assert (wide["graph"] - wide["sequential"]).abs().max() < 1e-5


def test_scenarios_are_labelled(spark):
    rows = scenarios.run_scenarios(spark, protocol(), {"a": simulation.Settings(), "b": simulation.Settings(noise_ladder=5.0)}, 1)
    assert {(r["scenario"], r["n"]) for r in rows.groupBy("scenario").count().withColumnRenamed("count", "n").collect()} == {("a", 8), ("b", 8)}
