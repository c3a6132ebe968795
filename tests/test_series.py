"""The series operators against NumPy restatements, closed forms and invariants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from braidwork.functions import linalg as L
from braidwork.functions.robust import huber_location
from braidwork.operators import benchmark as B
from braidwork.operators import consensus as C
from braidwork.operators import diagnostics as X
from braidwork.operators import factors as FA
from braidwork.operators import gstudy as G
from braidwork.operators import overlap as O
from braidwork.operators import panel as P
from braidwork.operators import regression as R
from braidwork.operators import validation as V
from braidwork.operators.windows import chunk_windows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DAY0 = dt.date(2024, 1, 1)


def days(n):
    return [DAY0 + dt.timedelta(k) for k in range(n)]


def long(spark, matrix, design=None):
    n, m = matrix.shape
    rows = [("S", f"P{j + 1:03d}", d, None if np.isnan(matrix[t, j]) else float(matrix[t, j]), j % 3, "ABC"[j // 3 % 3], "1") for t, d in enumerate(days(n)) for j in range(m)]
    return spark.createDataFrame(rows, "series_id string, pull_id string, historical_date date, value double, collection_day int, stream_id string, replicate_id string")


def chunks(spark, signal, width=90, step=30, pull="P001", report=True):
    rows, starts = [], list(range(0, len(signal) - width + 1, step))
    for k, s in enumerate(starts):
        part = signal[s : s + width]
        part = np.rint(100 * part / part.max()) if report else part / part.max() * 100
        rows += [("S", pull, f"C{k + 1:04d}", d, float(v), 0, "A", "1", days(len(signal))[s], days(len(signal))[s + width - 1]) for d, v in zip(days(len(signal))[s : s + width], part)]
    return spark.createDataFrame(rows, "series_id string, pull_id string, chunk_id string, historical_date date, value double, collection_day int, stream_id string, replicate_id string, window_start date, window_end date")


def smooth(n=240):
    t = np.arange(n)
    return 40 + 18 * np.sin(t / 23) + 9 * np.cos(t / 7)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.floats(-50, 50), min_size=3, max_size=40), st.floats(-20, 20))
def test_huber_is_translation_equivariant_and_bounded(values, shift):
    x = np.array(values)
    at, scale, variance = huber_location(x)
    moved = huber_location(x + shift)
    assert moved[0] == pytest.approx(at + shift, abs=1e-5)
    assert x.min() - 1e-9 <= at <= x.max() + 1e-9 and variance >= 0 and scale >= 0


def test_huber_degenerate_values():
    assert huber_location(np.array([3.0])) == (3.0, 0.0, float("inf"))
    assert huber_location(np.array([2.0, 2.0, 2.0])) == (2.0, 0.0, 1e-12)


@settings(deadline=None, max_examples=15)
@given(st.integers(1, 900), st.integers(30, 200), st.integers(1, 29))
def test_windows_cover_the_interval(spark, length, width, step):
    end = DAY0 + dt.timedelta(length - 1)
    rows = [r.asDict() for r in chunk_windows(spark, DAY0, end, width, step).orderBy("chunk_id").collect()]
    assert rows[0]["window_start"] == DAY0 and rows[-1]["window_end"] == end
    assert all(a["window_end"] >= b["window_start"] - dt.timedelta(1) for a, b in zip(rows, rows[1:]))
    assert all(r["n_calendar_days"] == min(width, length) for r in rows)


def test_noise_free_chunks_give_the_signal_back_and_variance_is_resistance(spark):
    raw = chunks(spark, smooth(), report=False)
    result = O.calibrate(raw)
    got = result.series.orderBy("historical_date").toPandas()
    want = smooth() / smooth().mean() * 100
    assert np.allclose(got["value"], want, atol=1e-3)
    edges, scales = result.graphs.edges.toPandas(), result.graphs.scales.toPandas()
    nodes = sorted(scales["chunk_id"])
    lap = np.zeros((len(nodes),) * 2)
    for a, b, w in zip(edges["chunk_i"], edges["chunk_j"], edges["weight"]):
        i, j = nodes.index(a), nodes.index(b)
        lap[i, i] += w
        lap[j, j] += w
        lap[i, j] -= w
        lap[j, i] -= w
    inverse, ref = np.linalg.pinv(lap), nodes.index(scales["reference_chunk"].iloc[0])
    for _, r in scales.iterrows():
        i = nodes.index(r["chunk_id"])
        assert r["log_scale_variance"] == pytest.approx(inverse[i, i] + inverse[ref, ref] - 2 * inverse[i, ref], rel=1e-6, abs=1e-15)
    line = result.graphs.diagnostics.first()
    assert line["max_log_scale_variance"] <= line["sequential_max_log_scale_variance"] * (1 + 1e-9)


def test_disconnected_single_and_aggregations(spark):
    signal = smooth(300)
    raw = chunks(spark, signal, width=60, step=120, report=False)
    table = O.edges(raw)
    assert table.count() == 0
    with pytest.raises(Exception, match="components"):
        O.solve_scales(raw, table).scales.collect()
    kept = O.solve_scales(raw, table, O.Calibration(allow_disconnected=True))
    assert kept.scales.count() == 1 and kept.diagnostics.first()["n_components"] == 3
    one = raw.where("chunk_id = 'C0001'")
    assert O.calibrate(one).series.count() == 60
    whole = chunks(spark, signal, report=False)
    for how in ("median", "huber"):
        got = O.calibrate(whole, settings=O.Calibration(aggregation=how)).series.orderBy("historical_date").toPandas()
        assert np.allclose(got["value"], signal / signal.mean() * 100, atol=1e-2)


def test_validation_and_coercion_of_bad_tables(spark):
    raw = chunks(spark, smooth(), report=True)
    assert V.validate_raw_chunks(raw).count() == 0
    missing = V.validate_raw_chunks(raw.drop("value", "stream_id")).first()
    assert missing["code"] == "missing_columns" and "stream_id" in missing["message"]
    assert V.validate_raw_chunks(raw.limit(0)).count() == 0
    bad = raw.withColumn("value", F.when(F.col("chunk_id") == "C0001", "x").otherwise("5")).withColumn("is_partial", F.lit(True))
    found = {r["code"]: r["rows"] for r in V.validate_raw_chunks(bad).collect()}
    assert found == {"invalid_value": 90, "partial_observations": raw.count()}
    assert V.coerce_raw_chunks(bad).where("value is null").count() == 90


def test_weights_satisfy_the_optimality_conditions():
    rng = np.random.default_rng(3)
    for _ in range(40):
        m = rng.integers(2, 9)
        a = rng.normal(size=(m, 2 * m))
        sigma = a @ a.T / m + 0.05 * np.eye(m)
        for cap in (None, 0.5, 0.8):
            w = L.minimum_variance_weights(sigma, True, cap)
            assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= (cap or 1) + 1e-9
            best = w @ sigma @ w
            for _ in range(200):
                v = rng.dirichlet(np.ones(m))
                if v.max() <= (cap or 1):
                    assert v @ sigma @ v >= best - 1e-10
    assert L.minimum_variance_weights(np.diag([1.0, 4.0]), False, None) == pytest.approx([0.8, 0.2])
    with pytest.raises(ValueError, match="infeasible"):
        L.minimum_variance_weights(np.eye(1), True, 0.5)


def test_p_values():
    assert L.student_p(2.0, 10) == pytest.approx(0.0733880348, abs=1e-8)
    assert L.student_p(0.0, 5) == pytest.approx(1.0)
    assert L.normal_p(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert L.signed_rank_p(np.arange(1.0, 6.0)) == pytest.approx(2 / 32)


def test_consensus_recovers_the_signal_and_collapses_copies(spark):
    rng = np.random.default_rng(1)
    truth = 50 + 18 * np.sin(np.arange(260) / 31)
    sd = np.array([0.5, 0.7, 0.9, 1.1, 4.0])
    x = truth[:, None] + rng.normal(size=(260, 5)) * sd
    x = np.column_stack([x, x[:, 0]])
    x[10, 1] = np.nan
    panel = long(spark, x).select(*P.KEY, "value")
    weights = C.pull_weights(panel).toPandas()
    assert set(weights["pull_id"]) == {"P001", "P002", "P003", "P004", "P005"}
    assert weights.set_index("pull_id")["weight"]["P005"] < 0.1 and weights["weight"].sum() == pytest.approx(1)
    got = C.gls_consensus(panel).series.orderBy("historical_date").toPandas()["value"].to_numpy()
    want = truth / truth.mean() * 100
    assert np.sqrt(np.mean((got - want) ** 2)) < 2
    design = long(spark, x).select("series_id", "pull_id", "collection_day", "stream_id", "replicate_id").distinct()
    assert C.leave_one_out(panel, design).count() == 6
    assert sorted(r["n_pulls"] for r in C.convergence(panel, design).where("mae is not null").collect()) == [4, 5, 6]


def test_infeasible_cap_is_reported(spark):
    x = np.random.default_rng(0).normal(50, 1, (40, 1))
    row = C.pull_weights(long(spark, x).select(*P.KEY, "value")).first()
    assert row["weight"] is None and not row["feasible"]


def test_pair_metrics_match_numpy_and_constant_columns_are_null(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.poisson(2, 80), rng.poisson(3, 80), np.full(80, 4.0)]).astype(float)
    rows = {(r["pull_a"], r["pull_b"]): r for r in P.pair_metrics(long(spark, x).select(*P.KEY, "value")).collect()}
    a, b = x[:, 0], x[:, 1]
    r = rows["P001", "P002"]
    rank = lambda v: pd.Series(v).rank().to_numpy()
    assert r["pearson"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert r["spearman"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    assert r["positive_jaccard"] == pytest.approx(((a > 0) & (b > 0)).sum() / ((a > 0) | (b > 0)).sum())
    assert rows["P001", "P003"]["pearson"] is None


def test_design_weighted_cells(spark):
    rows = [("S", p, d, v, day, s, "1") for d in days(2) for p, v, day, s in (("A1", 80.0, 0, "A"), ("A2", 120.0, 0, "A"), ("B1", 100.0, 1, "A"))]
    panel = spark.createDataFrame(rows, "series_id string, pull_id string, historical_date date, value double, collection_day int, stream_id string, replicate_id string")
    panel = panel.withColumn("value", F.when((F.col("pull_id") != "B1") & (F.col("historical_date") == str(DAY0)), F.col("value") * 0.8).otherwise(F.col("value")))
    got = P.design_weighted(panel).orderBy("historical_date").toPandas()
    assert got["value"].tolist() == pytest.approx([(0.8 / 0.9 * 100 + 100) / 2, (1 / 0.9 * 100 + 100) / 2])


def test_gstudy_matches_dense_formulas(spark):
    rng = np.random.default_rng(4)
    a, b, c, r = 30, 3, 2, 2
    x = rng.normal(size=(a, 1, 1, 1)) * 3 + rng.normal(size=(1, b, 1, 1)) + rng.normal(size=(a, b, c, r)) + 10
    rows = [("S", f"P{d}{s}{k}", days(a)[t], float(x[t, d, s, k]), d, "AB"[s], str(k)) for t in range(a) for d in range(b) for s in range(c) for k in range(r)]
    panel = spark.createDataFrame(rows, "series_id string, pull_id string, historical_date date, value double, collection_day int, stream_id string, replicate_id string")
    table = {q["source"]: q for q in G.anova(G.transformed(panel, "level")).collect()}
    cell = x.mean(axis=3)
    assert table["T"]["sum_sq"] == pytest.approx(b * c * ((cell.mean(axis=(1, 2)) - cell.mean()) ** 2).sum())
    assert table["E"]["sum_sq"] == pytest.approx(((x - cell[..., None]) ** 2).sum()) and table["E"]["df"] == a * b * c * (r - 1)
    parts = {q["component"]: q for q in G.variance_components(G.anova(G.transformed(panel, "level"))).collect()}
    assert parts["T"]["variance"] == pytest.approx(9, rel=0.6) and parts["E"]["variance"] == pytest.approx(1, rel=0.4)
    with pytest.raises(Exception, match="crossed|replicates"):
        G.anova(panel.where("not (pull_id = 'P000' and value > 10)").withColumn("g", F.col("value"))).collect()
    one = G.anova(G.transformed(panel.where("stream_id = 'A'"), "level"))
    assert {q["source"]: q["mean_sq"] for q in one.collect()}["S"] is None
    draws = G.bootstrap(G.transformed(panel, "level"), 5, block=7)
    assert draws.count() == 5 and G.percentile_interval(draws).first()["ci_lower"] <= 1


def test_coefficients_closed_form(spark):
    parts = spark.createDataFrame([("S", k, v) for k, v in {"T": 100.0, "D": 1.0, "S": 1.0, "TD": 4.0, "TS": 3.0, "DS": 0.5, "TDS": 6.0, "E": 8.0}.items()], "series_id string, component string, variance double")
    row = G.d_study(parts, [3], [3], [2]).first()
    rel = 4 / 3 + 3 / 3 + 6 / 9 + 8 / 18
    assert row["generalizability_coefficient"] == pytest.approx(100 / (100 + rel))
    assert row["dependability_coefficient"] == pytest.approx(100 / (100 + rel + 1 / 3 + 1 / 3 + 0.5 / 9))


def test_benchmark_exact_means_soft_optimality_and_clipping(spark):
    z = np.linspace(10, 20, 28)
    daily = spark.createDataFrame([("S", d, float(v)) for d, v in zip(days(28), z)], "series_id string, historical_date date, value double")
    periods = spark.createDataFrame([("S", days(28)[0], days(28)[13], 15.0), ("S", days(28)[14], days(28)[27], 25.0)], "series_id string, period_start date, period_end date, value double")
    x = B.corrected_series(daily, periods, B.BenchmarkSettings(mode="exact")).orderBy("historical_date").toPandas()["value"].to_numpy()
    assert x[:14].mean() == pytest.approx(15) and x[14:].mean() == pytest.approx(25)
    soft = B.corrected_series(daily, periods).orderBy("historical_date").toPandas()["value"].to_numpy()
    d = np.diff(np.eye(28), axis=0)
    q = (1 + 1e-8) * np.eye(28) + 10 * d.T @ d
    a = np.kron(np.eye(2), np.ones(14) / 14)
    want = z + np.linalg.solve(q + a.T @ a / 4, a.T @ (np.array([15, 25]) - a @ z) / 4)
    assert np.allclose(soft, want, atol=1e-9)
    low = spark.createDataFrame([("S", days(28)[0], days(28)[27], -400.0), ("S", dt.date(2030, 1, 1), dt.date(2030, 1, 9), 1.0)], "series_id string, period_start date, period_end date, value double")
    clipped = B.corrected_series(daily, low, B.BenchmarkSettings(mode="exact"))
    assert clipped.where("value < 0").count() == 0 and clipped.where("clipped").count() > 0
    fit = B.benchmark_fit(clipped.select(*P.DATE, "value"), low)
    assert fit.count() == 1
    assert B.benchmark_diagnostics(clipped, fit).first()["negative_values_before_clip"] > 0


def test_interpolation_is_positional_and_fills_the_ends(spark):
    v = [None, 2.0, None, None, 8.0, None]
    s = spark.createDataFrame([("S", d, x) for d, x in zip(days(6), v)], "series_id string, historical_date date, value double")
    assert [r["value"] for r in P.interpolated(s).orderBy("historical_date").collect()] == [2, 2, 4, 6, 8, 8]


def test_corrected_regression_and_simex(spark):
    rng = np.random.default_rng(5)
    n, x = 3000, rng.normal(size=3000)
    c = rng.normal(size=n)
    y, seen = 2 * x + 0.5 * c + rng.normal(size=n) * 0.3, x + 0.8 * rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "y": y, "x": seen, "sigma2": 0.64, "c": c}))
    z = np.column_stack([np.ones(n), c])
    m = np.eye(n) - z @ np.linalg.pinv(z)
    xr, yr = m @ seen, m @ y
    row = R.reliability_corrected_ols(df, ("c",)).first()
    assert row["coefficient"] == pytest.approx((xr @ yr) / (xr @ xr - 0.64 * np.diag(m).sum()))
    assert row["coefficient"] == pytest.approx(2, abs=0.1) and row["control_c"] == pytest.approx(0.5, abs=0.1)
    with pytest.raises(R.IdentificationError):
        R.reliability_corrected_ols(df.withColumn("sigma2", F.lit(100.0)))
    curve = R.simex(df, simulations=20)
    plain = np.cov(seen, y)[0, 1] / seen.var(ddof=1)
    assert [r["mean_coefficient"] for r in curve.where("lam = 0").collect()] == [pytest.approx(plain)]
    assert abs(R.simex_estimate(curve) - 2) < abs(plain - 2)


def test_regression_by_series_keeps_series_apart(spark):
    rng = np.random.default_rng(8)
    parts = []
    for name, slope, noise in (("A", 2.0, 0.0), ("B", -1.0, 0.0), ("C", 1.0, 100.0)):
        x = rng.normal(size=60)
        parts.append(pd.DataFrame({"series_id": name, "t": np.arange(60), "y": slope * x + 0.1 * rng.normal(size=60), "x": x, "sigma2": noise}))
    parts.append(parts[0].head(2).assign(series_id="D"))
    df = spark.createDataFrame(pd.concat(parts))
    got = {r["series_id"]: r for r in R.reliability_corrected_by_series(df).collect()}
    for name in "AB":
        one = R.reliability_corrected_ols(df.where(F.col("series_id") == name).drop("series_id")).first()
        assert got[name]["identified"] and got[name]["coefficient"] == pytest.approx(one["coefficient"]) and got[name]["p_value"] < 1e-6
    assert [got[n]["identified"] for n in "CD"] == [False, False] and got["C"]["coefficient"] is None and got["D"]["standard_error"] is None
    assert R.reliability_corrected_by_series(df.limit(0)).count() == 0


def test_factors_without_error_are_principal_components(spark):
    rng = np.random.default_rng(6)
    f = rng.normal(size=400)
    load = np.array([0.9, 0.8, 0.85, 0.7])
    x = f[:, None] * load + rng.normal(size=(400, 4)) * 0.4
    rows = [(f"S{j}", d, float(x[t, j]), 0.0) for t, d in enumerate(days(400)) for j in range(4)]
    df = spark.createDataFrame(rows, "series_id string, historical_date date, value double, error_variance double")
    found = FA.error_corrected_factors(df)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert [r["eigenvalue"] for r in found.spectrum.orderBy("rank").collect()] == pytest.approx(values)
    assert found.diagnostics["n_factors"] == 1 and found.diagnostics["measurement_error_share"] == pytest.approx(0, abs=1e-12)
    assert all(r["attenuation_ratio"] == pytest.approx(1) for r in found.loadings.collect())
    scores = found.scores.orderBy("historical_date").toPandas()["score"].to_numpy()
    assert abs(np.corrcoef(scores, f)[0, 1]) > 0.9
    with pytest.raises(FA.IndefiniteCovarianceError):
        FA.error_corrected_factors(df.withColumn("error_variance", F.lit(5.0)))


def test_graph_statistics_of_duplicates(spark):
    pairs = [("S", a, b, True) for a, b in (("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"))] + [("S", "E", "F", False)]
    df = spark.createDataFrame(pairs, "series_id string, pull_a string, pull_b string, near_duplicate boolean")
    pulls = spark.createDataFrame([("S", p) for p in "ABCDEF"], "series_id string, pull_id string")
    rows = {r["pull_id"]: r for r in X.duplicate_components(df, pulls).collect()}
    assert (rows["A"]["component_id"], rows["A"]["size"], rows["A"]["max_clique"], rows["A"]["diameter"], rows["A"]["density"]) == ("N001", 4, 3, 2, pytest.approx(4 / 6))
    assert rows["C"]["is_articulation_point"] and not rows["A"]["is_articulation_point"] and rows["E"]["size"] == 1


def test_published_edge_layouts_have_the_closed_form_path():
    w = pd.DataFrame({"window_start": [DAY0 + dt.timedelta(30 * k) for k in range(6)], "window_end": [DAY0 + dt.timedelta(30 * k + 89) for k in range(6)]})
    found = X.design_resistance(w)
    assert found["path_resistance"] == pytest.approx(3 / 60) and found["graph_resistance"] < found["path_resistance"]


def test_cell_weights_must_match_the_cells(spark):
    rows = [("S", p, d, v, day, s, "1") for d in days(2) for p, v, day, s in (("A1", 80.0, 0, "A"), ("A2", 120.0, 0, "A"), ("B1", 100.0, 1, "A"))]
    panel = spark.createDataFrame(rows, "series_id string, pull_id string, historical_date date, value double, collection_day int, stream_id string, replicate_id string")
    weights = lambda *w: spark.createDataFrame(w, "design_cell string, target_weight double")
    got = P.design_weighted(panel, weights=weights(("0|A", 1.0), ("1|A", 3.0))).collect()
    assert [r["value"] for r in got] == pytest.approx([100.0, 100.0]) and all(r["complete_cell_coverage"] for r in got)
    for bad in ([("0|A", 1.0)], [("0|A", 1.0), ("1|A", 3.0), ("9|A", 1.0)], [("0|A", -1.0), ("1|A", 3.0)], [("0|A", 0.0), ("1|A", 0.0)], [("0|A", 1.0), ("0|A", 1.0), ("1|A", 3.0)], [("0|A", None), ("1|A", 3.0)], [("0|A", float("inf")), ("1|A", 3.0)]):
        with pytest.raises(Exception, match="weights must match"):
            P.design_weighted(panel, weights=weights(*bad)).collect()
