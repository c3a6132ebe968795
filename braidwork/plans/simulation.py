"""Simulated batches with a known truth, and Monte Carlo comparisons of the estimators."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..operators import benchmark as B
from ..operators import consensus as C
from ..operators import diagnostics as X
from ..operators import overlap as O
from ..operators import panel as P
from ..operators.windows import chunk_windows, collection_schedule
from .config import Protocol


@dataclass(frozen=True)
class Settings:
    """Noise of a simulated batch; spreads are on the log scale unless ``additive``."""

    seed: int = 1200
    phi: float = 0.6
    latent_sd: float = 0.15
    spikes: int = 4
    day_sd: float = 0.03
    stream_sd: float = 0.02
    shared_day_noise: float = 0.02
    retrieval_noise: float = 0.08
    noise_ladder: float = 1.0
    chunk_noise: float = 0.01
    cache_fraction: float = 0.0
    cache_weight: float = 0.0
    exact_duplicates: float = 0.0
    additive: bool = False
    rounding: bool = True
    benchmark_noise: float = 1.0


@dataclass(frozen=True)
class Simulated:
    raw: DataFrame
    truth: DataFrame
    benchmark: DataFrame
    design: DataFrame


def ar1(n: int, phi: float, sd: float, rng: np.random.Generator) -> np.ndarray:
    """A stationary first-order autoregression with marginal standard deviation ``sd``."""
    out = np.empty(n)
    step = rng.normal(0, sd * np.sqrt(1 - phi * phi), n)
    out[0] = rng.normal(0, sd)
    for t in range(1, n):
        out[t] = phi * out[t - 1] + step[t]
    return out


def simulate(spark: SparkSession, protocol: Protocol, settings: Settings = Settings()) -> Simulated:
    """One batch: latent series, retrieval errors of every pull, windows scaled to their maximum.

    The driver draws one vector per pull from one generator in a fixed order, so a seed gives the same
    batch everywhere; cutting into windows, scaling, rounding and clipping are a Spark plan. An exact
    duplicate takes over the values of an earlier pull.
    """
    s, q = settings, protocol.query
    rng = np.random.default_rng(s.seed)
    dates = pd.date_range(q.historical_start, q.historical_end)
    n, t = len(dates), np.arange(len(dates))
    level = 50 * np.exp(0.25 * np.sin(2 * np.pi * t / 365.25) + 0.08 * np.sin(2 * np.pi * t / 7) + ar1(n, s.phi, s.latent_sd, rng))
    for at in rng.integers(0, n, s.spikes):
        level[at : at + 5] *= 1 + rng.uniform(0.5, 1.5) * 0.6 ** np.arange(len(level[at : at + 5]))
    windows = chunk_windows(spark, q.historical_start, q.historical_end, protocol.chunking.window_days, protocol.chunking.step_days)
    plan = collection_schedule(spark, protocol, [], q.historical_end).toPandas()
    effects = {c: {v: rng.normal(0, sd) for v in plan[c].unique()} for c, sd in (("collection_day", s.day_sd), ("stream_id", s.stream_sd))}
    shared = {d: rng.normal(0, s.shared_day_noise, n) for d in plan["collection_day"].unique()}
    cache = rng.normal(0, s.retrieval_noise, n)
    cached = set(rng.permutation(len(plan))[: int(round(s.cache_fraction * len(plan)))].tolist())
    rows, made = [], []
    for i, pull in plan.iterrows():
        sd = s.retrieval_noise * s.noise_ladder ** (i / max(len(plan) - 1, 1))
        noise = rng.normal(0, sd, n)
        if i in cached:
            noise = s.cache_weight * cache + np.sqrt(max(1 - s.cache_weight**2, 0)) * noise
        error = effects["collection_day"][pull["collection_day"]] + effects["stream_id"][pull["stream_id"]] + shared[pull["collection_day"]] + noise
        value = level + level.mean() * error if s.additive else level * np.exp(error)
        if made and rng.random() < s.exact_duplicates:
            value = made[rng.integers(len(made))]
        made.append(value)
        rows.append(pd.DataFrame({"series_id": q.series_id, "pull_id": pull["pull_id"], "historical_date": dates.date, "level": value, "collection_day": int(pull["collection_day"]), "stream_id": pull["stream_id"], "replicate_id": pull["replicate_id"]}))
    if s.additive and any((v < 0).any() for v in made):
        warnings.warn("additive noise made negative values, which are raised to 0", stacklevel=2)
    pulls = spark.createDataFrame(pd.concat(rows, ignore_index=True), "series_id string, pull_id string, historical_date date, level double, collection_day int, stream_id string, replicate_id string")
    days = windows.select("chunk_id", "window_start", "window_end", F.explode(F.sequence("window_start", "window_end")).alias("historical_date"))
    # A chunk's error is a hash normal, equal for copies of a pull's values.
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(s.seed), F.lit(k), "chunk_id", "historical_date", F.round("level", 9)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * np.pi * unit(2)) * s.chunk_noise
    cut = pulls.join(F.broadcast(days), "historical_date").withColumn("v", F.greatest(F.col("level") * F.exp(noise), F.lit(0.0)))
    value = 100 * F.try_divide(F.col("v"), F.max("v").over(W.partitionBy("series_id", "pull_id", "chunk_id")))
    value = F.rint(value) if s.rounding else value
    raw = cut.select("series_id", "pull_id", "chunk_id", "historical_date", F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)).alias("value"), "collection_day", "stream_id", "replicate_id", "window_start", "window_end")
    scaled = 100 * level / level.mean()
    truth = spark.createDataFrame(pd.DataFrame({"series_id": q.series_id, "historical_date": dates.date, "value": scaled}), "series_id string, historical_date date, value double")
    frames = []
    for name, rule in (("weekly", "W-SUN"), ("monthly", "M")):
        groups = pd.Series(scaled, index=dates).groupby(dates.to_period(rule))
        for period, values in groups:
            frames.append((q.series_id, name, values.index[0].date(), values.index[-1].date(), float(values.mean() + rng.normal(0, s.benchmark_noise)), s.benchmark_noise))
    benchmark = spark.createDataFrame(frames, "series_id string, frequency string, period_start date, period_end date, value double, se double")
    design = spark.createDataFrame(plan[["series_id", "pull_id", "collection_day", "stream_id", "replicate_id"]])
    return Simulated(raw, truth, benchmark, design)


def evaluate(batch: Simulated, protocol: Protocol) -> DataFrame:
    """Errors of a single pull, the median, the mean and the weighted consensus, plain and benchmarked.

    Every estimator is compared with the same information: each is benchmarked too.
    """
    q = protocol.query
    series = checkpointed(O.calibrate(batch.raw, q.baseline_start, q.baseline_end, protocol.calibration_settings()).series.select(*P.KEY, "value"))
    first = series.groupBy("series_id").agg(F.min("pull_id").alias("pull_id"))
    level = lambda agg: series.groupBy(*P.DATE).agg(agg.alias("value"))
    plain = {
        "single_pull": series.join(first, ["series_id", "pull_id"], "left_semi").select(*P.DATE, "value"),
        "median": level(F.median("value")),
        "simple_mean": level(F.avg("value")),
        "gls": C.gls_consensus(series, protocol.consensus_settings()).series.select(*P.DATE, "value"),
    }
    out = None
    for name, estimate in plain.items():
        for benchmarked in (False, True):
            x = B.corrected_series(estimate, batch.benchmark, protocol.benchmark_settings()).select(*P.DATE, "value") if benchmarked else estimate
            row = P.metrics_against(x, batch.truth).withColumn("estimator", F.lit(name + ("_benchmarked" if benchmarked else "")))
            out = row if out is None else out.unionByName(row)
    return out


def monte_carlo(spark: SparkSession, protocol: Protocol, replications: int, first_seed: int = 1200, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Metrics of all replications and their summary by estimator, best first."""
    from dataclasses import replace

    rows = None
    for k in range(replications):
        one = checkpointed(evaluate(simulate(spark, protocol, replace(settings, seed=first_seed + k)), protocol).withColumn("replication", F.lit(k)))
        rows = one if rows is None else rows.unionByName(one)
    return rows, X.replication_summary(rows).orderBy("mean")
