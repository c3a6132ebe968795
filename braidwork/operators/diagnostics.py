"""Diagnostics of overlaps, chunk paths, duplicate graphs and replicated runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from ..functions.linalg import signed_rank_p, student_p
from .overlap import EDGE, PULL, overlap_pairs
from .panel import DATE


def path_variance(raw: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Cumulative resistance of every chunk along the path of chunk ids; null from a missing join on."""
    nodes = raw.select(*PULL, "chunk_id").distinct()
    order = W.partitionBy(*PULL).orderBy("chunk_id")
    steps = nodes.withColumn("before", F.lag("chunk_id").over(order))
    links = edge_table.select(*PULL, F.least("chunk_i", "chunk_j").alias("before"), F.greatest("chunk_i", "chunk_j").alias("chunk_id"), "variance")
    joined = steps.join(links, [*PULL, "before", "chunk_id"], "left")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    broken = F.max((F.col("before").isNotNull() & F.col("variance").isNull()).cast("int")).over(upto)
    total = F.sum(F.coalesce("variance", F.lit(0.0))).over(upto)
    return joined.select(*PULL, "chunk_id", F.when(broken == 0, total).alias("resistance"))


def reference_chunk(edge_table: DataFrame, max_weight: float = 1e6) -> DataFrame:
    """The chunk of highest weighted degree of every pull, the first by id among equals."""
    w = F.least(1 / F.col("variance"), F.lit(max_weight)).alias("w")
    ends = edge_table.select(*PULL, F.col("chunk_i").alias("chunk_id"), w).unionAll(edge_table.select(*PULL, F.col("chunk_j").alias("chunk_id"), w))
    degree = ends.groupBy(*PULL, "chunk_id").agg(F.sum("w").alias("degree"), F.count("*").alias("n_edges"))
    rank = F.row_number().over(W.partitionBy(*PULL).orderBy(F.col("degree").desc(), "chunk_id"))
    return degree.withColumn("r", rank).where("r = 1").drop("r")


def overlap_diagnostics(raw: DataFrame, min_value: float = 2.0, least: int = 14) -> DataFrame:
    """Per overlap: spread of the log ratio, its drift per 100 usable days, and the floor that rounding sets.

    A value rounded to whole units is off by a uniform error of variance 1/12; on the log scale the
    floor is the mean of its delta-method variance over both chunks.
    """
    usable = (F.col("value_i") >= min_value) & (F.col("value_j") >= min_value)
    rows = overlap_pairs(raw).where(usable).withColumn("d", F.ln("value_i") - F.ln("value_j"))
    day = F.row_number().over(W.partitionBy(*EDGE).orderBy("historical_date")) - 1
    rows = rows.withColumn("x", day / F.lit(100.0)).withColumn("floor", 1 / (12 * F.pow("value_i", 2)) + 1 / (12 * F.pow("value_j", 2)))
    found = rows.groupBy(*EDGE).agg(
        F.count("*").alias("n"),
        F.avg("d").alias("mean_log_ratio"),
        F.stddev_samp("d").alias("sd_log_ratio"),
        F.sqrt(F.avg("floor")).alias("rounding_floor_sd"),
        F.regr_slope("d", "x").alias("drift_per_100_days"),
        F.regr_sxx("d", "x").alias("sxx"),
        F.regr_syy("d", "x").alias("syy"),
    )
    rest = F.greatest(F.col("syy") - F.pow("drift_per_100_days", 2) * F.col("sxx"), F.lit(0.0))
    se = F.sqrt(ratio(ratio(rest, F.col("n") - 2), F.col("sxx")))
    out = found.where(F.col("n") >= least).withColumn("excess_over_floor", ratio("sd_log_ratio", "rounding_floor_sd")).withColumn("drift_se_per_100_days", se)
    return out.drop("sxx", "syy")


def residual_misscaling(observations: DataFrame, series: DataFrame) -> DataFrame:
    """Per chunk: mean, standard error and t of the log of calibrated values over the daily series."""
    rows = observations.select(*PULL, "chunk_id", "historical_date", "calibrated_value").join(series.select(*PULL, "historical_date", F.col("value").alias("level")), [*PULL, "historical_date"])
    rows = rows.where("calibrated_value > 0 and level > 0").withColumn("d", F.ln("calibrated_value") - F.ln("level"))
    found = rows.groupBy(*PULL, "chunk_id").agg(F.count("*").alias("n"), F.avg("d").alias("mean_log_residual"), ratio(F.stddev_samp("d"), F.sqrt(F.count("*"))).alias("se"))
    return found.withColumn("t", ratio("mean_log_residual", "se"))


def _graph_statistics(rows: pd.DataFrame) -> pd.DataFrame:
    """Components of a duplicate graph with their size, density, diameter, largest clique and cut vertices."""
    series = rows["series_id"].iloc[0]
    nodes = sorted(rows["pull_a"][rows["pull_b"].isna()])
    links = rows[rows["pull_b"].notna()]
    near = {n: set() for n in nodes}
    for a, b in zip(links["pull_a"], links["pull_b"]):
        near[a].add(b)
        near[b].add(a)

    def reach(start, without=None):
        depth, todo = {start: 0}, [start]
        for x in todo:
            for y in sorted(near[x]):
                if y not in depth and y != without:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        return depth

    def clique(chosen, open_, closed):
        if not open_ and not closed:
            return len(chosen)
        pivot = max(open_ | closed, key=lambda v: len(near[v] & open_))
        best = 0
        for v in sorted(open_ - near[pivot]):
            best = max(best, clique(chosen | {v}, open_ & near[v], closed & near[v]))
            open_, closed = open_ - {v}, closed | {v}
        return best

    left, groups = set(nodes), []
    while left:
        members = sorted(reach(min(left)))
        groups.append(members)
        left -= set(members)
    groups.sort(key=lambda g: (-len(g), g))
    out = []
    for k, members in enumerate(groups, 1):
        edges = sum(len(near[v]) for v in members) // 2
        n = len(members)
        cut = {v for v in members if n > 2 and len(reach(next(x for x in members if x != v), v)) < n - 1}
        diameter = max(max(reach(v).values()) for v in members)
        largest = clique(frozenset(), set(members), set())
        for v in members:
            out.append((series, f"N{k:03d}", v, n, n / len(nodes), edges, edges / (n * (n - 1) / 2) if n > 1 else 0.0, diameter, largest, len(cut), len(near[v]), v in cut))
    return pd.DataFrame(out, columns=[c.split()[0] for c in COMPONENTS.split(", ")])


COMPONENTS = "series_id string, component_id string, pull_id string, size int, share double, n_edges int, density double, diameter int, max_clique int, n_articulation_points int, degree int, is_articulation_point boolean"


def duplicate_components(pairs: DataFrame, pulls: DataFrame, flag: str = "near_duplicate") -> DataFrame:
    """Membership and statistics of the components that flagged pairs make, per series.

    One small group per series: its pulls and flagged pairs.
    """
    links = pairs.where(flag).select("series_id", "pull_a", "pull_b")
    nodes = pulls.select("series_id", F.col("pull_id").alias("pull_a"), F.lit(None).cast("string").alias("pull_b")).distinct()
    return links.unionByName(nodes).groupBy("series_id").applyInPandas(_graph_statistics, COMPONENTS)


def duplicate_summary(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Counters of exact and near pairs and of components, per series."""
    by_pair = pairs.groupBy("series_id").agg(F.count("*").alias("n_pairs"), F.count_if("exact_vector").alias("n_exact_pairs"), F.count_if("near_duplicate").alias("n_near_pairs"))
    by_part = components.groupBy("series_id").agg(F.count_distinct("component_id").alias("n_components"), F.max("share").alias("max_component_share"), F.max("size").alias("max_component_size"))
    return by_pair.join(by_part, "series_id")


def replication_summary(metrics: DataFrame, by=("estimator",), column: str = "rmse") -> DataFrame:
    """Mean, median, spread and Monte Carlo error of a metric over replications."""
    c = F.col(column)
    return metrics.groupBy(*by).agg(F.count("*").alias("replications"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("sd"), ratio(F.stddev_samp(c), F.sqrt(F.count("*"))).alias("mcse"))


def paired_comparison(metrics: DataFrame, better: str, worse: str, column: str = "rmse") -> DataFrame:
    """Differences of two estimators over replications: mean, t, wins; p values of t and signed-rank tests."""
    side = lambda name, to: metrics.where(F.col("estimator") == name).select("replication", F.col(column).alias(to))
    rows = side(better, "b").join(side(worse, "w"), "replication").withColumn("d", F.col("w") - F.col("b"))

    @F.pandas_udf("double")
    def ranks(values: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(np.asarray(v, float)) for v in values])

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(float(a), float(b) - 1) if pd.notna(a) and b > 1 else None for a, b in zip(t, n)], dtype=float)

    found = rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), ratio(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("t"), F.count_if(F.col("d") > 0).alias("wins"), F.sort_array(F.collect_list("d")).alias("all"))
    return found.select(F.lit(better).alias("better"), F.lit(worse).alias("worse"), "n", "mean_difference", "t", "wins", two_sided("t", "n").alias("t_p"), ranks("all").alias("signed_rank_p"))


def design_resistance(windows: pd.DataFrame, least: int = 14) -> dict:
    """Scale variance of a window layout alone, were every overlapping day one unit of precision.

    The graph's largest effective resistance to the middle chunk, and the path's.
    """
    start, end = pd.to_datetime(windows["window_start"]).to_numpy(), pd.to_datetime(windows["window_end"]).to_numpy()
    days = (np.minimum(end[:, None], end[None, :]) - np.maximum(start[:, None], start[None, :])) / np.timedelta64(1, "D") + 1
    w = np.where(days >= least, days, 0.0)
    np.fill_diagonal(w, 0)
    n, ref = len(w), len(w) // 2
    inverse = np.linalg.pinv(np.diag(w.sum(1)) - w)
    d = np.diag(inverse)
    graph = float((d + d[ref] - 2 * inverse[ref]).max())
    steps = [w[i, i + 1] for i in range(n - 1)]
    total = np.concatenate(([0.0], np.cumsum([1 / s if s else np.inf for s in steps])))
    path = float(np.abs(total - total[ref]).max())
    return {"n_chunks": n, "graph_resistance": graph, "path_resistance": path, "reduction": path / graph if graph > 0 else float("nan")}


def chain_error(edge_table: DataFrame) -> DataFrame:
    """Accumulated error of walking along neighbouring chunks: sum and root of the summed variances by steps."""
    order = W.partitionBy(*PULL).orderBy("chunk_i")
    near = edge_table.withColumn("r", F.row_number().over(W.partitionBy(*PULL, "chunk_i").orderBy("chunk_j"))).where("r = 1").drop("r")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return near.select(*PULL, "chunk_i", "chunk_j", F.row_number().over(order).alias("steps"), F.sum("log_ratio").over(upto).alias("log_scale"), F.sqrt(F.sum("variance").over(upto)).alias("error"))


def vintage_comparison(current: DataFrame, archived: DataFrame, trim: int = 3) -> DataFrame:
    """Two vintages of one series without the last ``trim`` rows: differences beyond what single precision hides."""
    whole = W.partitionBy("series_id").orderBy(F.col("historical_date").desc())
    rows = current.select(*DATE, F.col("value").alias("x")).join(archived.select(*DATE, F.col("value").alias("y")), DATE).withColumn("r", F.row_number().over(whole)).where(F.col("r") > trim)
    gap = ratio(F.abs(F.col("x") - F.col("y")), F.abs("y"))
    floor = ratio(F.abs(F.col("x").cast("float").cast("double") - F.col("x")), F.abs("x"))
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.max(gap).alias("max_relative"), F.median(gap).alias("median_relative"), F.count_if(gap > 1e-6).alias("n_changed"), F.max(floor).alias("single_precision_floor"))
