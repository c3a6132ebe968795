"""Operators on the panel of complete pulls: long rows ``series_id, pull_id, historical_date, value``.

The panel stays long; what a date x pull matrix would do is done with windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import average_rank, mad_scale, ordered_pairs, ratio, safe_corr

KEY = ["series_id", "pull_id", "historical_date"]
DATE = ["series_id", "historical_date"]


def assert_unique(panel: DataFrame) -> DataFrame:
    """The panel, failing on a second value of a pull on a date."""
    n = F.count("*").over(W.partitionBy(*KEY))
    return panel.withColumn("value", F.when(n == 1, F.col("value")).otherwise(F.raise_error(F.lit("a pull has two values on one date")).cast("double")))


def densify(panel: DataFrame) -> DataFrame:
    """Every pull on every date of its series; where a pull has no row its value is null."""
    dates, pulls = panel.select(*DATE).distinct(), panel.select("series_id", "pull_id").distinct()
    return dates.join(pulls, "series_id").join(panel, KEY, "left")


def baseline_scaled(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Values scaled so that every pull's baseline mean is 100; fails unless it is positive."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("historical_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        inside = inside & (F.col("historical_date") <= F.lit(str(end)).cast("date"))
    level = panel.groupBy("series_id", "pull_id").agg(F.avg(F.when(inside, F.col("value"))).alias("level"))
    factor = F.when(F.col("level") > 0, 100 / F.col("level")).otherwise(F.raise_error(F.lit("every pull needs a positive baseline mean")).cast("double"))
    return panel.join(level, ["series_id", "pull_id"]).withColumn("value", F.col("value") * factor).drop("level")


def cross_pull_median(panel: DataFrame) -> DataFrame:
    """The median over pulls of every date."""
    return panel.groupBy(*DATE).agg(F.median("value").alias("median_value"), F.count("value").alias("n_pulls"))


def complete_dates(panel: DataFrame) -> DataFrame:
    """Rows of dates on which every pull of the series has a value."""
    dense = densify(panel)
    by_date = W.partitionBy(*DATE)
    return dense.withColumn("n", F.count("*").over(by_date)).withColumn("k", F.count("value").over(by_date)).where("n = k").drop("n", "k")


def balanced_dates(panel: DataFrame) -> DataFrame:
    """Rows of dates that have as many pulls as there are day, stream and replicate combinations."""
    cells = panel.select("series_id", "collection_day", "stream_id", "replicate_id").distinct().groupBy("series_id").agg(F.count("*").alias("expected"))
    dates = panel.groupBy(*DATE).agg(F.count_distinct("pull_id").alias("n")).join(cells, "series_id").where("n = expected")
    return panel.join(dates.select(*DATE), DATE, "left_semi")


def zero_share_screen(panel: DataFrame, threshold: float, epsilon: float = 1e-12) -> DataFrame:
    """Share of zeros of every series, and whether it is kept; nulls do not count."""
    share = F.avg((F.abs("value") <= epsilon).cast("double"))
    return panel.groupBy("series_id").agg(share.alias("zero_share")).withColumn("kept", F.col("zero_share") <= threshold)


def finite_share(panel: DataFrame, least: float) -> DataFrame:
    """Share of dates with a value, per pull of the dense panel, and whether it suffices."""
    share = F.avg(F.col("value").isNotNull().cast("double")).alias("finite_share")
    return densify(panel).groupBy("series_id", "pull_id").agg(share).withColumn("kept", F.col("finite_share") >= least)


def exact_groups(panel: DataFrame, decimals: int = 10) -> DataFrame:
    """Per pull: a digest of its rounded values on all dates, its representative, and how many share it."""
    point = F.struct("historical_date", F.round("value", decimals).alias("v"))  # one array per pull: its dates
    digest = F.sha2(F.to_json(F.array_sort(F.collect_list(point))), 256).alias("digest")
    digests = densify(panel).groupBy("series_id", "pull_id").agg(digest)
    same = W.partitionBy("series_id", "digest")
    return digests.select("series_id", "pull_id", "digest", F.min("pull_id").over(same).alias("representative"), F.count("*").over(same).alias("multiplicity"))


def collapse_exact(panel: DataFrame, decimals: int = 10) -> DataFrame:
    """The panel with one pull, the first by id, of those with equal values."""
    first = exact_groups(panel, decimals).where("pull_id = representative").select("series_id", "pull_id", "multiplicity")
    return panel.join(first, ["series_id", "pull_id"])


def design_weighted(panel: DataFrame, cell_columns=("collection_day", "stream_id"), weights: DataFrame | None = None, start=None, end=None, complete: bool = True) -> DataFrame:
    """The fixed mixture of design-cell means, one row per date.

    A cell's mean on a date is that of its pulls, null with ``complete`` if one of them has no value.
    The mixture is null unless all cells have a mean. ``weights`` has ``design_cell, target_weight``, one
    row for each cell of every series; cells without a weight, weights without a cell, repeated, negative,
    missing or infinite weights, and a sum of zero are errors. By default cells weigh the same.
    """
    cell = F.concat_ws("|", *[F.col(c).cast("string") for c in cell_columns])
    design = panel.select("series_id", "pull_id", cell.alias("design_cell")).distinct()
    scaled = baseline_scaled(panel.select(*KEY, "value"), start, end)
    dense = densify(scaled).join(design, ["series_id", "pull_id"])
    mean = F.when(F.count("value") == F.count("*"), F.avg("value")) if complete else F.avg("value")
    means = dense.groupBy(*DATE, "design_cell").agg(mean.alias("m"))
    if weights is None:
        share = F.lit(1.0) / F.count("*").over(W.partitionBy(*DATE))
        means = means.withColumn("w", share)
    else:
        means = means.join(_cell_weights(design, weights), ["series_id", "design_cell"])
    every = F.count("m") == F.count("*")
    sd = F.when(F.count("*") > 1, F.when(F.count("m") > 1, F.stddev_samp("m"))).otherwise(F.lit(0.0))
    return means.groupBy(*DATE).agg(F.when(every, F.sum(F.col("w") * F.col("m"))).alias("value"), sd.alias("between_cell_sd"), F.count("m").alias("n_design_cells_available"), every.alias("complete_cell_coverage"))


def _cell_weights(design: DataFrame, weights: DataFrame) -> DataFrame:
    """The share ``w`` of every cell of a series, or an error. Both tables grow with the design's cells only."""
    cells = design.select("series_id", "design_cell").distinct()
    given = weights.select("design_cell", F.col("target_weight").cast("double").alias("t"), F.lit(True).alias("given"))
    both = cells.select("series_id").distinct().crossJoin(given).join(cells.withColumn("cell", F.lit(True)), ["series_id", "design_cell"], "full")
    of = W.partitionBy("series_id")
    t, total = F.col("t"), F.sum("t").over(of)
    unusable = t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")) | (t < 0)
    wrong = F.col("given").isNull() | F.col("cell").isNull() | unusable | (F.count("*").over(W.partitionBy("series_id", "design_cell")) > 1)
    either = F.max(F.coalesce(wrong, F.lit(True))).over(of) | F.coalesce(total <= 0, F.lit(True))
    message = F.concat(F.lit("weights must match the design cells, once each, be finite and not negative, and have a positive sum; series "), F.col("series_id"))
    return both.select("series_id", "design_cell", F.when(either, F.raise_error(message).cast("double")).otherwise(t / total).alias("w"))


def median_residuals(panel: DataFrame) -> DataFrame:
    """Residuals about the cross-pull median of each date."""
    return panel.withColumn("residual", F.col("value") - F.median("value").over(W.partitionBy(*DATE)))


def candidate_bias(panel: DataFrame) -> DataFrame:
    """Each pull's mean deviation from the cross-pull median."""
    return median_residuals(panel).groupBy("series_id", "pull_id").agg(F.avg("residual").alias("candidate_bias"))


def residual_covariance(panel: DataFrame) -> DataFrame:
    """Empirical covariance, correlation and moment of residuals for every pair of pulls, on complete dates."""
    rows = complete_dates(median_residuals(panel).select(*KEY, "value", "residual")).select(*KEY, "residual")
    a, b = rows.toDF("series_id", "pull_a", "historical_date", "ra"), rows.toDF("series_id", "pull_b", "historical_date", "rb")
    return a.join(b, DATE).groupBy("series_id", "pull_a", "pull_b").agg(F.covar_samp("ra", "rb").alias("covariance"), safe_corr("ra", "rb").alias("correlation"), F.avg(F.col("ra") * F.col("rb")).alias("moment"), F.count("*").alias("n"))


def spectral_effective_count(panel: DataFrame) -> DataFrame:
    """Squared trace of the residual correlation matrix over the trace of its square, per series.

    An undefined correlation counts as 0, the diagonal as 1; null with fewer than three complete dates.
    """
    pairs = residual_covariance(panel)
    r = F.when(F.col("pull_a") == F.col("pull_b"), F.lit(1.0)).otherwise(F.coalesce("correlation", F.lit(0.0)))
    found = pairs.groupBy("series_id").agg(F.sum(F.pow(r, 2)).alias("squares"), F.count_distinct("pull_a").alias("m"), F.max("n").alias("n"))
    return found.select("series_id", F.when(F.col("n") >= 3, F.pow(F.col("m"), 2) / F.col("squares")).alias("spectral_effective_pulls"), F.col("m").alias("n_pulls"))


def ledoit_wolf_moments(panel: DataFrame) -> DataFrame:
    """Shrinkage intensity of the uncentred Ledoit-Wolf estimator, from distributed moments, per series."""
    rows = complete_dates(median_residuals(panel).select(*KEY, "value", "residual"))
    norms = rows.groupBy(*DATE).agg(F.pow(F.sum(F.pow("residual", 2)), 2).alias("fourth"), F.count("*").alias("m"))
    per = norms.groupBy("series_id").agg(F.avg("fourth").alias("beta"), F.max("m").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    pairs = residual_covariance(panel)
    square = pairs.groupBy("series_id").agg(F.sum(F.pow("moment", 2)).alias("frobenius"), F.sum(F.when(F.col("pull_a") == F.col("pull_b"), F.col("moment"))).alias("trace"))
    both = per.join(square, "series_id")
    mu = F.col("trace") / F.col("p")
    delta = (F.col("frobenius") - F.col("p") * mu * mu) / F.col("p")
    noise = F.least((F.col("beta") - F.col("frobenius")) / (F.col("n") * F.col("p")), delta)
    return both.select("series_id", mu.alias("mu"), F.coalesce(ratio(F.greatest(noise, F.lit(0.0)), delta), F.lit(0.0)).alias("shrinkage"))


def kish_effective_count(weights: DataFrame) -> DataFrame:
    """One over the sum of squared weights; null if a weight is negative."""
    return weights.groupBy("series_id").agg(F.when(F.min("weight") >= 0, ratio(F.lit(1.0), F.sum(F.pow("weight", 2)))).alias("kish_effective_pulls"), F.sum("weight").alias("weight_sum"))


def weighted_consensus(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """Per date the mean with pull weights renormalised over the pulls that have a value."""
    rows = panel.join(weights.select("series_id", "pull_id", "weight"), ["series_id", "pull_id"])
    used = F.when(F.col("value").isNotNull(), F.col("weight"))
    return rows.groupBy(*DATE).agg(ratio(F.sum(used * F.col("value")), F.sum(used)).alias("value"), F.count("value").alias("n_available_pulls"))


def local_uncertainty(panel: DataFrame, consensus: DataFrame, base_se: float | DataFrame) -> DataFrame:
    """Per date a standard error and 95% interval: the base error by the date's relative dispersion.

    The dispersion is the median absolute deviation about the consensus; its ratio to the median over
    dates is held between 1/4 and 4, and is 1 where that median vanishes.
    """
    base = base_se if isinstance(base_se, DataFrame) else None
    c = consensus.select(*DATE, F.col("value").alias("c"))
    spread = panel.join(c, DATE).groupBy(*DATE).agg(F.median(F.abs(F.col("value") - F.col("c"))).alias("mad"), F.first("c").alias("value"))
    usual = spread.groupBy("series_id").agg(F.median("mad").alias("usual"))
    rows = spread.join(usual, "series_id")
    rows = rows.join(base, "series_id") if base is not None else rows.withColumn("base_se", F.lit(float(base_se)))
    step = F.when(F.col("usual") > 1e-12, F.least(F.greatest(ratio("mad", "usual"), F.lit(0.25)), F.lit(4.0))).otherwise(F.lit(1.0))
    se = step * F.col("base_se")
    return rows.select(*DATE, "value", step.alias("multiplier"), se.alias("standard_error"), (F.col("value") - 1.96 * se).alias("ci_lower"), (F.col("value") + 1.96 * se).alias("ci_upper"))


def propagated_calibration_se(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """Root of the summed squares of weight times calibration error, weights renormalised over usable pulls."""
    rows = panel.join(weights.select("series_id", "pull_id", "weight"), ["series_id", "pull_id"])
    usable = F.col("value").isNotNull() & F.col("calibration_se").isNotNull()
    w = F.when(usable, F.col("weight"))
    return rows.groupBy(*DATE).agg(ratio(F.sqrt(F.sum(F.pow(w * F.col("calibration_se"), 2))), F.sum(w)).alias("calibration_se"))


def innovations(panel: DataFrame) -> DataFrame:
    """Differences of log1p of neighbouring rows of a pull; the first row of each has none."""
    order = W.partitionBy("series_id", "pull_id").orderBy("historical_date")
    up = F.log1p("value")
    return panel.withColumn("innovation", up - F.lag(up).over(order)).where("innovation is not null")


def fleiss_kappa(panel: DataFrame) -> DataFrame:
    """Agreement beyond chance of pulls on which dates are positive, on complete dates, per series."""
    counts = complete_dates(panel).groupBy(*DATE).agg(F.count_if(F.col("value") > 0).cast("double").alias("ones"), F.count("*").cast("double").alias("m"))
    agree = ratio(F.pow(F.col("m") - F.col("ones"), 2) + F.pow("ones", 2) - F.col("m"), F.col("m") * (F.col("m") - 1))
    found = counts.groupBy("series_id").agg(F.avg(agree).alias("p_bar"), (F.sum("ones") / F.sum("m")).alias("p1"), F.max("m").alias("m"))
    chance = F.pow("p1", 2) + F.pow(1 - F.col("p1"), 2)
    return found.select("series_id", F.when(F.col("m") >= 2, ratio(F.col("p_bar") - chance, 1 - chance)).alias("fleiss_kappa"))


def pull_pairs(panel: DataFrame, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Both values of every pair of pulls on the dates that both have: ``pull_a < pull_b``.

    A series has few pulls, so the pairs are made within the rows of a date.
    """
    known = panel.where("value is not null")
    pairs = ordered_pairs(known, DATE, ["pull_id", *columns])
    sides = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in columns]
    return pairs.select(*DATE, F.col("a.pull_id").alias("pull_a"), F.col("b.pull_id").alias("pull_b"), *sides).where("pull_a < pull_b")


PAIR = ["series_id", "pull_a", "pull_b"]


def duplicate_residuals(panel: DataFrame) -> DataFrame:
    """Values less the cross-pull median, less the pull's mean of that difference."""
    rows = median_residuals(panel)
    return rows.withColumn("residual", F.col("residual") - F.avg("residual").over(W.partitionBy("series_id", "pull_id")))


def pair_metrics(panel: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Agreement of every pair of pulls: correlations, exact agreement, errors, and zeros."""
    pairs = pull_pairs(duplicate_residuals(panel), ("value", "residual"))
    x, y = F.col("value_a"), F.col("value_b")
    ranked = pairs.withColumn("rank_a", average_rank(PAIR, "value_a")).withColumn("rank_b", average_rank(PAIR, "value_b"))
    scale = (F.abs(x) + F.abs(y)) / 2
    term = F.when(scale <= tolerance, F.lit(0.0)).otherwise(F.try_divide(F.abs(x - y), scale))
    either = F.count_if((x > 0) | (y > 0))
    return ranked.groupBy(*PAIR).agg(
        F.count("*").alias("n_common"),
        safe_corr("value_a", "value_b", 1e-15).alias("pearson"),
        safe_corr("rank_a", "rank_b", 1e-15).alias("spearman"),
        safe_corr("residual_a", "residual_b", 1e-15).alias("residual_pearson"),
        F.avg((F.abs(x - y) <= tolerance).cast("double")).alias("exact_agreement"),
        F.avg(F.abs(x - y)).alias("mae"),
        (F.avg(F.abs(x - y)) / 100).alias("mae_100"),
        F.avg(term).alias("smape"),
        F.avg(((x > 0) == (y > 0)).cast("double")).alias("zero_nonzero_agreement"),
        F.coalesce(ratio(F.count_if((x > 0) & (y > 0)), either), F.lit(1.0)).alias("positive_jaccard"),
    )


def duplicate_pairs(panel: DataFrame, decimals: int = 10, tolerance: float = 1e-10, least_pairs: int = 30, raw_corr: float = 0.995, residual_corr: float = 0.95, exact_share: float = 0.9, mae_100: float = 0.02, jaccard: float = 0.9, use_residual: bool = True) -> DataFrame:
    """Pair metrics with the raw rule, the residual rule, and whether a pair is exact or near-duplicate."""
    digests = exact_groups(panel, decimals).select("series_id", "pull_id", "digest")
    a, b = digests.toDF("series_id", "pull_a", "digest_a"), digests.toDF("series_id", "pull_b", "digest_b")
    pairs = pair_metrics(panel, tolerance).join(a, ["series_id", "pull_a"]).join(b, ["series_id", "pull_b"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    close = yes(F.col("pearson") >= raw_corr) & ((F.col("exact_agreement") >= exact_share) | (F.col("mae_100") <= mae_100)) & (F.col("positive_jaccard") >= jaccard)
    raw = (F.col("n_common") >= least_pairs) & close
    residual = yes(F.col("residual_pearson") >= residual_corr) if use_residual else F.lit(True)
    found = pairs.withColumn("exact_vector", F.col("digest_a") == F.col("digest_b")).withColumn("raw_rule", raw).withColumn("residual_rule", residual)
    return found.withColumn("near_duplicate", F.col("exact_vector") | (F.col("raw_rule") & F.col("residual_rule"))).drop("digest_a", "digest_b")


def reliability_pairs(panel: DataFrame) -> DataFrame:
    """Level, rank and innovation correlation of every pair of pulls, and their agreement."""
    pairs = pull_pairs(panel)
    order = W.partitionBy(*PAIR).orderBy("historical_date")
    step = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) - F.lag(F.log1p(F.greatest(F.col(c), F.lit(0.0)))).over(order)
    rows = pairs.withColumn("da", step("value_a")).withColumn("db", step("value_b")).withColumn("rank_a", average_rank(PAIR, "value_a")).withColumn("rank_b", average_rank(PAIR, "value_b"))
    x, y = F.col("value_a"), F.col("value_b")
    enough = F.count("*") >= 3
    return rows.groupBy(*PAIR).agg(
        F.count("*").alias("n_common"),
        F.when(enough, safe_corr("value_a", "value_b")).alias("level_pearson"),
        F.when(enough, safe_corr("rank_a", "rank_b")).alias("level_spearman"),
        F.when(F.count("da") > 2, safe_corr("da", "db")).alias("innovation_pearson"),
        F.avg(((x > 0) == (y > 0)).cast("double")).alias("zero_nonzero_agreement"),
        F.coalesce(ratio(F.count_if((x > 0) & (y > 0)), F.count_if((x > 0) | (y > 0))), F.lit(1.0)).alias("positive_jaccard"),
        F.avg(F.abs(x - y)).alias("mae"),
        (F.avg(F.abs(x - y)) / 100).alias("mae_100"),
    )


def dependence_table(pairs: DataFrame, design: DataFrame) -> DataFrame:
    """Means of the pair metrics by whether the pulls share their day and their stream."""
    a = design.select("series_id", F.col("pull_id").alias("pull_a"), F.col("collection_day").alias("day_a"), F.col("stream_id").alias("stream_a"))
    b = design.select("series_id", F.col("pull_id").alias("pull_b"), F.col("collection_day").alias("day_b"), F.col("stream_id").alias("stream_b"))
    rows = pairs.join(a, ["series_id", "pull_a"]).join(b, ["series_id", "pull_b"])
    rows = rows.withColumn("same_day", F.col("day_a") == F.col("day_b")).withColumn("same_stream", F.col("stream_a") == F.col("stream_b"))
    means = [F.avg(c).alias(f"mean_{c}") for c in ("level_pearson", "innovation_pearson", "mae_100", "positive_jaccard")]
    return rows.groupBy("series_id", "same_day", "same_stream").agg(F.count("*").alias("n_pairs"), *means)


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Medians of the reliability metrics over pairs."""
    names = ("level_pearson", "level_spearman", "innovation_pearson", "zero_nonzero_agreement", "positive_jaccard", "mae_100")
    return pairs.groupBy("series_id").agg(F.count("*").alias("n_pairs"), *[F.median(c).alias(f"median_{c}") for c in names])


def metrics_against(estimate: DataFrame, truth: DataFrame, top_share: float = 0.05) -> DataFrame:
    """Bias, errors, correlations and peak recall of an estimate on the dates that it shares with the truth.

    Peaks are the top share of dates, at least one, by value and then date.
    """
    rows = estimate.select(*DATE, F.col("value").alias("e")).join(truth.select(*DATE, F.col("value").alias("t")), DATE).where("e is not null and t is not null")
    whole = W.partitionBy("series_id")
    order = whole.orderBy("historical_date")
    k = F.greatest(F.ceil(top_share * F.count("*").over(whole)), F.lit(1))
    top = lambda c: F.row_number().over(whole.orderBy(F.col(c).desc(), "historical_date")) <= k
    rows = rows.withColumn("de", F.col("e") - F.lag("e").over(order)).withColumn("dt", F.col("t") - F.lag("t").over(order)).withColumn("pe", top("e")).withColumn("pt", top("t"))
    d = F.col("e") - F.col("t")
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.avg(d).alias("bias"),
        F.abs(F.avg(d)).alias("absolute_bias"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        safe_corr("e", "t").alias("correlation"),
        safe_corr("de", "dt").alias("innovation_correlation"),
        ratio(F.count_if(F.col("pe") & F.col("pt")), F.count_if("pt")).alias("top_peak_recall"),
    )


def interpolated(series: DataFrame) -> DataFrame:
    """Missing values filled linearly by position between their neighbours, and from the nearest at the ends.

    One ordered window per series.
    """
    order = W.partitionBy("series_id").orderBy("historical_date")
    past, future = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    rows = series.withColumn("i", F.row_number().over(order))
    at = F.when(F.col("value").isNotNull(), F.col("i"))
    rows = rows.withColumn("i0", F.last(at, True).over(past)).withColumn("i1", F.first(at, True).over(future)).withColumn("v0", F.last("value", True).over(past)).withColumn("v1", F.first("value", True).over(future))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * F.coalesce(F.try_divide(F.col("i") - F.col("i0"), F.col("i1") - F.col("i0")), F.lit(0.0))
    return rows.withColumn("value", F.coalesce("value", between, "v0", "v1")).drop("i", "i0", "i1", "v0", "v1")


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two daily series differ: correlation, relative and absolute differences."""
    rows = a.select(*DATE, F.col("value").alias("x")).join(b.select(*DATE, F.col("value").alias("y")), DATE).where("x is not null and y is not null")
    gap = F.abs(F.col("x") - F.col("y"))
    relative = F.try_divide(gap, F.abs("y"))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"),
        safe_corr("x", "y").alias("correlation"),
        F.median(relative).alias("median_relative"),
        F.percentile(relative, F.lit(0.9)).alias("p90_relative"),
        F.max(relative).alias("max_relative"),
        F.max(gap).alias("max_absolute"),
        F.sqrt(F.avg(gap * gap)).alias("rms_absolute"),
    )


def mad_of(panel: DataFrame) -> DataFrame:
    """The robust scale of the pulls on every date."""
    rows = median_residuals(panel)
    return rows.groupBy(*DATE).agg(mad_scale(F.median(F.abs("residual"))).alias("robust_scale"))
