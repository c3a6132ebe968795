"""Generalizability study of crossed date x day x stream panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from .panel import balanced_dates, innovations

KEY = ["series_id", "pull_id", "historical_date"]
CELL = ["historical_date", "collection_day", "stream_id"]
SOURCES = ("T", "D", "S", "TD", "TS", "DS", "TDS")
COMPONENTS = ("T", "D", "S", "TD", "TS", "DS", "TDS", "E")


def transformed(panel: DataFrame, kind: str) -> DataFrame:
    """The analysed value ``g`` of balanced dates: the level, whether it is positive, or its innovation."""
    if kind == "innovation":
        rows = innovations(panel).withColumnRenamed("innovation", "g")
    elif kind in ("level", "detection"):
        rows = panel.withColumn("g", F.col("value") if kind == "level" else (F.col("value") > 0).cast("double")).where("g is not null")
    else:
        raise ValueError(f"unknown transformation {kind!r}")
    return balanced_dates(rows)


def layout(rows: DataFrame) -> DataFrame:
    """Levels of every facet per group, failing unless all cells have as many replicates and none is missing."""
    cells = rows.groupBy("series_id", *CELL).agg(F.count("*").alias("r"))
    found = cells.groupBy("series_id").agg(
        F.count_distinct("historical_date").alias("a"), F.count_distinct("collection_day").alias("b"), F.count_distinct("stream_id").alias("c"), F.min("r").alias("r"), F.max("r").alias("most"), F.count("*").alias("cells")
    )
    even = F.when(F.col("r") != F.col("most"), F.raise_error(F.lit("cells differ in their number of replicates")).cast("long")).when(
        F.col("cells") != F.col("a") * F.col("b") * F.col("c"), F.raise_error(F.lit("the design is not fully crossed")).cast("long")
    )
    return found.select("series_id", "a", "b", "c", F.coalesce(even, F.col("r")).alias("r"))


def anova(rows: DataFrame) -> DataFrame:
    """Sums of squares, degrees of freedom and mean squares of all seven effects and of replicates, per series.

    Margins are window means over the cell table; a mean square without degrees of freedom is null, that
    of replicates is 0 where there is one per cell.
    """
    cell = rows.groupBy("series_id", *CELL).agg(F.avg("g").alias("x"), F.sum(F.pow("g", 2)).alias("gg"), F.count("*").alias("n"))
    over = lambda *by: F.avg("x").over(W.partitionBy("series_id", *by))
    t, d, s = CELL
    m = cell.select("*", over().alias("g0"), over(t).alias("mt"), over(d).alias("md"), over(s).alias("ms"), over(t, d).alias("mtd"), over(t, s).alias("mts"), over(d, s).alias("mds"))
    c = F.col
    parts = {
        "T": c("mt") - c("g0"),
        "D": c("md") - c("g0"),
        "S": c("ms") - c("g0"),
        "TD": c("mtd") - c("mt") - c("md") + c("g0"),
        "TS": c("mts") - c("mt") - c("ms") + c("g0"),
        "DS": c("mds") - c("md") - c("ms") + c("g0"),
        "TDS": c("x") - c("mtd") - c("mts") - c("mds") + c("mt") + c("md") + c("ms") - c("g0"),
    }
    # Summed over all cells, a margin's square counts once for every cell in it, as the formulas ask.
    sums = m.groupBy("series_id").agg(*[F.sum(F.pow(e, 2)).alias(f"ss_{k}") for k, e in parts.items()], F.first("g0").alias("grand_mean"))
    within = rows.withColumn("e", F.pow(F.col("g") - F.avg("g").over(W.partitionBy("series_id", *CELL)), 2)).groupBy("series_id").agg(F.sum("e").alias("ss_E"))
    return _mean_squares(sums.join(within, "series_id").join(layout(rows), "series_id"))


def _mean_squares(wide: DataFrame) -> DataFrame:
    """The table of effects from columns ``ss_T`` ... ``ss_E`` and the levels ``a, b, c, r`` of every series."""
    c = F.col
    a, b, k = c("a") - 1, c("b") - 1, c("c") - 1
    df = {"T": a, "D": b, "S": k, "TD": a * b, "TS": a * k, "DS": b * k, "TDS": a * b * k, "E": c("a") * c("b") * c("c") * (c("r") - 1)}
    one = lambda name: F.struct(
        F.lit(name).alias("source"),
        F.when(F.lit(name == "E") & (c("r") == 1), F.lit(0.0)).otherwise(c(f"ss_{name}")).alias("sum_sq"),
        df[name].cast("long").alias("df"),
        (F.when(c("r") == 1, F.lit(0.0)).otherwise(ratio(c("ss_E"), df["E"])) if name == "E" else ratio(c(f"ss_{name}"), df[name])).alias("mean_sq"),
    )
    effects = F.explode(F.array(*[one(n) for n in COMPONENTS]))
    return wide.select("series_id", "a", "b", "c", "r", "grand_mean", effects.alias("e")).select("series_id", "e.*", "a", "b", "c", "r", "grand_mean")


def variance_components(table: DataFrame, clip: bool = True) -> DataFrame:
    """Components by expected mean squares: ``component, raw_variance, variance, clipped`` per series."""
    wide = table.groupBy("series_id").agg(*[F.max(F.when(F.col("source") == n, F.col("mean_sq"))).alias(n) for n in COMPONENTS], *[F.max(n).alias(f"n_{n}") for n in "abcr"])
    m, a, b, c, r = F.col, F.col("n_a"), F.col("n_b"), F.col("n_c"), F.col("n_r")
    raw = {
        "T": (m("T") - m("TD") - m("TS") + m("TDS")) / (b * c),
        "D": (m("D") - m("TD") - m("DS") + m("TDS")) / (a * c),
        "S": (m("S") - m("TS") - m("DS") + m("TDS")) / (a * b),
        "TD": (m("TD") - m("TDS")) / c,
        "TS": (m("TS") - m("TDS")) / b,
        "DS": (m("DS") - m("TDS")) / a,
        "TDS": m("TDS") - m("E") / r,
        "E": m("E"),
    }
    rows = wide.select("series_id", F.explode(F.array(*[F.struct(F.lit(k).alias("component"), v.alias("raw_variance")) for k, v in raw.items()])).alias("x")).select("series_id", "x.*")
    kept = F.when(F.col("raw_variance").isNotNull(), F.greatest("raw_variance", F.lit(0.0))) if clip else F.col("raw_variance")
    return rows.withColumn("variance", kept).withColumn("clipped", F.lit(clip) & F.coalesce(F.col("raw_variance") < 0, F.lit(False)))


def coefficients(components: DataFrame, n_days: Column, n_streams: Column, n_replicates: Column) -> list[Column]:
    """Error variances and G and Phi coefficients from columns ``v_T`` ... ``v_E`` of a wide table."""
    v = lambda k: F.col(f"v_{k}")
    relative = v("TD") / n_days + v("TS") / n_streams + v("TDS") / (n_days * n_streams) + v("E") / (n_days * n_streams * n_replicates)
    absolute = relative + v("D") / n_days + v("S") / n_streams + v("DS") / (n_days * n_streams)
    return [
        relative.alias("relative_error_variance"),
        absolute.alias("absolute_error_variance"),
        F.when(v("T") + relative > 0, ratio(v("T"), v("T") + relative)).alias("generalizability_coefficient"),
        F.when(v("T") + absolute > 0, ratio(v("T"), v("T") + absolute)).alias("dependability_coefficient"),
    ]


def d_study(components: DataFrame, days: list[int], streams: list[int], replicates: list[int]) -> DataFrame:
    """Coefficients on the grid of numbers of days, streams and replicates, per series."""
    spark = components.sparkSession
    grid = spark.createDataFrame([(d, s, r) for d in days for s in streams for r in replicates], "n_days int, n_streams int, n_replicates int")
    wide = components.groupBy("series_id").agg(*[F.max(F.when(F.col("component") == k, F.col("variance"))).alias(f"v_{k}") for k in COMPONENTS])
    return wide.crossJoin(F.broadcast(grid)).select("series_id", "n_days", "n_streams", "n_replicates", *coefficients(wide, F.col("n_days"), F.col("n_streams"), F.col("n_replicates")))


def bootstrap(rows: DataFrame, replicates: int, block: int = 28, seed: int = 20260727, clip: bool = True) -> DataFrame:
    """Moving-block bootstrap of the G and Phi coefficients: one row per series and replicate.

    Runs of ``block`` neighbouring dates are drawn with replacement and cut to the number of dates; the
    draws are a table and all replicates are one job. A drawn date brings the squares of its own margins as
    one row; only the means of cells over dates are summed anew, so no resampled panel is sorted.
    """
    dates = rows.select("series_id", "historical_date").distinct()
    dates = dates.withColumn("at", F.row_number().over(W.partitionBy("series_id").orderBy("historical_date")) - 1).withColumn("n", F.count("*").over(W.partitionBy("series_id")))
    sizes = dates.select("series_id", "n").distinct()
    draws = sizes.crossJoin(F.broadcast(dates.sparkSession.range(replicates).withColumnRenamed("id", "draw")))
    width = F.least(F.lit(block), F.col("n"))
    draws = draws.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / width).cast("int") - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "series_id", F.col("draw").cast("string"), F.col("k").cast("string")))
    start = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % (F.col("n") - width + 1)  # 15 hex digits
    draws = draws.withColumn("start", start).withColumn("j", F.explode(F.sequence(F.lit(0), width.cast("int") - 1)))
    draws = draws.where(F.col("k") * width + F.col("j") < F.col("n")).select("series_id", "draw", (F.col("start") + F.col("j")).alias("at"))

    cell = rows.groupBy("series_id", *CELL).agg(F.avg("g").alias("x"), (F.var_pop("g") * F.count("*")).alias("e"))
    level = cell.groupBy("series_id").agg(F.avg("x").alias("level"))  # taken off, as squares are subtracted from squares
    cell = cell.join(level, "series_id").withColumn("x", F.col("x") - F.col("level")).join(dates.select("series_id", "historical_date", "at"), ["series_id", "historical_date"])
    mean = lambda *by: F.avg("x").over(W.partitionBy("series_id", "at", *by))
    _, day, stream = CELL
    margins = cell.select("series_id", "at", "e", mean().alias("T"), mean(day).alias("TD"), mean(stream).alias("TS"), F.col("x").alias("X"))
    square = lambda c: F.sum(F.col(c) * F.col(c)).alias(c)
    by_date = margins.groupBy("series_id", "at").agg(*[square(c) for c in ("T", "TD", "TS", "X")], F.sum("e").alias("ss_E"))
    found = draws.join(by_date, ["series_id", "at"]).groupBy("series_id", "draw").agg(*[F.sum(c).alias(c) for c in ("T", "TD", "TS", "X", "ss_E")], F.count("*").alias("n"))
    over = lambda *by: F.avg("DS").over(W.partitionBy("series_id", "draw", *by))
    cells = draws.join(cell, ["series_id", "at"]).groupBy("series_id", "draw", day, stream).agg(F.avg("x").alias("DS"))
    cells = cells.select("series_id", "draw", "DS", over(day).alias("D"), over(stream).alias("S"), over().alias("O"))
    found = found.join(cells.groupBy("series_id", "draw").agg(*[square(c) for c in ("DS", "D", "S", "O")], F.first("O").alias("grand_mean")), ["series_id", "draw"])
    c = lambda k: F.col("n") * F.col(k) if k in ("DS", "D", "S", "O") else F.col(k)  # noqa: E731 - their cells lie on every date
    ss = {
        "T": c("T") - c("O"),
        "D": c("D") - c("O"),
        "S": c("S") - c("O"),
        "TD": c("TD") - c("T") - c("D") + c("O"),
        "TS": c("TS") - c("T") - c("S") + c("O"),
        "DS": c("DS") - c("D") - c("S") + c("O"),
        "TDS": c("X") - c("TD") - c("TS") - c("DS") + c("T") + c("D") + c("S") - c("O"),
    }
    keyed = F.concat_ws("\u0001", "series_id", F.col("draw").cast("string")).alias("series_id")
    wide = found.join(layout(rows), "series_id").select(keyed, "a", "b", "c", "r", "ss_E", "grand_mean", *[v.alias(f"ss_{k}") for k, v in ss.items()])
    parts = variance_components(_mean_squares(wide), clip)
    wide = parts.groupBy("series_id").agg(*[F.max(F.when(F.col("component") == k, F.col("variance"))).alias(f"v_{k}") for k in COMPONENTS])
    key = F.split("series_id", "\u0001")
    wide = wide.select(key[0].alias("series_id"), key[1].cast("int").alias("replicate"), *[f"v_{k}" for k in COMPONENTS]).join(layout(rows), "series_id")
    return wide.select("series_id", "replicate", *coefficients(wide, F.col("b"), F.col("c"), F.col("r"))[2:])


def percentile_interval(draws: DataFrame, column: str = "generalizability_coefficient") -> DataFrame:
    """The 2.5 and 97.5 percentiles, with linear interpolation, per series."""
    found = draws.groupBy("series_id").agg(F.percentile(column, F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return found.select("series_id", F.col("p")[0].alias("ci_lower"), F.col("p")[1].alias("ci_upper"))
