"""Column expressions that several operators share; none of them divides by zero under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``, null where ``b`` is zero or null."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def safe_corr(x: Column | str, y: Column | str, least_sd: float = 0.0) -> Column:
    """Pearson correlation as an aggregate; null where either side has no spread beyond ``least_sd``.

    Only rows with both sides count.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.when((F.stddev_pop(x) > least_sd) & (F.stddev_pop(y) > least_sd), F.stddev_pop(x) * F.stddev_pop(y))
    return F.try_divide(F.covar_pop(x, y), spread)


def finite(c: Column | str) -> Column:
    """The value with NaN and infinities read as null, the one missing value of this package."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def mad_scale(c: Column) -> Column:
    """1.4826 times a median absolute deviation, the normal-consistent scale."""
    return F.lit(1.4826) * c


def average_rank(partition, column: str) -> Column:
    """Rank with ties at their mean rank, within the window columns ``partition``."""
    from pyspark.sql import Window as W

    ties = F.count("*").over(W.partitionBy(*partition, column))
    return F.rank().over(W.partitionBy(*partition).orderBy(column)) + (ties - 1) / F.lit(2.0)


def ordered_pairs(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """All pairs ``a``, ``b`` of the rows of a group, ``a`` first by ``fields``: columns ``by``, ``a``, ``b``.

    One shuffle, where a self-join takes two and a sort of either side. For groups that the design
    bounds only: the windows over a date, the pulls of a series.
    """
    groups = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"))
    first = groups.select(*by, "all", F.posexplode("all").alias("i", "a"))
    rest = F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))
    return first.select(*by, "a", F.explode(rest).alias("b"))
