"""The analysis tables derived from the star schema, in Spark and as DuckDB SQL.

Nine pulls are the suppliers by their key's remainder; a pull's daily value is the quantity that its
suppliers shipped. Chunks are windows of a pull, each scaled to its own maximum and rounded.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.windows import chunk_windows

WINDOW_DAYS, STEP_DAYS, PULLS = 180, 30, 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """The first and last day on which anything was shipped; one day for an empty table."""
    day = F.col("l_shipdate").cast("date")
    row = table(spark, sf_dir, "lineitem").agg(F.min(day), F.max(day)).first()
    return (row[0], row[1]) if row[0] else (date(1970, 1, 1), date(1970, 1, 1))


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("historical_date"))


def pulls(spark: SparkSession) -> DataFrame:
    p = F.col("id")
    return spark.range(PULLS).select(
        F.lit("S1").alias("series_id"),
        F.format_string("P%03d", p + 1).alias("pull_id"),
        (p % 3).cast("int").alias("collection_day"),
        F.substring(F.lit("ABC"), (F.floor(p / 3) + 1).cast("int"), F.lit(1)).alias("stream_id"),
        F.lit("1").alias("replicate_id"),
        p.alias("p"),
    )


def panel(spark: SparkSession, sf_dir: str, dates: tuple[date, date] | None = None) -> DataFrame:
    """The complete panel: every pull on every date, with zeros where nothing was shipped."""
    day = F.col("l_shipdate").cast("date")
    sales = table(spark, sf_dir, "lineitem").where(day.isNotNull()).groupBy((F.col("l_suppkey") % PULLS).alias("p"), day.alias("historical_date")).agg(F.sum("l_quantity").alias("q"))
    grid = F.broadcast(pulls(spark)).crossJoin(F.broadcast(calendar(spark, *(dates or span(spark, sf_dir)))))  # 9 pulls on some thousand dates
    rows = grid.join(sales, ["p", "historical_date"], "left")
    return rows.select("series_id", "pull_id", "historical_date", F.coalesce("q", F.lit(0.0)).alias("value"), "collection_day", "stream_id", "replicate_id")


def windows(spark: SparkSession, sf_dir: str, dates: tuple[date, date] | None = None) -> DataFrame:
    return chunk_windows(spark, *(dates or span(spark, sf_dir)), WINDOW_DAYS, STEP_DAYS)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chunk rows: each window's values as whole hundredths of its maximum."""
    dates = span(spark, sf_dir)
    days = windows(spark, sf_dir, dates).select("chunk_id", "window_start", "window_end", F.explode(F.sequence("window_start", "window_end")).alias("historical_date"))
    rows = panel(spark, sf_dir, dates).join(F.broadcast(days), "historical_date")  # as many rows as windows have days
    top = F.max("value").over(W.partitionBy("series_id", "pull_id", "chunk_id"))
    value = F.rint(F.try_divide(100 * F.col("value"), top)).alias("value")
    return rows.select("series_id", "pull_id", "chunk_id", "historical_date", value, "collection_day", "stream_id", "replicate_id", "window_start", "window_end")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly benchmark periods of the cross-pull mean on the scale of 100."""
    rows = panel(spark, sf_dir)
    level = F.avg("value").over(W.partitionBy("series_id"))
    scaled = rows.withColumn("v", 100 * F.col("value") / level)
    by_month = scaled.groupBy("series_id", F.trunc("historical_date", "MM").alias("month"))
    return by_month.agg(F.min("historical_date").alias("period_start"), F.max("historical_date").alias("period_end"), F.avg("v").alias("value")).drop("month")


#: The same tables for DuckDB; each uses those before it.
CTES = {
    "bounds": "select min(cast(l_shipdate as date)) as first_day, max(cast(l_shipdate as date)) as last_day from lineitem",
    "days": "select cast(unnest(generate_series(first_day::timestamp, last_day::timestamp, interval 1 day)) as date) as historical_date from bounds",
    "pulls": "select 'S1' as series_id, 'P00' || (p + 1) as pull_id, (p % 3)::int as collection_day, substr('ABC', (p // 3)::int + 1, 1) as stream_id, '1' as replicate_id, p from (select unnest(range(9)) as p)",
    "sales": "select l_suppkey % 9 as p, cast(l_shipdate as date) as historical_date, sum(l_quantity) as q from lineitem group by all",
    "panel": "select series_id, pull_id, d.historical_date, coalesce(q, 0)::double as value, collection_day, stream_id, replicate_id from pulls cross join days d left join sales s on s.p = pulls.p and s.historical_date = d.historical_date",
    "offsets": f"select distinct o from (select unnest(range(0, ceil(greatest(last_day - first_day - {WINDOW_DAYS - 1}, 0) / {STEP_DAYS})::bigint)) * {STEP_DAYS} as o from bounds union all select greatest(last_day - first_day - {WINDOW_DAYS - 1}, 0) from bounds)",
    "windows": f"select 'C' || lpad(row_number() over (order by o)::varchar, 4, '0') as chunk_id, (first_day + o::int)::date as window_start, least(first_day + o::int + {WINDOW_DAYS - 1}, last_day)::date as window_end from offsets cross join bounds",
    "raw": "select series_id, pull_id, chunk_id, historical_date, round_even((100 * value / nullif(max(value) over (partition by pull_id, chunk_id), 0))::double, 0) as value, collection_day, stream_id, replicate_id, window_start, window_end from panel join windows on historical_date between window_start and window_end",
    "pairs": "select a.series_id, a.pull_id, a.chunk_id as chunk_i, b.chunk_id as chunk_j, a.historical_date, a.value as value_i, b.value as value_j, case when a.value >= 2 and b.value >= 2 then ln(a.value) - ln(b.value) end as d from raw a join raw b on a.series_id = b.series_id and a.pull_id = b.pull_id and a.historical_date = b.historical_date and a.window_start < b.window_start",
    "edges": "select series_id, pull_id, chunk_i, chunk_j, median(d) as log_ratio, count(*) as n_overlap, count(d) as n_usable from pairs group by all having count(*) >= 14 and count(d) >= 14",
    "stitch": "select series_id, pull_id, chunk_id, n is not null as joined, sum(-coalesce(log_ratio, 0)) over (partition by pull_id order by ws) as log_scale from (select c.*, e.log_ratio, e.n_overlap as n from (select series_id, pull_id, chunk_id, min(window_start) as ws, lag(chunk_id) over (partition by pull_id order by min(window_start)) as before from raw group by series_id, pull_id, chunk_id) c left join edges e on e.pull_id = c.pull_id and e.chunk_i = c.before and e.chunk_j = c.chunk_id)",
    "med": "select series_id, pull_id, historical_date, value, collection_day, stream_id, replicate_id, median(value) over (partition by historical_date) as m, value - median(value) over (partition by historical_date) as residual from panel",
    "scaled": "select series_id, pull_id, historical_date, collection_day, stream_id, replicate_id, value * (100 / avg(value) over (partition by pull_id)) as value from panel",
    "ppairs": "select a.series_id, a.pull_id as pull_a, b.pull_id as pull_b, a.historical_date, a.value as x, b.value as y from panel a join panel b on a.historical_date = b.historical_date and a.pull_id < b.pull_id",
    "inno": "select * from (select *, ln(1 + value) - lag(ln(1 + value)) over (partition by pull_id order by historical_date) as innovation from panel) where innovation is not null",
    "months": "select series_id, min(historical_date) as period_start, max(historical_date) as period_end, avg(v) as value from (select *, date_trunc('month', historical_date) as month, 100 * value / avg(value) over () as v from panel) group by series_id, month",
}
_ORDER = list(CTES)


def duck(body: str, *names: str) -> str:
    """DuckDB SQL of ``body`` with the named tables and what they use."""
    import re

    need, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in _ORDER if m != n and re.search(rf"\b(?:from|join) {m}\b", CTES[n])]
    if not need:
        return body
    head = ", ".join(f"{n} as ({CTES[n]})" for n in _ORDER if n in need)
    if body.lstrip().lower().startswith("with recursive "):
        return f"with recursive {head}, {body.lstrip()[15:]}"
    if body.lstrip().lower().startswith("with "):
        return f"with {head}, {body.lstrip()[5:]}"
    return f"with {head} {body}"
