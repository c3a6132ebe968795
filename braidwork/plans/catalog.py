"""Registered queries of the series engine and their DuckDB counterparts.

Every query is an operator applied to the bound tables. Numbers that both engines compute are rounded
to six digits on either side (``m``, for sums of squares: to two; ``e``, where means are often halves of the sixth digit: to seven), because sums differ in their last bits with
the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import consensus as C
from ..operators import decision as D
from ..operators import diagnostics as X
from ..operators import factors as FA
from ..operators import gstudy as G
from ..operators import overlap as O
from ..operators import panel as P
from ..operators import regression as R
from ..operators import validation as V
from ..operators.windows import collection_schedule
from . import binding as T
from . import solvers as L
from .binding import duck
from .config import Protocol

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "calibrated_daily_series"

_SPARK = {"e": lambda c: (F.round(F.col(c).cast("double"), 7) + F.lit(0.0)).alias(c), "m": lambda c: (F.round(F.col(c).cast("double"), 2) + F.lit(0.0)).alias(c), "d": lambda c: (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c), "i": lambda c: F.col(c).cast("long").alias(c), "b": lambda c: F.col(c).cast("boolean").alias(c), "t": lambda c: F.col(c).cast("date").alias(c), "s": lambda c: F.col(c).cast("string").alias(c)}
_DUCK = {"e": "round(cast({0} as double), 7) + 0.0 as {0}", "m": "round(cast({0} as double), 2) + 0.0 as {0}", "d": "round(cast({0} as double), 6) + 0.0 as {0}", "i": "cast({0} as bigint) as {0}", "b": "cast({0} as boolean) as {0}", "t": "cast({0} as date) as {0}", "s": "cast({0} as varchar) as {0}"}


def _query(name: str, columns: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a query; ``columns`` lists its columns with their kinds, as in ``d:value``."""
    kinds = [c.split(":") for c in columns.split()]

    def add(run):
        QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).select(*[_SPARK[k](c) for k, c in kinds])
        if sql is not None:
            ORACLE_SQL[name] = f"select {', '.join(_DUCK[k].format(c) for k, c in kinds)} from ({duck(sql, *tables)})"
        return run

    return add


PULL_DATE = "s:pull_id t:historical_date"
EDGE = "s:pull_id s:chunk_i s:chunk_j"

# ---- windows, raw chunks, validation and audit


@_query("chunk_windows", "s:chunk_id t:window_start t:window_end", "select * from windows", ("windows",))
def _(spark, d):
    return T.windows(spark, d)


@_query("raw_chunks", "s:pull_id s:chunk_id t:historical_date d:value i:collection_day s:stream_id t:window_start t:window_end", "select * from raw", ("raw",))
def _(spark, d):
    return T.raw(spark, d)


@_query("complete_panel", PULL_DATE + " d:value i:collection_day s:stream_id", "select * from panel", ("panel",))
def _(spark, d):
    return P.assert_unique(T.panel(spark, d))


_DIRTY = """select series_id, pull_id, chunk_id,
  case when chunk_id = 'C0003' and day(historical_date) = 15 then 'bad' else cast(historical_date as {text}) end as historical_date,
  case when day(historical_date) = 10 then 'n/a' when day(historical_date) = 11 then '150' when day(historical_date) = 12 then null else cast(cast(value as int) as {text}) end as value,
  collection_day, stream_id, replicate_id, window_start,
  case when chunk_id = 'C0004' then cast(window_start as date) + 170 else window_end end as window_end, day(historical_date) = 20 as is_partial
  from raw {more}"""
_DIRTY_DUCK = _DIRTY.format(text="varchar", more="union all select series_id, pull_id, chunk_id, cast(historical_date as varchar), '1', collection_day, stream_id, replicate_id, window_start, window_end, false from raw where chunk_id = 'C0001' and pull_id = 'P002'")


def _dirty(spark, d):
    raw = T.raw(spark, d)
    day = F.dayofmonth("historical_date")
    text = lambda c: F.col(c).cast("string")
    bad = raw.withColumn("value", F.when(day == 10, "n/a").when(day == 11, "150").when(day == 12, F.lit(None)).otherwise(F.col("value").cast("int").cast("string")))
    bad = bad.withColumn("window_end", F.when(F.col("chunk_id") == "C0004", F.date_add("window_start", 170)).otherwise(F.col("window_end"))).withColumn("is_partial", day == 20)
    bad = bad.withColumn("historical_date", F.when((F.col("chunk_id") == "C0003") & (day == 15), "bad").otherwise(text("historical_date")))
    again = raw.where("chunk_id = 'C0001' and pull_id = 'P002'").withColumn("historical_date", text("historical_date")).withColumn("value", F.lit("1")).withColumn("is_partial", F.lit(False))
    return bad.unionByName(again)


@_query(
    "validate_raw_chunks",
    "s:severity s:code i:rows",
    f"""with dirty as ({_DIRTY_DUCK}), typed as (select *, try_cast(historical_date as date) as hd, try_cast(value as double) as v from dirty),
    found as (
      select 'error' as severity, 'invalid_historical_date' as code, count(*) filter (hd is null) as rows from typed
      union all select 'error', 'invalid_value', count(*) filter (value is not null and v is null) from typed
      union all select 'warning', 'value_outside_0_100', count(*) filter (v < 0 or v > 100) from typed
      union all select 'error', 'duplicate_raw_keys', coalesce(sum(n), 0) from (select count(*) as n from dirty group by series_id, pull_id, chunk_id, historical_date having count(*) > 1)
      union all select 'error', 'date_outside_window', count(*) filter (hd < window_start or hd > window_end) from typed
      union all select 'error', 'partial_observations', count(*) filter (is_partial) from typed)
    select * from found where rows > 0""",
    ("raw",),
)
def _(spark, d):
    return V.validate_raw_chunks(_dirty(spark, d))


@_query("coerce_raw_chunks", PULL_DATE + " s:chunk_id d:value i:collection_day", f"with dirty as ({_DIRTY_DUCK}) select pull_id, chunk_id, try_cast(historical_date as date) as historical_date, try_cast(value as double) as value, collection_day from dirty", ("raw",))
def _(spark, d):
    return V.coerce_raw_chunks(_dirty(spark, d))


_DRIFT = """rows2 as (select * from raw union all select * replace ('S2' as series_id) from raw where pull_id <> 'P009' and chunk_id <> 'C0001'),
drift as (select series_id, case when chunk_id = 'C0009' and pull_id = 'P002' then 'X0009' else chunk_id end as chunk_id, pull_id, historical_date, value,
  case when series_id = 'S1' and pull_id = 'P004' and chunk_id = 'C0002' then 7 else collection_day end as collection_day, stream_id, replicate_id,
  case when pull_id = 'P005' and chunk_id = 'C0006' then window_start - 1 else window_start end as window_start, window_end
  from rows2 where not (series_id = 'S1' and pull_id = 'P003' and chunk_id in ('C0005', 'C0020')))"""


def _drift(spark, d):
    """Two series of the same pull ids, of which the second lacks a pull and a chunk, and the first has other faults."""
    rows = T.raw(spark, d)
    rows = rows.unionByName(rows.where("pull_id <> 'P009' and chunk_id <> 'C0001'").withColumn("series_id", F.lit("S2")))
    rows = rows.where("not (series_id = 'S1' and pull_id = 'P003' and chunk_id in ('C0005', 'C0020'))")
    at = lambda p, c: (F.col("pull_id") == p) & (F.col("chunk_id") == c)
    rows = rows.withColumn("collection_day", F.when(at("P004", "C0002") & (F.col("series_id") == "S1"), 7).otherwise(F.col("collection_day")))
    rows = rows.withColumn("window_start", F.when(at("P005", "C0006"), F.date_sub("window_start", 1)).otherwise(F.col("window_start")))
    return rows.withColumn("chunk_id", F.when(at("P002", "C0009"), "X0009").otherwise(F.col("chunk_id")))


@_query("audit_endpoint_drift", "s:series_id s:pull_id t:first t:last", f"with {_DRIFT} select series_id, pull_id, first, last from (select series_id, pull_id, min(historical_date) as first, max(historical_date) as last from drift group by all) cross join bounds where first <> first_day or last <> last_day", ("raw", "bounds"))
def _(spark, d):
    return V.endpoint_drift(_drift(spark, d), *T.span(spark, d))


@_query(
    "audit_chunk_drift",
    "s:chunk_id s:kind",
    f"""with {_DRIFT}, declared as (select distinct chunk_id, window_start, window_end from drift)
    select distinct chunk_id, 'unknown' as kind from declared where chunk_id not in (select chunk_id from windows)
    union all select d.chunk_id, 'moved' from declared d join windows w using (chunk_id) where d.window_start <> w.window_start or d.window_end <> w.window_end""",
    ("raw", "windows"),
)
def _(spark, d):
    return V.chunk_drift(_drift(spark, d), T.windows(spark, d))


@_query("audit_missing_chunks", "s:series_id s:pull_id s:chunk_id", f"with {_DRIFT} select p.series_id, p.pull_id, w.chunk_id from (select distinct series_id, pull_id from drift) p cross join windows w where not exists (select 1 from drift x where x.series_id = p.series_id and x.pull_id = p.pull_id and x.chunk_id = w.chunk_id)", ("raw", "windows"))
def _(spark, d):
    return V.missing_chunks(_drift(spark, d), T.windows(spark, d))


@_query("audit_ambiguous_pulls", "s:series_id s:pull_id i:collection_day s:stream_id s:replicate_id", f"with {_DRIFT} select * from (select distinct series_id, pull_id, collection_day, stream_id, replicate_id from drift) qualify count(*) over (partition by series_id, pull_id) > 1", ("raw",))
def _(spark, d):
    return V.ambiguous_pulls(_drift(spark, d))


def _schedule_protocol(spark, d):
    first, last = T.span(spark, d)
    return Protocol.model_validate({"query": {"series_id": "S1", "keyword": "quantity", "geo": "US", "historical_start": str(first), "historical_end": str(last)}, "design": {"day_offsets": [0, 1, 2, 7, 14], "streams": ["A", "B", "C"]}, "chunking": {"window_days": T.WINDOW_DAYS, "step_days": T.STEP_DAYS}})


#: Streams A, B, C on days 0, 1, 2, 7 and 14 as the balanced plan orders them, three slots, all windows.
_SCHEDULE = """with n as (select unnest(range(15)) as n), w as (select list(chunk_id order by chunk_id) as c from windows),
  p as (select n, n // 3 as day, n % 3 as turn, [0, 1, 2, 7, 14][n // 3 + 1] as day_offset, case when (n // 9) % 2 = 0 then (n // 3 + n % 3) % 3 else (n // 3 + 6 - n % 3) % 3 end as stream from n),
  x as (select p.*, last_day + day_offset::int as planned, [c[((n + case when n % 2 = 1 then len(c) - 1 - i else i end) % len(c) + 1)::int] for i in range(len(c))] as o from p cross join w cross join bounds)
  select 'P' || lpad((n + 1)::varchar, 3, '0') as pull_id, day_offset, day as collection_day, planned::date::varchar as planned_collection_date, planned::date::varchar || 'T' || ['09:00', '13:00', '17:00'][turn + 1] || ':00' as planned_start_time,
  ['A', 'B', 'C'][stream + 1] as stream_id, turn + 1 as stream_order, '1' as replicate_id, len(o) as chunk_count, '["' || array_to_string(o, '","') || '"]' as chunk_order_json from x"""


@_query("collection_schedule", "s:pull_id i:day_offset i:collection_day s:planned_collection_date s:planned_start_time s:stream_id i:stream_order s:replicate_id i:chunk_count s:chunk_order_json", _SCHEDULE, ("windows", "bounds"))
def _(spark, d):
    chunks = [r[0] for r in T.windows(spark, d).select("chunk_id").orderBy("chunk_id").collect()]  # one for each window
    return collection_schedule(spark, _schedule_protocol(spark, d), chunks, T.span(spark, d)[1])


#: Of the rows of P006 some were asked for in another place, and some under another protocol.
@_query("audit_issues", "s:severity s:code i:rows",
    f"""with {_DRIFT}, spec as (select *, case when pull_id = 'P006' and day(historical_date) < 4 then 'DE' else 'US' end as geo, pull_id = 'P006' and day(historical_date) = 9 as other from drift),
    ends as (select series_id, pull_id from spec group by all having min(historical_date) <> (select first_day from bounds) or max(historical_date) <> (select last_day from bounds)),
    declared as (select distinct chunk_id, window_start, window_end from spec),
    bad as (select distinct chunk_id, 'unknown' as kind from declared where chunk_id not in (select chunk_id from windows) union all select d.chunk_id, 'moved' from declared d join windows w using (chunk_id) where d.window_start <> w.window_start or d.window_end <> w.window_end),
    missing as (select 1 from (select distinct series_id, pull_id from spec) p cross join windows w where not exists (select 1 from spec x where x.series_id = p.series_id and x.pull_id = p.pull_id and x.chunk_id = w.chunk_id)),
    more as (select * from (select distinct series_id, pull_id, collection_day, stream_id, replicate_id from spec) qualify count(*) over (partition by series_id, pull_id) > 1),
    found as (select 'historical_window_drift' as code, (select count(*) from ends) as rows union all select 'chunk_definition_drift', (select count(*) from bad) union all select 'missing_chunks', (select count(*) from missing)
      union all select 'query_spec_drift_geo', (select count(*) from spec where geo <> 'US') union all select 'protocol_hash_mismatch', (select count(*) from spec where other) union all select 'ambiguous_pull_metadata', (select count(*) from more))
    select 'error' as severity, code, rows from found where rows > 0""", ("raw", "windows", "bounds"))  # fmt: skip
def _(spark, d):
    protocol = _schedule_protocol(spark, d)
    rows = _drift(spark, d)
    day = F.dayofmonth("historical_date")
    rows = rows.withColumn("geo", F.when((F.col("pull_id") == "P006") & (day < 4), "DE").otherwise("US")).withColumn("keyword", F.lit("quantity"))
    rows = rows.withColumn("protocol_hash", F.when((F.col("pull_id") == "P006") & (day == 9), "another").otherwise(protocol.protocol_hash()))
    return V.audit_raw_batch(spark, rows, protocol).issues


@_query(
    "audit_summary",
    "i:n_rows i:n_pulls i:n_chunks i:n_dates d:zero_share s:collection_days s:streams s:replicates",
    """select count(*) as n_rows, count(distinct pull_id) as n_pulls, count(distinct chunk_id) as n_chunks, count(distinct historical_date) as n_dates,
    avg(coalesce((value = 0)::int::double, 0)) as zero_share, string_agg(distinct collection_day::varchar, ',' order by collection_day::varchar) as collection_days,
    string_agg(distinct stream_id, ',' order by stream_id) as streams, string_agg(distinct replicate_id, ',' order by replicate_id) as replicates from raw""",
    ("raw",),
)
def _(spark, d):
    return V.batch_summary(T.raw(spark, d))


# ---- overlap graphs and calibration


def _median_edges(spark, d):
    return O.edges(T.raw(spark, d), estimator="median")


@_query("overlap_edges_median", EDGE + " d:log_ratio i:n_overlap i:n_usable", "select * from edges", ("edges",))
def _(spark, d):
    return _median_edges(spark, d)


#: Huber location of the values ``x`` of every group ``g`` of a table ``vals``: median, scale, reweighting, variance.
_HUBER = """centred as (select *, median(x) over (partition by g) as m from vals),
  start as (select g, any_value(m) as here, case when 1.4826 * median(abs(x - m)) > 1e-12 then 1.4826 * median(abs(x - m)) when stddev_samp(x) > 1e-12 then stddev_samp(x) else 0 end as spread from centred group by g),
  walk(g, here, spread, r, done) as (select g, here, spread, 0, spread = 0 from start
    union all select g, new, spread, r + 1, abs(new - here) <= 1e-8 * greatest(1, abs(here)) from
    (select g, here, spread, r, sum(w * x) / sum(w) as new from (select walk.*, v.x, least(1, 1.345 / greatest(abs(v.x - walk.here) / walk.spread, 1e-12)) as w from walk join vals v using (g) where not walk.done and walk.r < 100) group by all)),
  landed as (select g, arg_max(here, r) as here, any_value(spread) as spread from walk group by g),
  away as (select v.g, v.x, l.here, l.spread, greatest(1.4826 * median(abs(v.x - l.here)) over (partition by v.g), 1e-12) as scale from vals v join landed l using (g)),
  weighed as (select *, least(1, 1.345 / greatest(abs(x - here) / scale, 1e-12)) as w from away),
  huber as (select g, any_value(here) as location, any_value(case when spread = 0 then 0 else scale end) as scale, avg(abs(x - here)) as mean_away, count(*) as n,
    case when count(*) = 1 then null when any_value(spread) = 0 then 1e-12 else any_value(scale) ** 2 / greatest(sum(w) ** 2 / sum(w * w), 1) end as variance from weighed group by g)"""


_HEDGES = f"""with recursive vals as (select pull_id || chunk_i || chunk_j as g, d as x from pairs where d is not null), {_HUBER},
    sizes as (select pull_id, chunk_i, chunk_j, pull_id || chunk_i || chunk_j as g, count(*) as n_overlap, count(d) as n_usable from pairs group by all having count(d) >= 14),
    hedges as materialized (select pull_id, chunk_i, chunk_j, location as log_ratio, greatest(variance, 1e-6) as variance, scale as robust_scale, n_overlap, n_usable, mean_away as mean_abs_residual from sizes join huber using (g))"""


@_query("overlap_edges_huber", EDGE + " d:log_ratio d:variance d:robust_scale i:n_overlap i:n_usable d:mean_abs_residual",
    _HEDGES + " select * from hedges", ("pairs",))
def _(spark, d):
    return O.edges(T.raw(spark, d))


@_query("triangle_closure", "s:pull_id s:chunk_i s:chunk_j s:chunk_k d:closure_error", "select a.pull_id, a.chunk_i, a.chunk_j, b.chunk_j as chunk_k, a.log_ratio + b.log_ratio - c.log_ratio as closure_error from edges a join edges b on a.pull_id = b.pull_id and a.chunk_j = b.chunk_i join edges c on c.pull_id = a.pull_id and c.chunk_i = a.chunk_i and c.chunk_j = b.chunk_j", ("edges",))
def _(spark, d):
    return O.triangle_closure(_median_edges(spark, d))


@_query("sequential_stitch", "s:pull_id s:chunk_id b:joined d:log_scale", "select * from stitch", ("stitch",))
def _(spark, d):
    return O.sequential_stitch(T.raw(spark, d), _median_edges(spark, d))


def _weighted_edges(spark, d):
    return _median_edges(spark, d).withColumn("variance", F.lit(1.0) / F.col("n_usable"))


@_query("path_resistance", "s:pull_id s:chunk_id d:resistance",
    """select pull_id, chunk_id, case when max(case when before is not null and v is null then 1 else 0 end) over w = 0 then sum(coalesce(v, 0)) over w end as resistance from
    (select c.pull_id, c.chunk_id, c.before, 1.0::double / e.n_usable as v from (select pull_id, chunk_id, lag(chunk_id) over (partition by pull_id order by chunk_id) as before from (select distinct pull_id, chunk_id from raw)) c
    left join edges e on e.pull_id = c.pull_id and e.chunk_i = c.before and e.chunk_j = c.chunk_id) window w as (partition by pull_id order by chunk_id rows unbounded preceding)""", ("raw", "edges"))  # fmt: skip
def _(spark, d):
    return X.path_variance(T.raw(spark, d), _weighted_edges(spark, d))


@_query("reference_chunk", "s:pull_id s:chunk_id d:degree i:n_edges", "select pull_id, chunk_id, sum(w) as degree, count(*) as n_edges from (select pull_id, chunk_i as chunk_id, least(n_usable::double, 1e6) as w from edges union all select pull_id, chunk_j, least(n_usable::double, 1e6) from edges) group by pull_id, chunk_id qualify row_number() over (partition by pull_id order by sum(w) desc, chunk_id) = 1", ("edges",))
def _(spark, d):
    return X.reference_chunk(_weighted_edges(spark, d))


_SCALED_OBS = """obs as (select r.pull_id, r.historical_date, r.chunk_id, r.value, r.value * exp(-s.log_scale - 0.5 * v) as cv, greatest(v + 0.02, 1e-6) as lv
  from (select *, 0.001 * cast(substr(chunk_id, 2) as int) as v from raw) r join stitch s on s.pull_id = r.pull_id and s.chunk_id = r.chunk_id)"""


def _observations(spark, d):
    raw, table = T.raw(spark, d), _median_edges(spark, d).withColumn("variance", F.lit(0.02))
    scales = O.sequential_stitch(raw, table).withColumn("log_scale_variance", 0.001 * F.expr("cast(substr(chunk_id, 2) as int)"))
    return raw, O.calibrated_observations(raw, scales, table)


@_query("calibrated_observations", PULL_DATE + " s:chunk_id d:calibrated_value d:observation_log_variance", f"with {_SCALED_OBS} select pull_id, historical_date, chunk_id, cv as calibrated_value, lv as observation_log_variance from obs", ("raw", "stitch"))
def _(spark, d):
    return _observations(spark, d)[1]


_DAILY = f"""with {_SCALED_OBS}, m as (select *, sum(cv / lv) over k / sum(1 / lv) over k as mean from obs window k as (partition by pull_id, historical_date)),
  daily as (select pull_id, historical_date, any_value(mean) as value, sum(1 / lv) as prec, sum((cv - mean) ** 2 / lv) / sum(1 / lv) as spread, count(cv) as n_contributing_chunks, max(coalesce(value = 0, false)) as had_zero_chunk from m group by all)"""


@_query("daily_inverse_variance", PULL_DATE + " d:value d:calibration_se i:n_contributing_chunks b:had_zero_chunk d:normalization_factor",
    _DAILY + """, f as (select pull_id, 100 / avg(value) as f from daily group by pull_id)
    select pull_id, historical_date, value * f as value, f * sqrt(value ** 2 / prec + case when n_contributing_chunks > 1 then spread else 0 end / n_contributing_chunks) as calibration_se, n_contributing_chunks, had_zero_chunk, f as normalization_factor from daily join f using (pull_id)""", ("raw", "stitch"))  # fmt: skip
def _(spark, d):
    return O.normalized(O.daily_series(_observations(spark, d)[1]))


@_query("daily_median", PULL_DATE + " d:value d:calibration_se i:n_contributing_chunks",
    f"with {_SCALED_OBS}, a as (select *, abs(cv - median(cv) over (partition by pull_id, historical_date)) as away from obs) select pull_id, historical_date, median(cv) as value, 1.4826 * median(away) / sqrt(count(cv)) as calibration_se, count(cv) as n_contributing_chunks from a group by all", ("raw", "stitch"))
def _(spark, d):
    return O.daily_series(_observations(spark, d)[1], O.Calibration(aggregation="median"))


@_query("daily_huber", PULL_DATE + " d:value i:n_contributing_chunks",
    f"""with recursive {_SCALED_OBS}, vals as (select pull_id || historical_date::varchar as g, cv as x from obs where cv is not null), {_HUBER},
    daily as (select pull_id, historical_date, pull_id || historical_date::varchar as g, count(cv) as n_contributing_chunks from obs group by all)
    select pull_id, historical_date, location as value, n_contributing_chunks from daily join huber using (g)""", ("raw", "stitch"))  # fmt: skip
def _(spark, d):
    return O.daily_series(_observations(spark, d)[1], O.Calibration(aggregation="huber"))


@_query("zero_bookkeeping", "s:pull_id i:n_historical_dates d:mean_contributing_chunks i:n_dates_with_zero_chunk i:n_dates_zero_masked_by_aggregation d:zero_share_raw d:zero_masked_share",
    _DAILY + """, z as (select pull_id, avg((value = 0)::int::double) as zero_share_raw from raw group by pull_id)
    select pull_id, count(distinct historical_date) as n_historical_dates, avg(n_contributing_chunks) as mean_contributing_chunks, count(*) filter (had_zero_chunk) as n_dates_with_zero_chunk, count(*) filter (had_zero_chunk and value > 0) as n_dates_zero_masked_by_aggregation,
    any_value(zero_share_raw) as zero_share_raw, coalesce(count(*) filter (had_zero_chunk and value > 0) / nullif(count(*) filter (had_zero_chunk), 0), 0) as zero_masked_share from daily join z using (pull_id) group by pull_id""", ("raw", "stitch"))  # fmt: skip
def _(spark, d):
    raw, rows = _observations(spark, d)
    return O.zero_bookkeeping(raw, O.daily_series(rows))


@_query("calibrated_daily_series", PULL_DATE + " d:value d:calibration_se i:n_contributing_chunks b:had_zero_chunk", f"{_HEDGES}, {L.GRAPH}, {L.CALIBRATED}", ("pairs", "raw"))
def _(spark, d):
    return O.calibrate(T.raw(spark, d)).series


@_query("graph_scales", "s:pull_id s:chunk_id d:log_scale d:log_scale_variance s:reference_chunk", f"{_HEDGES}, {L.GRAPH} select * from scales", ("pairs",))
def _(spark, d):
    raw = T.raw(spark, d)
    return O.solve_scales(raw, O.edges(raw)).scales


@_query("graph_diagnostics", "s:pull_id b:connected i:n_nodes i:n_edges i:n_zero_dispersion_edges i:n_scale_groups d:max_log_scale_variance d:sequential_max_log_scale_variance d:weighted_edge_rmse", f"{_HEDGES}, {L.GRAPH}, {L.GRAPH_ROW}", ("pairs", "raw"))
def _(spark, d):
    raw = T.raw(spark, d)
    return O.solve_scales(raw, O.edges(raw)).diagnostics


@_query("overlap_diagnostics", EDGE + " i:n d:mean_log_ratio d:sd_log_ratio d:rounding_floor_sd d:excess_over_floor d:drift_per_100_days d:drift_se_per_100_days",
    """with u as (select *, (row_number() over (partition by pull_id, chunk_i, chunk_j order by historical_date) - 1) / 100.0::double as x, 1 / (12 * value_i ** 2) + 1 / (12 * value_j ** 2) as fl from pairs where d is not null),
    s as (select pull_id, chunk_i, chunk_j, count(*) as n, avg(d) as mean_log_ratio, stddev_samp(d) as sd_log_ratio, sqrt(avg(fl)) as rounding_floor_sd, regr_slope(d, x) as b, regr_sxx(d, x) as sxx, regr_syy(d, x) as syy from u group by all)
    select *, sd_log_ratio / rounding_floor_sd as excess_over_floor, b as drift_per_100_days, sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx) as drift_se_per_100_days from s where n >= 14""", ("pairs",))  # fmt: skip
def _(spark, d):
    return X.overlap_diagnostics(T.raw(spark, d))


@_query("residual_misscaling", "s:pull_id s:chunk_id i:n d:mean_log_residual d:se d:t",
    _DAILY + ", r as (select o.pull_id, o.chunk_id, ln(o.cv) - ln(d.value) as x from obs o join daily d using (pull_id, historical_date) where o.cv > 0 and d.value > 0) select pull_id, chunk_id, count(*) as n, avg(x) as mean_log_residual, stddev_samp(x) / sqrt(count(*)) as se, avg(x) / (stddev_samp(x) / sqrt(count(*))) as t from r group by all", ("raw", "stitch"))
def _(spark, d):
    rows = _observations(spark, d)[1]
    return X.residual_misscaling(rows, O.daily_series(rows))


# ---- panels, duplicates and reliability


def _with_copy(spark, d):
    rows = T.panel(spark, d)
    return rows.unionByName(rows.where("pull_id = 'P001'").withColumn("pull_id", F.lit("P010")))


_COPY = "copied as (select * from panel union all select series_id, 'P010' as pull_id, historical_date, value, collection_day, stream_id, replicate_id from panel where pull_id = 'P001')"


@_query("exact_groups", "s:pull_id s:representative i:multiplicity", f"with {_COPY}, v as (select pull_id, string_agg(round(value, 10)::varchar, ',' order by historical_date) as v from copied group by pull_id) select pull_id, min(pull_id) over (partition by v) as representative, count(*) over (partition by v) as multiplicity from v", ("panel",))
def _(spark, d):
    return P.exact_groups(_with_copy(spark, d))


_EXACT = f"{_COPY}, v as (select pull_id, string_agg(round(value, 10)::varchar, ',' order by historical_date) as v from copied group by pull_id), same as (select pull_id, min(pull_id) over (partition by v) as representative, count(*) over (partition by v) as multiplicity from v)"


@_query("collapse_exact", PULL_DATE + " d:value i:multiplicity", f"with {_EXACT} select pull_id, historical_date, value, multiplicity from copied join same using (pull_id) where pull_id = representative", ("panel",))
def _(spark, d):
    return P.collapse_exact(_with_copy(spark, d))


_CORR = "case when stddev_pop({0}) > 1e-15 and stddev_pop({1}) > 1e-15 then corr({0}, {1}) end"
_PAIR_SQL = f"""with {_COPY}, m as (select *, value - median(value) over (partition by historical_date) as r0 from copied), res as (select *, r0 - avg(r0) over (partition by pull_id) as r from m),
  j as (select a.pull_id as pull_a, b.pull_id as pull_b, a.value as x, b.value as y, a.r as rx, b.r as ry from res a join res b on a.historical_date = b.historical_date and a.pull_id < b.pull_id),
  k as (select *, rank() over (partition by pull_a, pull_b order by x) + (count(*) over (partition by pull_a, pull_b, x) - 1) / 2.0::double as kx, rank() over (partition by pull_a, pull_b order by y) + (count(*) over (partition by pull_a, pull_b, y) - 1) / 2.0::double as ky from j),
  metrics as (select pull_a, pull_b, count(*) as n_common, {_CORR.format('x', 'y')} as pearson, {_CORR.format('kx', 'ky')} as spearman, {_CORR.format('rx', 'ry')} as residual_pearson,
  avg((abs(x - y) <= 1e-10)::int::double) as exact_agreement, avg(abs(x - y)) as mae, avg(abs(x - y)) / 100 as mae_100, avg(case when (abs(x) + abs(y)) / 2 <= 1e-10 then 0 else abs(x - y) / ((abs(x) + abs(y)) / 2) end) as smape,
  avg(((x > 0) = (y > 0))::int::double) as zero_nonzero_agreement, coalesce(count(*) filter (x > 0 and y > 0) / nullif(count(*) filter (x > 0 or y > 0), 0)::double, 1) as positive_jaccard from k group by all)"""
_PAIR = "s:pull_a s:pull_b i:n_common "


@_query("pair_metrics", _PAIR + "d:pearson d:spearman d:residual_pearson d:exact_agreement d:mae d:mae_100 d:smape d:zero_nonzero_agreement d:positive_jaccard", _PAIR_SQL + " select * from metrics", ("panel",))
def _(spark, d):
    return P.pair_metrics(_with_copy(spark, d))


@_query("duplicate_pairs", "s:pull_a s:pull_b b:raw_rule b:residual_rule b:exact_vector b:near_duplicate",
    _PAIR_SQL + """, rules as (select *, n_common >= 30 and coalesce(pearson >= 0.995, false) and (exact_agreement >= 0.9 or mae_100 <= 0.02) and positive_jaccard >= 0.9 as raw_rule, coalesce(residual_pearson >= 0.95, false) as residual_rule, exact_agreement = 1 as exact_vector from metrics)
    select *, exact_vector or (raw_rule and residual_rule) as near_duplicate from rules""", ("panel",))  # fmt: skip
def _(spark, d):
    return P.duplicate_pairs(_with_copy(spark, d))


_RULES = """, rules as (select *, n_common >= 30 and coalesce(pearson >= 0.995, false) and (exact_agreement >= 0.9 or mae_100 <= 0.02) and positive_jaccard >= 0.9 as raw_rule, coalesce(residual_pearson >= 0.95, false) as residual_rule, exact_agreement = 1 as exact_vector from metrics)"""
_PARTS = f"""with recursive {_PAIR_SQL.lstrip()[5:]}{_RULES}, links as (select pull_a as a, pull_b as b from rules where exact_vector or (raw_rule and residual_rule)), both_ways as (select a, b from links union all select b, a from links),
  reach(a, b) as (select distinct pull_id, pull_id from copied union select reach.a, both_ways.b from reach join both_ways on both_ways.a = reach.b), root as (select a as pull_id, min(b) as root from reach group by a),
  parts as (select pull_id, count(*) over (partition by root) as size, count(*) over (partition by root) / count(*) over () as share, (select count(*) from both_ways where both_ways.a = root.pull_id) as degree, root from root)"""


@_query("duplicate_components", "s:pull_id i:size d:share i:degree", _PARTS + " select * from parts", ("panel",))
def _(spark, d):
    rows = _with_copy(spark, d)
    return X.duplicate_components(P.duplicate_pairs(rows), rows)


_REL = """with o as (select *, ln(1 + greatest(x, 0)) - lag(ln(1 + greatest(x, 0))) over w as dx, ln(1 + greatest(y, 0)) - lag(ln(1 + greatest(y, 0))) over w as dy,
  rank() over (partition by pull_a, pull_b order by x) + (count(*) over (partition by pull_a, pull_b, x) - 1) / 2.0::double as kx, rank() over (partition by pull_a, pull_b order by y) + (count(*) over (partition by pull_a, pull_b, y) - 1) / 2.0::double as ky
  from ppairs window w as (partition by pull_a, pull_b order by historical_date)),
  rel as (select pull_a, pull_b, count(*) as n_common, corr(x, y) as level_pearson, corr(kx, ky) as level_spearman, corr(dx, dy) as innovation_pearson, avg(((x > 0) = (y > 0))::int::double) as zero_nonzero_agreement,
  count(*) filter (x > 0 and y > 0) / count(*) filter (x > 0 or y > 0)::double as positive_jaccard, avg(abs(x - y)) as mae, avg(abs(x - y)) / 100 as mae_100 from o group by all)"""


@_query("reliability_pairs", _PAIR + "d:level_pearson d:level_spearman d:innovation_pearson d:zero_nonzero_agreement d:positive_jaccard d:mae d:mae_100", _REL + " select * from rel", ("ppairs",))
def _(spark, d):
    return P.reliability_pairs(T.panel(spark, d))


@_query("dependence_table", "b:same_day b:same_stream i:n_pairs d:mean_level_pearson d:mean_innovation_pearson d:mean_mae_100 d:mean_positive_jaccard",
    _REL + " select a.collection_day = b.collection_day as same_day, a.stream_id = b.stream_id as same_stream, count(*) as n_pairs, avg(level_pearson) as mean_level_pearson, avg(innovation_pearson) as mean_innovation_pearson, avg(mae_100) as mean_mae_100, avg(positive_jaccard) as mean_positive_jaccard from rel join pulls a on a.pull_id = pull_a join pulls b on b.pull_id = pull_b group by all", ("ppairs", "pulls"))
def _(spark, d):
    return P.dependence_table(P.reliability_pairs(T.panel(spark, d)), T.pulls(spark))


@_query("pair_summary", "i:n_pairs d:median_level_pearson d:median_level_spearman d:median_innovation_pearson d:median_mae_100", _REL + " select count(*) as n_pairs, median(level_pearson) as median_level_pearson, median(level_spearman) as median_level_spearman, median(innovation_pearson) as median_innovation_pearson, median(mae_100) as median_mae_100 from rel", ("ppairs",))
def _(spark, d):
    return P.pair_summary(P.reliability_pairs(T.panel(spark, d)))


@_query("fleiss_kappa", "d:fleiss_kappa",
    "with c as (select historical_date, count(*) filter (value > 0)::double as k, count(*)::double as m from panel group by all), s as (select avg(((m - k) ** 2 + k ** 2 - m) / (m * (m - 1))) as pb, sum(k) / sum(m) as p1 from c) select (pb - (p1 ** 2 + (1 - p1) ** 2)) / (1 - (p1 ** 2 + (1 - p1) ** 2)) as fleiss_kappa from s", ("panel",))
def _(spark, d):
    return P.fleiss_kappa(T.panel(spark, d))


@_query("cross_pull_median", "t:historical_date d:median_value i:n_pulls", "select historical_date, median(value) as median_value, count(value) as n_pulls from panel group by all", ("panel",))
def _(spark, d):
    return P.cross_pull_median(T.panel(spark, d))


@_query("innovations", PULL_DATE + " d:innovation", "select * from inno", ("inno",))
def _(spark, d):
    return P.innovations(T.panel(spark, d))


def _gappy(spark, d):
    hole = (F.dayofmonth("historical_date") == 5) & (F.col("pull_id") == "P002") | (F.dayofmonth("historical_date") == 1) & (F.col("pull_id") == "P007")
    return T.panel(spark, d).withColumn("value", F.when(~hole, F.col("value")))


_GAPPY = "gappy as (select * replace (case when (day(historical_date) = 5 and pull_id = 'P002') or (day(historical_date) = 1 and pull_id = 'P007') then null else value end as value) from panel)"


@_query("complete_dates", PULL_DATE + " d:value", f"with {_GAPPY} select * from gappy qualify count(value) over (partition by historical_date) = 9", ("panel",))
def _(spark, d):
    return P.complete_dates(_gappy(spark, d).select(*P.KEY, "value"))


@_query("balanced_dates", PULL_DATE + " d:value", f"with {_GAPPY} select * from (select * from gappy where value is not null) qualify count(*) over (partition by historical_date) = 9", ("panel",))
def _(spark, d):
    return P.balanced_dates(_gappy(spark, d).where("value is not null"))


@_query("finite_share", "s:pull_id d:finite_share b:kept", f"with {_GAPPY} select pull_id, avg((value is not null)::int::double) as finite_share, avg((value is not null)::int::double) >= 0.97 as kept from gappy group by all", ("panel",))
def _(spark, d):
    return P.finite_share(_gappy(spark, d).select(*P.KEY, "value"), 0.97)


@_query("zero_share_screen", "s:series_id d:zero_share b:kept", "select pull_id as series_id, avg((abs(value) <= 1e-12)::int::double) as zero_share, avg((abs(value) <= 1e-12)::int::double) <= 0.05 as kept from panel group by all", ("panel",))
def _(spark, d):
    return P.zero_share_screen(T.panel(spark, d).withColumn("series_id", F.col("pull_id")), 0.05)


@_query("interpolated_series", "t:historical_date d:value",
    """with s as (select historical_date, case when day(historical_date) in (1, 2, 3, 17) then null else avg(value) end as value from panel group by historical_date), n as (select *, row_number() over (order by historical_date) as i from s),
    w as (select *, last_value(case when value is not null then i end ignore nulls) over p as i0, last_value(value ignore nulls) over p as v0, first_value(case when value is not null then i end ignore nulls) over f as i1, first_value(value ignore nulls) over f as v1 from n
    window p as (order by i rows unbounded preceding), f as (order by i rows between current row and unbounded following))
    select historical_date, coalesce(value, v0 + (v1 - v0) * ((i - i0) / nullif(i1 - i0, 0)::double), v0, v1) as value from w""", ("panel",))  # fmt: skip
def _(spark, d):
    rows = T.panel(spark, d).groupBy(*P.DATE).agg(F.avg("value").alias("value"))
    return P.interpolated(rows.withColumn("value", F.when(~F.dayofmonth("historical_date").isin(1, 2, 3, 17), F.col("value"))))


# ---- consensus

_DW = """with c as (select historical_date, collection_day || '|' || stream_id as cell, avg(value) as m from scaled group by all)
  select historical_date, avg(m) as value, stddev_samp(m) as between_cell_sd, count(m) as n_design_cells_available, true as complete_cell_coverage from c group by all"""


@_query("design_weighted_consensus", "t:historical_date d:value d:between_cell_sd i:n_design_cells_available b:complete_cell_coverage", _DW, ("scaled",))
def _(spark, d):
    return P.design_weighted(T.panel(spark, d))


@_query("design_weighted_by_given_weights", "t:historical_date d:value d:between_cell_sd i:n_design_cells_available b:complete_cell_coverage",
    """with c as (select historical_date, collection_day, stream_id, avg(value) as m from scaled group by all)
  select historical_date, sum(m * (1 + collection_day)) / sum(1 + collection_day) as value, stddev_samp(m) as between_cell_sd, count(m) as n_design_cells_available, true as complete_cell_coverage from c group by all""", ("scaled",))  # fmt: skip
def _(spark, d):
    weights = T.pulls(spark).select(F.concat_ws("|", F.col("collection_day").cast("string"), "stream_id").alias("design_cell"), (1.0 + F.col("collection_day")).alias("target_weight"))
    return P.design_weighted(T.panel(spark, d), weights=weights)


@_query("candidate_bias", "s:pull_id d:candidate_bias", "select pull_id, avg(v) as candidate_bias from (select pull_id, value - median(value) over (partition by historical_date) as v from scaled) group by all", ("scaled",))
def _(spark, d):
    return P.candidate_bias(P.baseline_scaled(T.panel(spark, d)))


_RES = "with r as (select pull_id, historical_date, value - median(value) over (partition by historical_date) as r from scaled), j as (select a.pull_id as pull_a, b.pull_id as pull_b, a.r as x, b.r as y from r a join r b using (historical_date)), m as (select pull_a, pull_b, covar_samp(x, y) as covariance, corr(x, y) as correlation, avg(x * y) as moment, count(*) as n from j group by all)"


def _scaled(spark, d):
    return P.baseline_scaled(T.panel(spark, d)).select(*P.KEY, "value")


@_query("residual_covariance", "s:pull_a s:pull_b d:covariance d:correlation d:moment i:n", _RES + " select * from m", ("scaled",))
def _(spark, d):
    return P.residual_covariance(_scaled(spark, d))


@_query("spectral_effective_count", "d:spectral_effective_pulls i:n_pulls", _RES + " select count(distinct pull_a) ** 2 / sum(case when pull_a = pull_b then 1 else coalesce(correlation, 0) ** 2 end) as spectral_effective_pulls, count(distinct pull_a) as n_pulls from m", ("scaled",))
def _(spark, d):
    return P.spectral_effective_count(_scaled(spark, d))


@_query("ledoit_wolf_moments", "d:mu d:shrinkage",
    _RES + """, f as (select avg(q) as beta, 9.0::double as p, count(*)::double as n from (select sum(r * r) ** 2 as q from r group by historical_date)), t as (select sum(moment * moment) as fr, sum(case when pull_a = pull_b then moment end) as tr from m),
    z as (select tr / p as mu, (fr - p * (tr / p) ** 2) / p as delta, (beta - fr) / (n * p) as noise from f, t) select mu, greatest(least(noise, delta), 0) / delta as shrinkage from z""", ("scaled",))  # fmt: skip
def _(spark, d):
    return P.ledoit_wolf_moments(_scaled(spark, d))


def _fixed_weights(spark):
    return T.pulls(spark).select("series_id", "pull_id", ((F.col("p") + 1) / F.lit(45.0)).alias("weight"))


@_query("kish_effective_count", "d:kish_effective_pulls d:weight_sum", "select 1 / sum(((p + 1) / 45.0::double) ** 2) as kish_effective_pulls, sum((p + 1) / 45.0::double) as weight_sum from pulls", ("pulls",))
def _(spark, d):
    return P.kish_effective_count(_fixed_weights(spark))


_CONS = f"with {_GAPPY}, c as (select historical_date, sum((p + 1) / 45.0::double * value) / sum(case when value is not null then (p + 1) / 45.0::double end) as value, count(value) as n_available_pulls from gappy join pulls using (pull_id) group by all)"


@_query("weighted_consensus", "t:historical_date d:value i:n_available_pulls", _CONS + " select * from c", ("panel", "pulls"))
def _(spark, d):
    return P.weighted_consensus(_gappy(spark, d), _fixed_weights(spark))


@_query("local_uncertainty", "t:historical_date d:multiplier d:standard_error d:ci_lower d:ci_upper",
    _CONS + """, s as (select g.historical_date, any_value(c.value) as v, median(abs(g.value - c.value)) as mad from gappy g join c using (historical_date) group by all), u as (select median(mad) as u from s),
    k as (select historical_date, v, case when u > 1e-12 then least(greatest(mad / u, 0.25), 4) else 1 end as multiplier from s, u) select historical_date, multiplier, 2 * multiplier as standard_error, v - 1.96 * 2 * multiplier as ci_lower, v + 1.96 * 2 * multiplier as ci_upper from k""", ("panel", "pulls"))  # fmt: skip
def _(spark, d):
    rows = _gappy(spark, d)
    return P.local_uncertainty(rows, P.weighted_consensus(rows, _fixed_weights(spark)), 2.0)


@_query("propagated_calibration_se", "t:historical_date d:calibration_se", f"with {_GAPPY} select historical_date, sqrt(sum(((p + 1) / 45.0::double * (1 + collection_day)) ** 2)) / sum((p + 1) / 45.0::double) as calibration_se from (select g.historical_date, g.value, g.collection_day, pulls.p from gappy g join pulls using (pull_id)) where value is not null group by all", ("panel", "pulls"))
def _(spark, d):
    return P.propagated_calibration_se(_gappy(spark, d).withColumn("calibration_se", 1.0 + F.col("collection_day")), _fixed_weights(spark))


_ALL_PULLS = "members as (select 'all' as g, pull_id from pulls)"
_IN_ORDER = "ranked as (select pull_id, row_number() over (order by collection_day, stream_id, replicate_id, pull_id) as r from pulls)"


@_query("gls_consensus", "t:historical_date d:value d:standard_error d:ci_lower d:ci_upper",
    f"""with recursive {_ALL_PULLS}, {L.WEIGHTS}, away as (select historical_date, any_value(c) as value, median(abs(value - c)) as mad from residuals join fit using (g, historical_date) group by historical_date), usual as (select median(mad) as u from away),
    errors as (select historical_date, value, (select any_value(base_se) from best) * case when u > 1e-12 then least(greatest(mad / u, 0.25), 4) else 1 end as standard_error from away, usual)
    select *, value - 1.96 * standard_error as ci_lower, value + 1.96 * standard_error as ci_upper from errors""", ("scaled", "pulls"))  # fmt: skip
def _(spark, d):
    return C.gls_consensus(T.panel(spark, d)).series


@_query("gls_weights", "s:pull_id d:weight d:base_se d:spectral_effective_pulls d:kish_effective_pulls i:n_unique_pulls b:feasible",
    f"with recursive {_EXACT}, members as (select distinct 'all' as g, representative as pull_id from same), {L.WEIGHTS} select pull_id, w as weight, base_se, spectral as spectral_effective_pulls, 1 / sum(w * w) over () as kish_effective_pulls, count(*) over () as n_unique_pulls, true as feasible from best join shrink using (g)", ("panel", "scaled"))
def _(spark, d):
    return C.pull_weights(_with_copy(spark, d).select(*P.KEY, "value"))


@_query("leave_one_out", "s:left_out d:mae d:mae_100 d:max_change",
    f"with recursive members as (select a.pull_id as g, b.pull_id from pulls a join pulls b on a.pull_id <> b.pull_id union all select 'all', pull_id from pulls), {L.WEIGHTS}, gaps as (select a.g, abs(a.c - b.c) as d from fit a join fit b using (historical_date) where b.g = 'all' and a.g <> 'all') select g as left_out, avg(d) as mae, avg(d) / 100 as mae_100, max(d) as max_change from gaps group by g", ("scaled", "pulls"))
def _(spark, d):
    rows = T.panel(spark, d)
    return C.leave_one_out(rows.select(*P.KEY, "value"), T.pulls(spark))


@_query("consensus_convergence", "i:n_pulls d:mae d:mae_100 d:max_change",
    f"with recursive {_IN_ORDER}, members as (select n::varchar as g, pull_id from ranked join (select unnest(range(3, 10)) as n) on r <= n), {L.WEIGHTS}, gaps as (select a.g, abs(a.c - b.c) as d from fit a join fit b on a.historical_date = b.historical_date and b.g::int = a.g::int - 1) select g::int as n_pulls, avg(d) as mae, avg(d) / 100 as mae_100, max(d) as max_change from gaps group by g", ("scaled", "pulls"))
def _(spark, d):
    rows = T.panel(spark, d)
    return C.convergence(rows.select(*P.KEY, "value"), T.pulls(spark))


# ---- generalizability

_CELLS = {
    "level": "select historical_date as t, collection_day as d, stream_id as s, value as x from panel",
    "detection": "select historical_date as t, collection_day as d, stream_id as s, (value > 0)::int::double as x from panel",
    "innovation": "select historical_date as t, collection_day as d, stream_id as s, innovation as x from inno",
}
_ANOVA = """with cell as ({0}), m as (select *, avg(x) over () as g, avg(x) over (partition by t) as mt, avg(x) over (partition by d) as md, avg(x) over (partition by s) as ms, avg(x) over (partition by t, d) as mtd, avg(x) over (partition by t, s) as mts, avg(x) over (partition by d, s) as mds from cell),
  n as (select count(distinct t) - 1 as a, count(distinct d) - 1 as b, count(distinct s) - 1 as c from cell),
  ss as (select sum((mt - g) ** 2) as T, sum((md - g) ** 2) as D, sum((ms - g) ** 2) as S, sum((mtd - mt - md + g) ** 2) as TD, sum((mts - mt - ms + g) ** 2) as TS, sum((mds - md - ms + g) ** 2) as DS, sum((x - mtd - mts - mds + mt + md + ms - g) ** 2) as TDS from m),
  q as (select 'T' as source, ss.T as sum_sq, a as df from ss, n union all select 'D', ss.D, b from ss, n union all select 'S', ss.S, c from ss, n union all select 'TD', ss.TD, a * b from ss, n union all select 'TS', ss.TS, a * c from ss, n
    union all select 'DS', ss.DS, b * c from ss, n union all select 'TDS', ss.TDS, a * b * c from ss, n union all select 'E', 0, 0),
  anova as (select source, sum_sq, df, case when source = 'E' then 0 else sum_sq / nullif(df, 0) end as mean_sq from q),
  w as (select max(mean_sq) filter (source = 'T') as T, max(mean_sq) filter (source = 'D') as D, max(mean_sq) filter (source = 'S') as S, max(mean_sq) filter (source = 'TD') as TD, max(mean_sq) filter (source = 'TS') as TS, max(mean_sq) filter (source = 'DS') as DS, max(mean_sq) filter (source = 'TDS') as TDS from anova),
  raw_c as (select 'T' as component, (w.T - w.TD - w.TS + w.TDS) / 9 as v from w union all select 'D', (w.D - w.TD - w.DS + w.TDS) / (3 * (a + 1)) from w, n union all select 'S', (w.S - w.TS - w.DS + w.TDS) / (3 * (a + 1)) from w, n union all select 'TD', (w.TD - w.TDS) / 3 from w
    union all select 'TS', (w.TS - w.TDS) / 3 from w union all select 'DS', (w.DS - w.TDS) / (a + 1) from w, n union all select 'TDS', w.TDS from w union all select 'E', 0 from w),
  comp as (select component, v as raw_variance, greatest(v, 0) as variance, v < 0 as clipped from raw_c)"""
_DSTUDY = """, v as (select max(variance) filter (component = 'T') as t, max(variance) filter (component = 'D') as d, max(variance) filter (component = 'S') as s, max(variance) filter (component = 'TD') as td, max(variance) filter (component = 'TS') as ts, max(variance) filter (component = 'DS') as ds, max(variance) filter (component = 'TDS') as tds from comp),
  grid as (select * from (select unnest([1, 2, 3, 7]) as n_days) cross join (select unnest([1, 2, 3, 4]) as n_streams) cross join (select unnest([1, 2]) as n_replicates)),
  e as (select n_days, n_streams, n_replicates, t, td / n_days + ts / n_streams + tds / (n_days * n_streams) as rel, d / n_days + s / n_streams + ds / (n_days * n_streams) as more from v, grid)
  select n_days, n_streams, n_replicates, rel as relative_error_variance, rel + more as absolute_error_variance, t / (t + rel) as generalizability_coefficient, t / (t + rel + more) as dependability_coefficient from e"""


def _register_gstudy(kind: str) -> None:
    base, needs = _ANOVA.format(_CELLS[kind]), ("inno",) if kind == "innovation" else ("panel",)

    @_query(f"gstudy_anova_{kind}", "s:source m:sum_sq i:df d:mean_sq", base + " select * from anova", needs)
    def _(spark, d):
        return G.anova(G.transformed(T.panel(spark, d), kind))

    @_query(f"gstudy_components_{kind}", "s:component d:raw_variance d:variance b:clipped", base + " select * from comp", needs)
    def _(spark, d):
        return G.variance_components(G.anova(G.transformed(T.panel(spark, d), kind)))

    @_query(f"gstudy_dstudy_{kind}", "i:n_days i:n_streams i:n_replicates d:relative_error_variance d:absolute_error_variance d:generalizability_coefficient d:dependability_coefficient", base + _DSTUDY, needs)
    def _(spark, d):
        return G.d_study(G.variance_components(G.anova(G.transformed(T.panel(spark, d), kind))), [1, 2, 3, 7], [1, 2, 3, 4], [1, 2])


for _kind in _CELLS:
    _register_gstudy(_kind)


@_query("gstudy_bootstrap_interval", "d:ci_lower d:ci_upper", f"with {L.RESAMPLED} select quantile_cont(g, 0.025) as ci_lower, quantile_cont(g, 0.975) as ci_upper from drawn", ("panel",))
def _(spark, d):
    return G.percentile_interval(G.bootstrap(G.transformed(T.panel(spark, d), "level"), 500))


# ---- benchmarks, truth, regression, factors


def _daily(spark, d):
    rows = T.panel(spark, d)
    mean = rows.groupBy(*P.DATE).agg(F.avg("value").alias("v"))
    from pyspark.sql import Window as W

    return mean.select(*P.DATE, (100 * F.col("v") / F.avg("v").over(W.partitionBy("series_id"))).alias("value"))


_DAILY_CTE = "daily as (select series_id, historical_date, 100 * v / avg(v) over () as value from (select series_id, historical_date, avg(value) as v from panel group by all))"


@_query("aggregation_matrix", "i:period_id t:historical_date d:weight", f"with {_DAILY_CTE}, p as (select *, row_number() over (order by period_start) as period_id from months), a as (select period_id, historical_date from p join daily on historical_date between period_start and period_end) select *, 1.0 / count(*) over (partition by period_id) as weight from a", ("panel", "months"))
def _(spark, d):
    return B.aggregation_matrix(_daily(spark, d), T.months(spark, d))


def _each_pull(spark, d):
    """The pulls as series of their own on a common baseline."""
    return P.baseline_scaled(T.panel(spark, d)).select(F.col("pull_id").alias("series_id"), "historical_date", "value")


def _months(spark, d):
    """The monthly periods, once for every pull."""
    names = T.pulls(spark).select(F.col("pull_id").alias("series_id"))
    return T.months(spark, d).drop("series_id").crossJoin(F.broadcast(names))  # 9 pulls


@_query("benchmark_fit", "s:series_id t:period_start t:period_end e:value e:fitted_value e:residual e:standardized_residual",
    "select s.pull_id as series_id, period_start, period_end, any_value(m.value) as value, avg(s.value) as fitted_value, avg(s.value) - any_value(m.value) as residual, (avg(s.value) - any_value(m.value)) / 2 as standardized_residual from months m join scaled s on s.historical_date between period_start and period_end group by s.pull_id, period_start, period_end", ("months", "scaled"))
def _(spark, d):
    return B.benchmark_fit(_each_pull(spark, d), _months(spark, d))


@_query("benchmarked_series", "s:series_id t:historical_date d:preliminary_value d:value d:benchmark_correction b:clipped", f"with recursive {L.CORRECTED} select *, pull_id as series_id from corrected", ("months", "scaled"))
def _(spark, d):
    return B.corrected_series(_each_pull(spark, d), _months(spark, d))


@_query("benchmark_diagnostics", "s:series_id i:n_daily_observations i:n_benchmark_constraints d:benchmark_rmse d:mean_absolute_correction",
    f"""with recursive {L.CORRECTED}, fits as (select pull_id, m.p, avg(c.value) - any_value(m.value) as r from months2 m join corrected c on historical_date between period_start and period_end group by pull_id, m.p),
    moves as (select pull_id, count(*) as n_daily_observations, avg(abs(benchmark_correction)) as mean_absolute_correction from corrected group by pull_id) select pull_id as series_id, any_value(n_daily_observations) as n_daily_observations, count(*) as n_benchmark_constraints, sqrt(avg(r * r)) as benchmark_rmse, any_value(mean_absolute_correction) as mean_absolute_correction from fits join moves using (pull_id) group by pull_id""", ("months", "scaled"))  # fmt: skip
def _(spark, d):
    series = B.corrected_series(_each_pull(spark, d), _months(spark, d))
    return B.benchmark_diagnostics(series, B.benchmark_fit(series.select(*P.DATE, "value"), _months(spark, d)))


_METRICS = f"""with {_DAILY_CTE}, j as (select s.pull_id as series_id, s.historical_date, s.value as e, t.value as t from scaled s join daily t using (historical_date)),
  o as (select *, e - lag(e) over w as de, t - lag(t) over w as dt, row_number() over (partition by series_id order by e desc, historical_date) <= ceil(0.05 * count(*) over (partition by series_id)) as pe, row_number() over (partition by series_id order by t desc, historical_date) <= ceil(0.05 * count(*) over (partition by series_id)) as pt from j window w as (partition by series_id order by historical_date)),
  metrics as (select series_id, count(*) as n, avg(e - t) as bias, abs(avg(e - t)) as absolute_bias, avg(abs(e - t)) as mae, sqrt(avg((e - t) ** 2)) as rmse, corr(e, t) as correlation, corr(de, dt) as innovation_correlation, count(*) filter (pe and pt) / count(*) filter (pt)::double as top_peak_recall from o group by all)"""


def _pull_metrics(spark, d):
    by_pull = P.baseline_scaled(T.panel(spark, d)).select(F.col("pull_id").alias("series_id"), "historical_date", "value")
    truth = _daily(spark, d).select("historical_date", "value").crossJoin(F.broadcast(T.pulls(spark).select(F.col("pull_id").alias("series_id"))))  # 9 pulls
    return P.metrics_against(by_pull, truth)


@_query("metrics_against_truth", "s:series_id i:n d:mae d:rmse d:correlation d:innovation_correlation d:top_peak_recall", _METRICS + " select * from metrics", ("panel", "scaled"))
def _(spark, d):
    return _pull_metrics(spark, d)


def _runs(spark, d):
    design = T.pulls(spark).select(F.col("pull_id").alias("series_id"), F.concat(F.lit("E"), F.col("stream_id")).alias("estimator"), F.col("collection_day").alias("replication"))
    return _pull_metrics(spark, d).join(design, "series_id")


_RUNS = _METRICS + ", runs as (select m.*, 'E' || stream_id as estimator, collection_day as replication from metrics m join pulls on pulls.pull_id = m.series_id)"


@_query("replication_summary", "s:estimator i:replications d:mean d:median d:sd d:mcse", _RUNS + " select estimator, count(*) as replications, avg(rmse) as mean, median(rmse) as median, stddev_samp(rmse) as sd, stddev_samp(rmse) / sqrt(count(*)) as mcse from runs group by all", ("panel", "scaled", "pulls"))
def _(spark, d):
    return X.replication_summary(_runs(spark, d))


@_query("paired_comparison", "s:better s:worse i:n d:mean_difference d:t i:wins", _RUNS + ", p as (select b.rmse as b, w.rmse as w from runs b join runs w using (replication) where b.estimator = 'EA' and w.estimator = 'EB') select 'EA' as better, 'EB' as worse, count(*) as n, avg(w - b) as mean_difference, avg(w - b) / (stddev_samp(w - b) / sqrt(count(*))) as t, count(*) filter (w > b) as wins from p", ("panel", "scaled", "pulls"))
def _(spark, d):
    return X.paired_comparison(_runs(spark, d), "EA", "EB")


@_query("series_disagreement", "i:n d:correlation d:median_relative d:p90_relative d:max_relative d:max_absolute d:rms_absolute",
    "with j as (select a.value as x, b.value as y from scaled a join scaled b using (historical_date) where a.pull_id = 'P001' and b.pull_id = 'P002'), g as (select *, abs(x - y) as g, abs(x - y) / nullif(abs(y), 0) as r from j) select count(*) as n, corr(x, y) as correlation, median(r) as median_relative, quantile_cont(r, 0.9) as p90_relative, max(r) as max_relative, max(g) as max_absolute, sqrt(avg(g * g)) as rms_absolute from g", ("scaled",))
def _(spark, d):
    rows = P.baseline_scaled(T.panel(spark, d)).select("pull_id", *P.DATE, "value")
    return P.disagreement(rows.where("pull_id = 'P001'"), rows.where("pull_id = 'P002'"))


@_query("newey_west", "s:series_id d:long_run_variance i:n",
    """with g as (select pull_id, historical_date, value - avg(value) over (partition by pull_id) as d from scaled), l as (select *, lag(d, 1) over w as d1, lag(d, 2) over w as d2, lag(d, 3) over w as d3 from g window w as (partition by pull_id order by historical_date))
    select pull_id as series_id, greatest(avg(d * d) + 2 * (0.75 * sum(d * d1) + 0.5 * sum(d * d2) + 0.25 * sum(d * d3)) / count(*), 0) as long_run_variance, count(*) as n from l group by all""", ("scaled",))  # fmt: skip
def _(spark, d):
    rows = P.baseline_scaled(T.panel(spark, d))
    return R.newey_west(rows.select(F.col("pull_id").alias("series_id"), F.col("historical_date").alias("t"), F.col("value").alias("g")), 3)


@_query("weekday_f", "s:series_id d:weekday_f i:n",
    "with r as (select pull_id, value, avg(value) over (partition by pull_id, isodow(historical_date)) as dm, avg(value) over (partition by pull_id) as wm, isodow(historical_date) as k from scaled) select pull_id as series_id, ((sum((value - wm) ** 2) - sum((value - dm) ** 2)) / (count(distinct k) - 1)) / (sum((value - dm) ** 2) / (count(*) - count(distinct k))) as weekday_f, count(*) as n from r group by all", ("scaled",))
def _(spark, d):
    return FA.weekday_f(P.baseline_scaled(T.panel(spark, d)).withColumn("series_id", F.col("pull_id")))


@_query("lag_autocorrelation", "s:series_id d:autocorrelation", "select pull_id as series_id, corr(b, value) as autocorrelation from (select pull_id, value, lag(value, 7) over (partition by pull_id order by historical_date) as b from scaled) group by all", ("scaled",))
def _(spark, d):
    return FA.lag_autocorrelation(P.baseline_scaled(T.panel(spark, d)).withColumn("series_id", F.col("pull_id")))


@_query("clip_share", "s:series_id d:clip_share", "with e as (select pull_id, case extract(day from historical_date) when 3 then 4.0 when 5 then 0.25 when 6 then 0.25 else 1.0 end as se from panel) select pull_id as series_id, avg((abs(r - 0.25) <= 1e-9 + 0.25e-6 or abs(r - 4) <= 1e-9 + 4e-6)::int::double) as clip_share from (select pull_id, se / median(se) over (partition by pull_id) as r from e) group by all", ("panel",))
def _(spark, d):
    day = F.dayofmonth("historical_date")
    se = F.when(day == 3, 4.0).when(day.isin(5, 6), 0.25).otherwise(1.0)
    return FA.clip_share(T.panel(spark, d).select(F.col("pull_id").alias("series_id"), se.alias("standard_error")))


def _noisy(spark, d):
    """The daily mean on every pull, whose values have an error variance of 4."""
    rows = _each_pull(spark, d).join(_daily(spark, d).select("historical_date", F.col("value").alias("y")), "historical_date")
    return rows.select("series_id", F.col("historical_date").alias("t"), "y", F.col("value").alias("x"), F.lit(4.0).alias("sigma2"))


@_query("reliability_corrected_ols", "s:series_id d:coefficient d:standard_error d:t_value d:reliability_ratio m:denominator_uncorrected m:denominator_corrected i:n_observations",
    f"""with {_DAILY_CTE}, r as (select s.pull_id, t.historical_date, t.value - avg(t.value) over p as y, s.value - avg(s.value) over p as x, count(*) over p as n from scaled s join daily t using (historical_date) window p as (partition by s.pull_id)),
    b as (select pull_id, sum(x * x) as xx, sum(x * x) - sum((1 - 1.0::double / n) * 4) as l, sum(x * y) as xy, any_value(n) as n from r group by pull_id), g as (select pull_id, historical_date, x * (y - xy / l * x) + xy / l * (1 - 1.0::double / b.n) * 4 as g from r join b using (pull_id)),
    d as (select pull_id, historical_date, g - avg(g) over (partition by pull_id) as d from g), q as (select pull_id, d, lag(d, 1) over w as d1, lag(d, 2) over w as d2 from d window w as (partition by pull_id order by historical_date)),
    v as (select pull_id, greatest(avg(d * d) + 2 * (2 / 3.0::double * sum(d * d1) + 1 / 3.0::double * sum(d * d2)) / count(*), 0) as v from q group by pull_id)
    select pull_id as series_id, xy / l as coefficient, sqrt(v / n) / abs(l / n) as standard_error, xy / l / (sqrt(v / n) / abs(l / n)) as t_value, l / xx as reliability_ratio, xx as denominator_uncorrected, l as denominator_corrected, n as n_observations from b join v using (pull_id)""", ("panel", "scaled"))  # fmt: skip
def _(spark, d):
    return R.reliability_corrected_by_series(_noisy(spark, d), hac_lags=2)


@_query("simex_curve", "s:series_id d:lam d:mean_coefficient i:simulations",
    f"""with {_DAILY_CTE}, grid as (select lam, level, unnest(range(case when level = 0 then 1 else 200 end)) as sim from (select unnest([0.0, 0.5, 1.0, 1.5, 2.0])::double as lam, unnest(range(5)) as level)),
    h as (select lam, sim, historical_date, md5('20260727|' || level || '|' || sim || '|' || historical_date::varchar) as h, level from grid cross join daily),
    noise as (select lam, sim, historical_date, sqrt(lam * 4) * sqrt(-2 * ln((('0x' || substr(h, 1, 13))::bigint + 0.5::double) / 4503599627370496)) * cos(2 * pi() * ((('0x' || substr(h, 14, 13))::bigint + 0.5::double) / 4503599627370496)) as e from h),
    slopes as (select pull_id, lam, sim, covar_samp(s.value + e, t.value) / var_samp(s.value + e) as slope from noise join scaled s using (historical_date) join daily t using (historical_date) group by all)
    select pull_id as series_id, lam, avg(slope) as mean_coefficient, count(*) as simulations from slopes group by all""", ("panel", "scaled"))  # fmt: skip
def _(spark, d):
    return R.simex(_noisy(spark, d))


def _factor_panel(spark, d):
    rows = P.baseline_scaled(T.panel(spark, d))
    return rows.select(F.col("pull_id").alias("series_id"), "historical_date", "value", (1.0 + F.col("collection_day")).alias("error_variance"))


@_query("corrected_covariance", "s:series_a s:series_b d:covariance d:mean_error_variance d:corrected i:n",
    """with f as (select pull_id, historical_date, value / stddev_samp(value) over (partition by pull_id) as x, (1 + collection_day) / stddev_samp(value) over (partition by pull_id) ** 2 as e from scaled)
    select a.pull_id as series_a, b.pull_id as series_b, covar_samp(a.x, b.x) as covariance, case when a.pull_id = b.pull_id then avg(a.e) else 0 end as mean_error_variance, covar_samp(a.x, b.x) - case when a.pull_id = b.pull_id then avg(a.e) else 0 end as corrected, count(*) as n from f a join f b using (historical_date) group by a.pull_id, b.pull_id""", ("scaled",))  # fmt: skip
def _(spark, d):
    return FA.corrected_covariance(FA.standardized(FA.joint_panel(_factor_panel(spark, d))))


@_query("factor_loadings", "s:series_id s:factor d:loading d:attenuation_ratio",
    f"""with recursive {L.FACTORS}, kept as (select greatest(1, count(*) filter (value > (select sum(v) from mats where g = 'net' and pa = pb) / k)) as m from eigen where g = 'net' group by k),
    both_v as (select p.pull_id, p.i, net.v as v, n.rank, n.v[p.i] * sqrt(greatest(n.value, 0)) as loading, raws.v as rv, r.v[p.i] * sqrt(greatest(r.value, 0)) / sqrt(raws.v) as raw_share, first.v[p.i] * sqrt(greatest(first.value, 0)) / sqrt(net.v) as share
      from pulls9 p join mats net on net.g = 'net' and net.pa = p.pull_id and net.pb = p.pull_id join mats raws on raws.g = 'raw' and raws.pa = p.pull_id and raws.pb = p.pull_id
      cross join (select * from eigen where g = 'net') n cross join (select * from eigen where g = 'net' and rank = 1) first cross join (select * from eigen where g = 'raw' and rank = 1) r)
    select pull_id as series_id, 'F' || rank as factor, loading, case when abs(share) > 1e-12 then raw_share / share end as attenuation_ratio from both_v, kept where rank <= m""", ("scaled",))  # fmt: skip
def _(spark, d):
    return FA.error_corrected_factors(_factor_panel(spark, d), allow_indefinite=True).loadings


@_query("factor_scores", "t:historical_date s:factor d:score d:score_se",
    f"with recursive {L.FACTORS}, lead_ as (select value, v from eigen where g = 'net' and rank = 1), away as (select f.*, x - avg(x) over (partition by pull_id) as d from f) select historical_date, 'F1' as factor, sum(d * v[i]) / sqrt(greatest(any_value(value), 1e-12)) as score, sqrt(sum(e * v[i] ** 2) / greatest(any_value(value), 1e-12)) as score_se from away join pulls9 using (pull_id) cross join lead_ group by historical_date", ("scaled",))
def _(spark, d):
    return FA.error_corrected_factors(_factor_panel(spark, d), n_factors=1, allow_indefinite=True).scores


# ---- decision

_DECIDE = """with m as (select n_name as series_id, n_nationkey % 2 = 0 or n_nationkey > 15 as protocol_passed, n_nationkey <> 7 as all_connected, n_nationkey + 5 as n_unique_pulls, case when n_nationkey % 7 = 0 then null else n_nationkey / 3.0::double end as spectral, n_nationkey / 25.0::double as zero_share, 0.75 + n_nationkey / 100.0::double as level_g,
  0.9::double as innovation_g, case when n_nationkey % 5 = 0 then null else 0.7 end as kappa, 0.1::double as component_share, 0.01::double as convergence, n_nationkey / 10.0::double as srmse from nation),
  rules as (
    select series_id, 'protocol_integrity' as rule, protocol_passed as passed, true as mandatory from m union all select series_id, 'overlap_graph_connectivity', all_connected, true from m union all select series_id, 'minimum_unique_pulls', n_unique_pulls >= 12, true from m
    union all select series_id, 'effective_pull_information', spectral >= 4, true from m union all select series_id, 'zero_share', zero_share <= 0.8, true from m union all select series_id, 'level_generalizability', level_g >= 0.8, true from m
    union all select series_id, 'innovation_generalizability', innovation_g >= 0.7, true from m union all select series_id, 'detection_reliability', case when zero_share > 0 and zero_share < 1 then kappa >= 0.6 end, zero_share > 0 and zero_share < 1 from m
    union all select series_id, 'near_duplicate_concentration', component_share <= 0.5, true from m union all select series_id, 'consensus_convergence', convergence <= 0.02, true from m union all select series_id, 'frequency_consistency', srmse <= 1.5, true from m)"""


def _rules(spark, d):
    k = F.col("n_nationkey")
    rows = T.table(spark, d, "nation").select(
        F.col("n_name").alias("series_id"), ((k % 2 == 0) | (k > 15)).alias("protocol_passed"), (k != 7).alias("all_connected"), (k + 5).alias("n_unique_pulls"), F.when(k % 7 != 0, k / 3.0).alias("spectral_effective_pulls"),
        (k / 25.0).alias("zero_share"), (0.75 + k / 100.0).alias("level_g"), F.lit(0.9).alias("innovation_g"), F.when(k % 5 != 0, 0.7).alias("kappa"), F.lit(0.1).alias("component_share"), F.lit(0.01).alias("convergence_mae_100"), (k / 10.0).alias("benchmark_srmse"),
    )
    return D.decision_rules(rows)


@_query("decision_rules", "s:series_id s:rule b:passed b:mandatory", _DECIDE + " select * from rules")
def _(spark, d):
    return _rules(spark, d)


@_query("decision_status", "s:series_id s:status i:n_rules i:n_passed i:n_failed i:n_indeterminate",
    _DECIDE + " select series_id, case when count(*) filter (mandatory and not passed) > 0 then 'FAIL' when count(*) filter (mandatory and passed is null) > 0 then 'REVIEW' else 'PASS' end as status, count(*) as n_rules, count(*) filter (passed) as n_passed, count(*) filter (not passed) as n_failed, count(*) filter (passed is null) as n_indeterminate from rules group by all")
def _(spark, d):
    return D.decision_status(_rules(spark, d))


# ---- sets, peaks, vintages and paths

from ..operators import sets as SE  # noqa: E402
from ..sources.tables import monthly_keys  # noqa: E402


def _positive(spark, d, pull):
    return T.panel(spark, d).where((F.col("pull_id") == pull) & (F.col("value") > 0)).select("historical_date")


@_query("compare_keys", "t:historical_date s:side",
    "with a as (select historical_date as x from panel where pull_id = 'P001' and value > 0), b as (select historical_date as y from panel where pull_id = 'P002' and value > 0) select coalesce(x, y) as historical_date, case when x is not null and y is not null then 'both' when x is not null then 'left' else 'right' end as side from a full join b on x = y", ("panel",))
def _(spark, d):
    return SE.compare_keys(_positive(spark, d, "P001"), _positive(spark, d, "P002"), ["historical_date"])


@_query("top_peaks", "s:series_id t:historical_date d:value i:rank", "select * from (select pull_id as series_id, historical_date, value, row_number() over (partition by pull_id order by value desc, historical_date) as rank, count(*) over (partition by pull_id) as n from panel) where rank <= ceil(0.05 * n)", ("panel",))
def _(spark, d):
    return SE.top_peaks(T.panel(spark, d).withColumn("series_id", F.col("pull_id")))


@_query("abnormal_attention", "t:historical_date d:value d:anchor d:abnormal",
    f"with {_DAILY_CTE}, m as (select historical_date, value, case when count(value) over w = 28 then median(value) over w end as anchor from daily window w as (order by historical_date rows between 28 preceding and 1 preceding)) select *, case when value > 0 and anchor > 0 then ln(value) - ln(anchor) end as abnormal from m", ("panel",))
def _(spark, d):
    return SE.abnormal_attention(_daily(spark, d))


@_query("monthly_first_values", "i:month_key d:value", "select year(o_orderdate) * 100 + month(o_orderdate) as month_key, o_totalprice as value from orders qualify row_number() over (partition by year(o_orderdate) * 100 + month(o_orderdate) order by o_orderkey) = 1")
def _(spark, d):
    rows = T.table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("row_number"))
    return monthly_keys(rows, "y", "m", "v")


@_query("vintage_comparison", "i:n d:max_relative d:median_relative i:n_changed",
    f"with {_DAILY_CTE}, j as (select historical_date, value as x, round(value, 2) as y, row_number() over (order by historical_date desc) as r from daily), g as (select abs(x - y) / nullif(abs(y), 0) as g from j where r > 3) select count(*) as n, max(g) as max_relative, median(g) as median_relative, count(*) filter (g > 1e-6) as n_changed from g", ("panel",))
def _(spark, d):
    rows = _daily(spark, d)
    return X.vintage_comparison(rows, rows.withColumn("value", F.round("value", 2)))


@_query("chain_error", EDGE + " i:steps d:log_scale d:error",
    "with n as (select * from edges qualify row_number() over (partition by pull_id, chunk_i order by chunk_j) = 1) select pull_id, chunk_i, chunk_j, row_number() over w as steps, sum(log_ratio) over w as log_scale, sqrt(sum(1.0::double / n_usable) over w) as error from n window w as (partition by pull_id order by chunk_i rows unbounded preceding)", ("edges",))
def _(spark, d):
    return X.chain_error(_weighted_edges(spark, d))


@_query("duplicate_summary", "i:n_pairs i:n_exact_pairs i:n_components d:max_component_share i:max_component_size", _PARTS + " select (select count(*) from rules) as n_pairs, (select count(*) from rules where exact_vector) as n_exact_pairs, count(distinct root) as n_components, max(share) as max_component_share, max(size) as max_component_size from parts", ("panel",))
def _(spark, d):
    rows = _with_copy(spark, d)
    pairs = P.duplicate_pairs(rows)
    return X.duplicate_summary(pairs, X.duplicate_components(pairs, rows))


@_query("design_resistance", "i:n_chunks d:graph_resistance d:path_resistance d:reduction", f"with recursive {L.RESISTANCE}", ("windows",))
def _(spark, d):
    return spark.createDataFrame([X.design_resistance(T.windows(spark, d).orderBy("chunk_id").toPandas())])  # one row per window
