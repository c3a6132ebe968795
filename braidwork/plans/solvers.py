"""DuckDB counterparts of the operators that solve small dense systems, by other means than the engine's.

Linear systems are eliminated by recursion over the pivots, bounded weights are the best of all choices of
bounds, eigenvectors come from squaring a matrix until one direction is left, and the smooth correction
uses the closed form of the inverse of its tridiagonal matrix.
"""

from __future__ import annotations

#: Gauss-Jordan elimination of the systems ``sys(g, i, n, row)``, positive definite, with their right sides in ``row``.
SOLVED = """elim(g, i, k, n, row) as (select g, i, 1, n, row from sys
    union all select g, i, k + 1, n, case when i = k then list_transform(p, lambda x: x / p[k]) else list_transform(list_zip(row, p), lambda z: z[1] - row[k] / p[k] * z[2]) end
    from (select *, any_value(row) filter (i = k) over (partition by g) as p from elim where k <= n)),
  solved as (select g, i, n, row from elim where k = n + 1)"""

#: Huber edges ``hedges`` as a linear system, solved: ``scales`` and the reference ``ref`` of every pull. Needs ``hedges``.
GRAPH = f"""ew as (select *, least(1 / variance, 1e6) as w from hedges),
  ends as (select pull_id as g, chunk_i as c, chunk_j as o, w, w * log_ratio as s from ew union all select pull_id, chunk_j, chunk_i, w, -w * log_ratio from ew),
  degree as (select g, c, sum(w) as w, sum(s) as s from ends group by all),
  ref as (select g, c as r from degree qualify row_number() over (partition by g order by w desc, c) = 1),
  free as (select d.*, row_number() over (partition by g order by c) as i, count(*) over (partition by g) as n from degree d join ref using (g) where c <> r),
  cells as (select a.g, a.i, a.n, a.s, b.i as j, case when a.i = b.i then a.w else -coalesce(o.w, 0) end as v from free a join free b on a.g = b.g left join ends o on o.g = a.g and o.c = a.c and o.o = b.c),
  sys as (select g, i, any_value(n) as n, list_concat(list_concat(list(v order by j), [any_value(s)]), list((i = j)::int::double order by j)) as row from cells group by g, i),
  {SOLVED},
  scales as (select f.g as pull_id, f.c as chunk_id, v.row[f.n + 1] as log_scale, greatest(v.row[f.n + 1 + f.i], 0) as log_scale_variance, r as reference_chunk from free f join solved v on v.g = f.g and v.i = f.i join ref on ref.g = f.g
    union all select g, r, 0, 0, r from ref)"""

#: One row of diagnostics per pull from ``scales`` and ``hedges``.
GRAPH_ROW = """nodes as (select distinct pull_id, chunk_id from raw),
  found(g, c) as (select g, r from ref union select f.g, e.o from found f join ends e on e.g = f.g and e.c = f.c),
  flat as (select pull_id as g, chunk_i as a, chunk_j as b from hedges where robust_scale = 0 union all select pull_id, chunk_j, chunk_i from hedges where robust_scale = 0),
  level(g, a, b) as (select pull_id, chunk_id, chunk_id from nodes union select l.g, l.a, f.b from level l join flat f on f.g = l.g and f.a = l.b),
  roots as (select g, count(distinct root) as n_scale_groups from (select g, a, min(b) as root from level group by all) group by g),
  steps as (select n.pull_id, n.chunk_id, lag(n.chunk_id) over (partition by n.pull_id order by n.chunk_id) as before from nodes n),
  path as (select s.pull_id, s.chunk_id, sum(coalesce(e.variance, 0)) over (partition by s.pull_id order by s.chunk_id) as total, count(*) filter (before is not null and e.variance is null) over (partition by s.pull_id) as holes from steps s left join hedges e on e.pull_id = s.pull_id and e.chunk_i = s.before and e.chunk_j = s.chunk_id),
  along as (select p.pull_id, case when any_value(p.holes) = 0 then max(abs(p.total - q.total)) end as sequential_max_log_scale_variance from path p join ref on ref.g = p.pull_id join path q on q.pull_id = p.pull_id and q.chunk_id = ref.r group by p.pull_id),
  fits as (select e.pull_id, count(*) as n_edges, count(*) filter (robust_scale = 0) as n_zero_dispersion_edges, sqrt(sum(w * (log_ratio - (a.log_scale - b.log_scale)) ** 2) / sum(w)) as weighted_edge_rmse from ew e join scales a on a.pull_id = e.pull_id and a.chunk_id = e.chunk_i join scales b on b.pull_id = e.pull_id and b.chunk_id = e.chunk_j group by e.pull_id)
  select pull_id, (select count(*) from found where found.g = fits.pull_id) = (select count(*) from nodes where nodes.pull_id = fits.pull_id) as connected, (select count(*) from found where found.g = fits.pull_id) as n_nodes, n_edges, n_zero_dispersion_edges, n_scale_groups,
    (select max(log_scale_variance) from scales where scales.pull_id = fits.pull_id) as max_log_scale_variance, sequential_max_log_scale_variance, weighted_edge_rmse from fits join roots on roots.g = fits.pull_id join along using (pull_id)"""

#: The flagship: the chunks of a date weighed by their precision, and every pull's mean made 100.
CALIBRATED = """typical as (select pull_id, median(variance) as tv from hedges group by all),
  obs as (select pull_id, historical_date, value, value * exp(-log_scale - 0.5 * log_scale_variance) as cv, case when value is not null then 1 / greatest(log_scale_variance + tv, 1e-6) end as w from raw join scales using (pull_id, chunk_id) join typical using (pull_id)),
  around as (select *, sum(w * cv) over k / sum(w) over k as mean from obs window k as (partition by pull_id, historical_date)),
  daily as (select pull_id, historical_date, any_value(mean) as v, sum(w) as precision, sum(w * (cv - mean) ** 2) / sum(w) as spread, count(cv) as n_contributing_chunks, coalesce(max((value = 0)::int), 0) = 1 as had_zero_chunk from around group by all),
  factor as (select pull_id, 100 / avg(v) as f from daily group by all)
  select pull_id, historical_date, v * f as value, f * sqrt(v ** 2 / precision + case when n_contributing_chunks > 1 then spread else 0 end / n_contributing_chunks) as calibration_se, n_contributing_chunks, had_zero_chunk from daily join factor using (pull_id)"""

#: Bounded minimum-variance weights ``best(g, pull_id, w, base_se)`` of the subsets ``members(g, pull_id)`` of the pulls.
#: Of all choices of pulls at 0 and at the cap of a half, the best whose other weights keep the bounds is the optimum.
WEIGHTS = f"""idx as (select g, pull_id, row_number() over (partition by g order by pull_id) as i, count(*) over (partition by g) as p from members),
  residuals as (select idx.g, i, p, historical_date, value, value - median(value) over (partition by idx.g, historical_date) as r from scaled join idx using (pull_id)),
  moments as (select a.g, a.i, b.i as j, any_value(a.p) as p, count(*) as n, avg(a.r * b.r) as m, case when a.i = b.i then 1 else coalesce(corr(a.r, b.r), 0) end as c from residuals a join residuals b on a.g = b.g and a.historical_date = b.historical_date group by a.g, a.i, b.i),
  squares as (select g, avg(q) as beta from (select g, sum(r * r) ** 2 as q from residuals group by g, historical_date) group by g),
  shrink as (select g, tr / p as mu, (fr - tr * tr / p) / p as delta, (beta - fr) / (n * p) as noise, spectral from (select g, any_value(p) as p, any_value(n) as n, sum(m * m) as fr, sum(case when i = j then m else 0 end) as tr, any_value(p) ** 2 / sum(c * c) as spectral from moments group by g) join squares using (g)),
  sigma as (select g, i, j, case when i = j then k * mu else 0 end + (1 - k) * m as v from moments join (select *, case when delta > 0 then least(greatest(noise, 0), delta) / delta else 0 end as k from shrink) using (g)),
  sizes3 as (select g, any_value(p) as p from idx group by g),
  codes as (select g, unnest(range((3 ** p)::bigint)) as code from sizes3),
  states as (select codes.g, code, i, (code // (3 ** (i - 1))::bigint) % 3 as state from codes join idx using (g)),
  tried as (select g, code, g || '/' || code as gc, count(*) filter (state = 2) as caps, count(*) filter (state = 1) as n from states group by all having count(*) filter (state = 2) <= 2 and count(*) filter (state = 1) > 0),
  loose as (select gc, s.g, s.code, i, n, row_number() over (partition by gc order by i) as f from states s join tried t on t.g = s.g and t.code = s.code where state = 1),
  sys as (select l.gc as g, any_value(l.f) as i, any_value(l.n) as n, list_concat(list(v order by s.i) filter (s.state = 1), [1.0::double, coalesce(sum(v) filter (s.state = 2), 0) / 2]) as row from loose l join states s on s.g = l.g and s.code = l.code join sigma on sigma.g = l.g and sigma.i = l.i and sigma.j = s.i group by l.gc, l.i),
  {SOLVED},
  parts as (select l.gc, l.i, row[l.n + 1] as y, row[l.n + 2] as z from loose l join solved on solved.g = l.gc and solved.i = l.f),
  price as (select gc, any_value(t.g) as g, any_value(code) as code, (1 - any_value(caps) / 2 + sum(z)) / sum(y) as lambda_ from parts join tried t using (gc) group by gc),
  weighed as (select gc, i, lambda_ * y - z as w from parts join price using (gc)),
  within as (select gc from weighed group by gc having min(w) >= -1e-12 and max(w) <= 0.5 + 1e-12),
  full_w as (select price.g, price.gc, s.i, case when state = 2 then 0.5 else coalesce(w, 0) end as w from within join price using (gc) join states s on s.g = price.g and s.code = price.code left join weighed on weighed.gc = price.gc and weighed.i = s.i),
  variances as (select a.g, a.gc, sum(a.w * b.w * v) as var from full_w a join full_w b on a.gc = b.gc join sigma on sigma.g = a.g and sigma.i = a.i and sigma.j = b.i group by all),
  chosen as (select * from variances qualify row_number() over (partition by g order by var, gc) = 1),
  best as (select idx.g, pull_id, idx.i, w / sum(w) over (partition by idx.g) as w, sqrt(var) as base_se from chosen join full_w on full_w.gc = chosen.gc join idx on idx.g = chosen.g and idx.i = full_w.i),
  fit as (select r.g, historical_date, sum(w * value) / sum(w) as c from residuals r join best on best.g = r.g and best.i = r.i group by all)"""

#: Eigenvalues and vectors of ``sym(g, c, k, b)``: matrices of k x k numbers in a list, raised by c to be positive.
EIGEN = """squared(g, c, k, b, m, rank, step, value, vv) as (select g, c, k, b, b, 1, 0, null::double, null::double[] from sym
    union all select g, c, k, case when step < 60 then b else list_transform(list_zip(b, m), lambda z: z[1] - value_ * z[2]) end,
      case when step < 60 then list_transform(prod, lambda x: x / tr) else list_transform(list_zip(b, m), lambda z: z[1] - value_ * z[2]) end,
      rank + (step = 60)::int, case when step < 60 then step + 1 else 0 end, case when step = 60 then value_ end, case when step = 60 then m end
    from (select *, list_sum(list_transform(range(k), lambda a: prod[a * k + a + 1])) as tr from
      (select *, list_sum(list_transform(list_zip(b, m), lambda z: z[1] * z[2])) as value_,
        list_transform(range(k * k), lambda t: list_dot_product(m[(t // k) * k + 1 : (t // k) * k + k], m[(t % k) * k + 1 : (t % k) * k + k])) as prod from squared where rank <= k))),
  pairs_of as (select g, k, rank - 1 as rank, value - c as value, vv, list_sort(list_transform(range(k), lambda a: [vv[a * k + a + 1], a]), 'desc')[1][2]::bigint as top from squared where vv is not null),
  directions as (select g, k, rank, value, list_transform(range(k), lambda a: vv[a * k + top + 1] / sqrt(vv[top * k + top + 1])) as v from pairs_of),
  eigen as (select g, k, rank, value, case when list_sum(v) < 0 then list_transform(v, lambda x: -x) else v end as v from directions)"""

#: Covariances of the standardised pulls, with and without their errors, and their spectra; ``pulls9`` numbers the pulls.
FACTORS = f"""f as (select pull_id, historical_date, value / stddev_samp(value) over (partition by pull_id) as x, (1 + collection_day) / stddev_samp(value) over (partition by pull_id) ** 2 as e from scaled),
  cov as (select a.pull_id as pa, b.pull_id as pb, covar_samp(a.x, b.x) as raw_v, case when a.pull_id = b.pull_id then avg(a.e) else 0 end as err from f a join f b using (historical_date) group by a.pull_id, b.pull_id),
  pulls9 as (select pull_id, row_number() over (order by pull_id) as i from (select distinct pull_id from f)),
  mats as (select 'raw' as g, pa, pb, raw_v as v from cov union all select 'net', pa, pb, raw_v - err from cov),
  bound as (select g, max(s) as c from (select g, pa, sum(abs(v)) as s from mats group by all) group by g),
  sym as (select g, any_value(c) as c, any_value((select count(*) from pulls9)) as k, list(v + case when pa = pb then c else 0 end order by pa, pb) as b from mats join bound using (g) group by g),
  {EIGEN}"""

#: Every pull with the smooth correction towards the months, misses weighed by a variance of 4.
#: ``green`` is the inverse of the matrix with 21 + 1e-8 on its diagonal (10 less at both ends) and -10 beside it.
CORRECTED = f"""z as (select pull_id, historical_date, value, dense_rank() over (order by historical_date) as t from scaled),
  spots as (select distinct historical_date, t, count(distinct t) over () as n from z),
  months2 as (select *, row_number() over (order by period_start) as p, count(*) over () as np from months),
  inside as (select p, t, 1.0::double / count(*) over (partition by p) as a from months2 join spots on historical_date between period_start and period_end),
  theta as (select acosh(1 + (1 + 1e-8) / 20) as h),
  back as (select i.p, z.t, sum(i.a * exp(-h * abs(z.t - i.t)) * (1 + exp(-h * (2 * least(z.t, i.t) - 1))) * (1 + exp(-h * (2 * (z.n - greatest(z.t, i.t)) + 1))) / (20 * sinh(h) * (1 - exp(-2 * h * z.n)))) as green from inside i cross join spots z cross join theta group by all),
  inner_ as (select i.p as p, b.p as q, sum(i.a * b.green) as v from inside i join back b on b.t = i.t group by all),
  miss as (select z.pull_id, m.p, any_value(m.np) as np, any_value(m.value) - sum(a * z.value) as miss from months2 m join inside using (p) join z using (t) group by z.pull_id, m.p),
  sys as (select pull_id as g, k.p as i, any_value(np) as n, list_concat(list(v + case when k.p = q then 4 else 0 end order by q), [any_value(miss)]) as row from inner_ k join miss on miss.p = k.p group by pull_id, k.p),
  {SOLVED},
  moved as (select g as pull_id, t, sum(green * row[n + 1]) as x from back join solved on solved.i = back.p group by all),
  corrected as (select pull_id, historical_date, value as preliminary_value, greatest(value + x, 0) as value, greatest(value + x, 0) - value as benchmark_correction, value + x < 0 as clipped from z join moved using (pull_id, t))"""

#: G coefficients ``drawn(b, g)`` of 500 block resamples of the dates: a date's squares and cells are summed over its draws.
#: 28 dates a block; three days by three streams.
RESAMPLED = """dates as (select historical_date, row_number() over (order by historical_date) - 1 as t, count(*) over () as n from (select distinct historical_date from panel)),
  cells as (select t, collection_day as d, stream_id as s, value as x from panel join dates using (historical_date)),
  by_date as (select t, sum(x) ** 2 / 9 as s_t, sum(x * x) as s_x, list(x order by d, s) as xs from cells group by t),
  by_day as (select t, sum(q) as s_td from (select t, sum(x) ** 2 / 3 as q from cells group by t, d) group by t),
  by_stream as (select t, sum(q) as s_ts from (select t, sum(x) ** 2 / 3 as q from cells group by t, s) group by t),
  size_ as (select any_value(n) as n, least(28, any_value(n)) as w from dates),
  blocks as (select b, k, n, w, ('0x' || substr(md5('20260727|S1|' || b || '|' || k), 1, 15))::bigint % (n - w + 1) as first from size_, (select unnest(range(500)) as b), (select unnest(range((select ceil(n / w)::bigint from size_))) as k)),
  drawn_t as (select b, first + j as t from (select *, unnest(range(w)) as j from blocks) where k * w + j < n),
  sums as (select b, count(*) as n, sum(s_t) as s_t, sum(s_td) as s_td, sum(s_ts) as s_ts, sum(s_x) as s_x, """ + ", ".join(f"sum(xs[{i}]) as x{i}" for i in range(1, 10)) + """ from drawn_t join by_date using (t) join by_day using (t) join by_stream using (t) group by b),
  more as (select *, ((x1 + x2 + x3) ** 2 + (x4 + x5 + x6) ** 2 + (x7 + x8 + x9) ** 2) / (3 * n) as s_d, ((x1 + x4 + x7) ** 2 + (x2 + x5 + x8) ** 2 + (x3 + x6 + x9) ** 2) / (3 * n) as s_s,
    (x1 ** 2 + x2 ** 2 + x3 ** 2 + x4 ** 2 + x5 ** 2 + x6 ** 2 + x7 ** 2 + x8 ** 2 + x9 ** 2) / n as s_ds, (x1 + x2 + x3 + x4 + x5 + x6 + x7 + x8 + x9) ** 2 / (9 * n) as s_1 from sums),
  squares as (select b, (s_t - s_1) / (n - 1) as m_t, (s_td - s_t - s_d + s_1) / (2 * (n - 1)) as m_td, (s_ts - s_t - s_s + s_1) / (2 * (n - 1)) as m_ts, (s_x - s_td - s_ts - s_ds + s_t + s_d + s_s - s_1) / (4 * (n - 1)) as m_tds from more),
  parts as (select b, greatest((m_t - m_td - m_ts + m_tds) / 9, 0) as v_t, greatest((m_td - m_tds) / 3, 0) / 3 + greatest((m_ts - m_tds) / 3, 0) / 3 + greatest(m_tds, 0) / 9 as rel from squares),
  drawn as (select b, v_t / (v_t + rel) as g from parts where v_t + rel > 0)"""

#: The largest resistance of the window layout to its middle window, on the graph and along the path.
RESISTANCE = f"""ordered as (select *, row_number() over (order by chunk_id) as o, count(*) over () // 2 + 1 as mid from windows),
  links as (select a.o as a, b.o as b, days as w from (select a.o as ao, b.o as bo, least(a.window_end, b.window_end) - greatest(a.window_start, b.window_start) + 1 as days from ordered a join ordered b on a.o <> b.o) x join ordered a on a.o = ao join ordered b on b.o = bo where days >= 14),
  sums as (select a, sum(w)::double as w from links group by a),
  free as (select o, row_number() over (order by o) as i, count(*) over () as n from ordered where o <> mid),
  cells as (select f.i, f.n, h.i as j, case when f.o = h.o then sums.w else -coalesce(l.w, 0)::double end as v from free f cross join free h join sums on sums.a = f.o left join links l on l.a = f.o and l.b = h.o),
  sys as (select 0 as g, i, any_value(n) as n, list_concat(list(v order by j), list((i = j)::int::double order by j)) as row from cells group by i),
  {SOLVED},
  steps as (select o, mid, sum(coalesce(1.0::double / l.w, 0)) over (order by o) as total from ordered left join links l on l.a = o - 1 and l.b = o),
  ends as (select (select count(*) from ordered) as n_chunks, (select max(row[n + i]) from solved) as graph_resistance, (select max(abs(s.total - m.total)) from steps s join steps m on m.o = m.mid) as path_resistance)
  select *, path_resistance / graph_resistance as reduction from ends"""
