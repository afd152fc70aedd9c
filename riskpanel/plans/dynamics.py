"""Bubble detection and cross-quantilogram queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskpanel.operators import bubbles as B
from riskpanel.operators import quantilogram as Q
from riskpanel.plans import sqltext as X
from riskpanel.plans.registry import query
from riskpanel.session import cut_lineage

R = X.panel()


def bubble_panel(m):
    """Random-walk price levels (cumulated relative prices), one of which explodes over rows 151..190."""
    w = Window.partitionBy("entity")
    step = F.col("price") / F.avg("price").over(w) - 1.0
    p = m.panel().withColumn("step", step).withColumn("price", 50.0 + F.sum("step").over(w.orderBy("idx"))).drop("step")
    inside = (F.col("entity") == "Brand#3") & (F.col("idx") > 150) & (F.col("idx") <= 190)
    return p.withColumn("price", F.when(inside, F.col("price") * F.exp(0.05 * (F.col("idx") - 150))).otherwise(F.col("price")))


BUBBLE_SQL = R + """
wk as (select entity, date, idx, cap, 50.0 + sum(step) over (partition by entity order by idx) as price from (
  select *, price/avg(price) over (partition by entity) - 1.0 as step from panel)),
bp as materialized (select entity, date, idx, cap, case when entity = 'Brand#3' and idx > 150 and idx <= 190 then price*exp(0.05*(idx - 150)) else price end as price from wk),
cn as (select *, price - avg(price) over (partition by entity) as y, count(*) over (partition by entity) as t from bp),
ob as (select *, lag(y) over (partition by entity order by idx) as x, y - lag(y) over (partition by entity order by idx) as d from cn),
pf as materialized (select entity, idx, t, floor((0.01 + 1.8/sqrt(t))*t) as w, sum(coalesce(x, 0)) over o as sx, sum(coalesce(x*x, 0)) over o as sxx, sum(coalesce(d, 0)) over o as sd,
  sum(coalesce(d*d, 0)) over o as sdd, sum(coalesce(x*d, 0)) over o as sxd from ob window o as (partition by entity order by idx)),
wd as (select e.entity, e.idx, e.idx - s.idx as m, e.sx - s.sx as sx, e.sd - s.sd as sd, e.sxx - s.sxx as sxx, e.sdd - s.sdd as sdd, e.sxd - s.sxd as sxd
  from pf e join pf s on e.entity = s.entity and s.idx <= e.idx - e.w + 1 where e.idx >= e.w),
ct as (select entity, idx, m, sxx - sx*sx/m as cxx, sxd - sx*sd/m as cxd, sdd - sd*sd/m as cdd from wd),
adf as (select entity, idx, m, cxd/cxx/sqrt((cdd - cxd*cxd/cxx)/(m - 2)/cxx) as stat from ct),
bs as materialized (select entity, idx, max(stat) as bsadf from adf group by 1, 2),
"""


@query("adf_statistic", keys="entity", nums="stat", sql=BUBBLE_SQL + "select_final select entity, stat from adf where (entity, idx, m) in (select entity, t, t - 1 from pf)")
def _(m):
    return B.adf_stat(bubble_panel(m))


@query("adf_statistic_lags", keys="entity", ints="lag", nums="stat")
def _(m):
    return B.adf_stat_lags(bubble_panel(m), lag_max=10, kind="BIC")


@query("bsadf", keys="entity", ints="idx", nums="bsadf", sql=BUBBLE_SQL + "select_final select entity, idx, bsadf from bs")
def _(m):
    return B.bsadf(bubble_panel(m))


@query("bsadf_lags", keys="entity", ints="idx", nums="bsadf")
def _(m):
    return B.bsadf(bubble_panel(m), lag_max=10, kind="AIC")


ISLAND_SQL = BUBBLE_SQL + """
hot as (select entity, idx, idx - row_number() over (partition by entity order by idx) as run from bs where bsadf > 0.5),
runs as (select entity, run, min(idx) as s, max(idx) as e from hot group by 1, 2 having max(idx) - min(idx) + 1 >= floor(ln((select max(t) from pf)))),
mk as (select *, case when s - lag(e) over (partition by entity order by s) <= 2*floor(ln((select max(t) from pf))) then 0 else 1 end as far from runs),
ep as (select *, sum(far) over (partition by entity order by s) as episode from mk),
isl as materialized (select entity, episode, min(s) as start_idx, max(e) as end_idx from ep group by 1, 2),
brk as materialized (select i.entity, i.episode, start_idx, end_idx, arg_min(p.idx, struct_pack(a := -price, b := p.idx)) as peak_idx from isl i join bp p
  on i.entity = p.entity and p.idx > start_idx and p.idx <= end_idx group by 1, 2, 3, 4),
fl as (select p.*, case when b.entity is null then 0 else 1 end as bub, case when p.idx <= peak_idx then 1 else 0 end as bmph,
  case when p.idx > peak_idx then 1 else 0 end as brph from bp p left join brk b on p.entity = b.entity and p.idx between start_idx and end_idx),
"""


def _islands(m, cv=0.5):
    """Episodes above a fixed level; the level stands in for the bootstrap value so that SQL can follow."""
    panel = bubble_panel(m)
    lengths = panel.groupBy("entity").agg(F.count(F.lit(1)).alias("t"))
    return B.bubble_islands(B.bsadf(panel).withColumn("cv", F.lit(cv)), lengths), panel


@query("bubble_islands", keys="entity", ints="episode, start_idx, end_idx", sql=ISLAND_SQL + "select_final select * from isl")
def _(m):
    return _islands(m)[0]


@query("bubble_breakdown", keys="entity", ints="episode, start_idx, peak_idx, end_idx, duration, boom, burst", sql=ISLAND_SQL + """
select_final select *, end_idx - start_idx + 1 as duration, peak_idx - start_idx as boom, end_idx - peak_idx + 1 as burst from brk""")
def _(m):
    islands, panel = _islands(m)
    return B.bubble_breakdown(islands, panel)


@query("bubble_flags", keys="entity, date", ints="bub, bmph, brph", sql=ISLAND_SQL + "select_final select entity, date, bub, bmph, brph from fl")
def _(m):
    islands, panel = _islands(m)
    return B.bubble_flags(panel, B.bubble_breakdown(islands, panel))


@query("bubble_capitalization", keys="date", nums="bc_m, bcp", digits=9, sql=ISLAND_SQL + """
select_final select date, sum(bub*cap)/1e6 as bc_m, sum(bub*cap)/sum(cap) as bcp from fl group by 1""")
def _(m):
    islands, panel = _islands(m)
    return B.bubble_capitalization(B.bubble_flags(panel, B.bubble_breakdown(islands, panel))).withColumn("bc_m", F.col("bc") / 1e6)


A = 0.05
HITS_SQL = R + X.index() + f"""
bh as (select entity, r.idx, r, r_m from rets r join idx_rets i on r.idx = i.idx),
qt as (select entity, quantile_cont(r, {A}) as qf, quantile_cont(r_m, {A}) as qm from bh group by 1),
hits as materialized (select bh.entity, idx, case when r <= qf then 1 else 0 end - {A} as hf, case when r_m <= qm then 1 else 0 end - {A} as hm from bh join qt using (entity)),
"""


def _both(m):
    return m.returns().select("entity", "idx", "r").join(m.index().select("idx", "r_m"), "idx")


@query("quantile_hits", keys="entity", ints="idx", nums="hf, hm", sql=HITS_SQL + "select_final select * from hits")
def _(m):
    return Q.paired_hits(m.returns(), m.index(), A)


@query("cross_quantilogram", keys="entity", ints="lag", nums="from_market, to_market", sql=HITS_SQL + """
lp as (select a.entity, a.idx - b.idx as lag, sum(a.hf*b.hm) as fm, sum(a.hf*a.hf) as ff, sum(b.hm*b.hm) as mm,
  sum(a.hm*b.hf) as mf, sum(a.hm*a.hm) as m2, sum(b.hf*b.hf) as f2 from hits a join hits b on a.entity = b.entity and a.idx - b.idx between 1 and 60 group by 1, 2)
select_final select entity, lag, fm/sqrt(ff*mm) as from_market, mf/sqrt(m2*f2) as to_market from lp""")
def _(m):
    return Q.cross_quantilogram(Q.paired_hits(m.returns(), m.index(), A), 60)


def with_states(m):
    """Returns and index with the five state variables as columns s1..s5.

    A week without a value keeps the last one before it, and the first ones take the next: no week is left out. The fill
    runs over one row a week.
    """
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = m.states().groupBy("date").pivot("var", names).agg(F.first("value"))
    wide = wide.select("date", *[F.col(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names, 1)])
    back, ahead = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    weeks = m.index().select("idx", "date", "r_m").join(wide, "date", "left")
    weeks = weeks.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in STATES_COLS})
    return m.returns().select("entity", "idx", "r", "price", "volume", "cap", "cds").join(weeks, "idx")


STATES_COLS = ["s1", "s2", "s3", "s4", "s5"]


@query("partial_cross_quantilogram", keys="entity", ints="lag", nums="from_market, to_market")
def _(m):
    return Q.partial_cross_quantilogram(with_states(m), STATES_COLS, A, 60)


@query("quantilogram_self_normalised", keys="entity, direction", ints="lag", nums="cq, half_width", sql=R + X.index() + f"""
bh as materialized (select entity, r.idx, r, r_m from rets r join idx_rets i on r.idx = i.idx),
n as (select max(idx) as t, greatest(floor(0.10*max(idx) + 0.5), 1) as lo from bh),
q as (select e.entity, e.idx as i, quantile_cont(b.r, {A}) as qf, quantile_cont(b.r_m, {A}) as qm from bh e join bh b on e.entity = b.entity and b.idx <= e.idx
  where e.idx >= (select lo from n) group by 1, 2),
h as materialized (select q.entity, q.i, b.idx, case when r <= qf then 1 else 0 end - {A} as hf, case when r_m <= qm then 1 else 0 end - {A} as hm
  from q join bh b on q.entity = b.entity and b.idx <= q.i),
lg as (select entity, i, k as lag, hf, hm, lag(hf, cast(k as integer)) over w as pf, lag(hm, cast(k as integer)) over w as pm from h, range(1, 4) r(k) window w as (partition by entity, i, k order by idx)),
c as (select entity, i, lag, sum(hf*pm)/sqrt(sum(case when pm is not null then hf*hf end)*sum(pm*pm)) as fm, sum(hm*pf)/sqrt(sum(case when pf is not null then hm*hm end)*sum(pf*pf)) as mf from lg group by 1, 2, 3),
u as (select entity, i, lag, 'from_market' as direction, fm as cq from c union all select entity, i, lag, 'to_market', mf from c),
l as (select u.entity, u.lag, u.direction, f.cq, sum(power((u.cq - f.cq)*u.i, 2)) as s from u join u f on f.entity = u.entity and f.lag = u.lag and f.direction = u.direction
  and f.i = (select t from n) group by 1, 2, 3, 4)
select_final select entity, direction, lag, cq, sqrt(48.55132*s/power(t, 3)) as half_width from l, n""")
def _(m):
    """The first three lags, which SQL can follow."""
    return Q.ci_self_normalised(_both(m), A, lags=3)


@query("quantilogram_self_normalised_lags", keys="entity, direction", ints="lag", nums="cq, half_width")
def _(m):
    return Q.ci_self_normalised(_both(m), A, lags=60)


LENGTH_SQL = X.panel("supplier") + """
bl as (select entity, idx, r as x from rets),
sz as (select entity, count(*) as t, cast(floor(greatest(sqrt(log10(count(*))), 5)) as integer) as run,
  cast(ceil(sqrt(count(*))) as integer) + cast(floor(greatest(sqrt(log10(count(*))), 5)) as integer) as lim from bl group by 1),
lp as materialized (select a.entity, t, run, lim, a.idx, a.idx - b.idx as lag, a.x, b.x as past from bl a join sz on a.entity = sz.entity join bl b on a.entity = b.entity and a.idx - b.idx between 0 and lim),
rh as (select entity, t, run, lim, lag, abs(corr(x, past)) < 2*sqrt(log10(t)/t) as small from lp where lag > 0 and idx > lim group by 1, 2, 3, 4, 5),
qt as (select a.entity, a.lag from rh a join rh b on a.entity = b.entity and b.lag between a.lag and a.lag + a.run - 1 group by 1, 2, a.run having count(*) = a.run and bool_and(b.small)),
mw as (select entity, least(2*coalesce((select min(lag) from qt where qt.entity = rh.entity), max(case when not small then lag end), 1), any_value(lim)) as m from rh group by 1),
cv as (select lp.entity, t, m, lag, covar_samp(x, past) as c from lp join mw using (entity) where lag <= m and idx > m group by 1, 2, 3, 4),
kw as (select *, case when lag/m < 0.5 then 1.0 when lag <= m then 2*(1 - lag/m) else 0 end*(case when lag = 0 then 1 else 2 end) as w from cv),
ks as (select entity, t, sum(w*c) as lv, sum(w*c*lag) as sl from kw group by 1, 2),
"""


@query("optimal_block_length", keys="entity", nums="block_length", sql=LENGTH_SQL + """
select_final select entity, least(power(sl*sl*t/(lv*lv), 1.0/3), ceil(least(3*sqrt(t), t/3.0))) as block_length from ks""")
def _(m):
    return Q.optimal_block_length(m.returns("supplier"), "r")
