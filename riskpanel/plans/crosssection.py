"""Cross-sectional measures over the weekly brand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.operators import crosssection as S
from riskpanel.operators import describe as D
from riskpanel.operators import transforms as T
from riskpanel.plans import sqltext as X
from riskpanel.plans.registry import query
from riskpanel.plans.transforms import LIABILITIES_SQL, with_liabilities
from riskpanel.session import cut_lineage

GA, GG, GB = S.GJR_START
DA, DB = S.DCC_START
A = 0.05
SCALE = 1e6
BASE = X.panel() + X.index()


def _gjr(h: str, e: str, s2: str) -> str:
    return f"(1 - {GA} - 0.5*{GG} - {GB})*{s2} + {GA}*{e}*{e} + {GG}*(case when {e} < 0 then {e}*{e} else 0 end) + {GB}*{h}"


MOMENTS_SQL = BASE + f"""
mb as materialized (select r.entity, r.date, r.idx, r.r - avg(r.r) over p as r0, i.r_m - avg(i.r_m) over p as rm0, r.r, i.r_m, cap
  from rets r join idx_rets i on r.idx = i.idx window p as (partition by r.entity)),
sc as materialized (select entity, stddev_pop(r0) as s, stddev_pop(rm0) as sx, (sum(r0*r0) + var_pop(r0) - power(sum(r0) + stddev_pop(r0), 2)/(count(*) + 1))/count(*) as s2,
  (sum(rm0*rm0) + var_pop(rm0) - power(sum(rm0) + stddev_pop(rm0), 2)/(count(*) + 1))/count(*) as sx2 from mb group by 1),
vol(entity, idx, hf, hm) as (select entity, 1 as idx, {_gjr('s*s', 's', 's2')} as hf, {_gjr('sx*sx', 'sx', 'sx2')} as hm from sc
  union all select v.entity, v.idx + 1, {_gjr('v.hf', 'b.r0', 'c.s2')}, {_gjr('v.hm', 'b.rm0', 'c.sx2')} from vol v
  join mb b on b.entity = v.entity and b.idx = v.idx join sc c on c.entity = v.entity where v.idx < (select max(idx) from mb)),
sd as materialized (select mb.*, sqrt(hf) as sf, sqrt(hm) as sm, rm0/sqrt(hm) as em, r0/sqrt(hf) as ef from mb join vol on mb.entity = vol.entity and mb.idx = vol.idx),
qb as materialized (select entity, var_samp(em) as b11, covar_samp(em, ef) as b12, var_samp(ef) as b22 from sd group by 1),
dcc(entity, idx, q11, q12, q22) as (select entity, 1 as idx, (1 - {DA})*b11 + {DA}, (1 - {DA})*b12 + {DA}, (1 - {DA})*b22 + {DA} from qb
  union all select d.entity, d.idx + 1, (1 - {DA} - {DB})*b11 + {DA}*em*em + {DB}*q11, (1 - {DA} - {DB})*b12 + {DA}*em*ef + {DB}*q12, (1 - {DA} - {DB})*b22 + {DA}*ef*ef + {DB}*q22
  from dcc d join sd s on s.entity = d.entity and s.idx = d.idx join qb b on b.entity = d.entity where d.idx < (select max(idx) from sd)),
mom as materialized (select sd.*, q12/sqrt(q11*q22) as rho, q12/sqrt(q11*q22)*sf/sm as beta from sd join dcc on sd.entity = dcc.entity and sd.idx = dcc.idx),
"""


def _pair(m):
    """Entity and index returns side by side."""
    return m.returns().join(m.index().select("idx", "r_m"), "idx")


def _moments(m, fitted=False):
    return S.add_beta(S.dynamic_moments(_pair(m), fitted))


@query("gjr_variance", keys="entity", ints="idx", nums="hf", digits=9, sql=MOMENTS_SQL + "select_final select entity, idx, hf from vol")
def _(m):
    return S.gjr_variance(S.demean(_pair(m), ["r"]), "r0", "hf")


@query("gjr_fit", keys="entity", nums="a, g, b, loss")
def _(m):
    return S.gjr_fit(S.demean(_pair(m), ["r"]), "r0")


@query("dcc_correlation", keys="entity", ints="idx", nums="rho", sql=MOMENTS_SQL + "select_final select entity, idx, rho from mom")
def _(m):
    return S.dynamic_moments(_pair(m))


@query("dcc_fit", keys="entity", nums="a, b, loss")
def _(m):
    base = S.dynamic_moments(_pair(m)).withColumns({"em": F.col("r_m0") / F.col("sm"), "ef": F.col("r0") / F.col("sf")})
    return S.dcc_fit(base)


@query("dynamic_beta", keys="entity", ints="idx", nums="beta", sql=MOMENTS_SQL + "select_final select entity, idx, beta from mom")
def _(m):
    return _moments(m)


VAR_SQL = MOMENTS_SQL + f"""
zl as (select entity, list(r0/sf order by r0/sf) as z from mom group by 1), cz as (select entity, {X.hf5('z', A)} as c from zl),
vr as materialized (select mom.*, -least(sf*c, 0.0) as var, -least(sf*-(exp(-0.5*c*c)/sqrt(2*pi())/{A}), 0.0) as es from mom join cz using (entity)),
"""


@query("value_at_risk", keys="entity", ints="idx", nums="var, es", sql=VAR_SQL + "select_final select entity, idx, var, es from vr")
def _(m):
    return S.add_var_es(_moments(m), A)


@query("quantile_regression", keys="entity", nums="b0, b1", digits=4)
def _(m):
    return S.quantile_regression(S.demean(_pair(m), ["r", "r_m"]), "r_m0", ["r0"], A)


@query("covar", keys="entity", ints="idx", nums="covar, dcovar", digits=4)
def _(m):
    return S.add_covar(S.add_var_es(_moments(m), A), A)


@query("covar_with_states", keys="entity", ints="idx", nums="covar, dcovar", digits=4)
def _(m):
    from riskpanel.plans.dynamics import STATES_COLS, with_states
    from pyspark.sql import Window
    rows = with_states(m).withColumn("idx", F.row_number().over(Window.partitionBy("entity").orderBy("date")).cast("bigint"))
    return S.add_covar(S.add_var_es(S.add_beta(S.dynamic_moments(rows)), A), A, STATES_COLS)


MES_SQL = VAR_SQL + f"""
ux as materialized (select *, rm0/sm as u, sqrt(1 - rho*rho) as z, (r0/sf - rho*rm0/sm)/sqrt(1 - rho*rho) as x from vr),
ul as (select entity, list(rm0 order by rm0) as ms, list(u order by u) as us, stddev_samp(u) as sdu, count(*) as n from ux group by 1),
hw as (select entity, {X.hf5('ms', A)} as c, least(sdu, ({X.hf5('us', 0.75)} - {X.hf5('us', 0.25)})/1.349)*power(4.0/(3.0*n), 0.2) as h from ul),
fw as (select ux.*, {X.norm_cdf('((c/sm - u)/h)')} as f from ux join hw using (entity)),
kk as (select entity, sum(u*f)/sum(f) as k1, sum(x*f)/sum(f) as k2 from fw group by 1),
ms as materialized (select ux.*, -least(sf*rho*k1 + sf*z*k2, 0.0) as mes, 1 - exp(ln(0.6)*beta) as lrmes from ux join kk using (entity)),
"""


@query("marginal_expected_shortfall", keys="entity", ints="idx", nums="mes, lrmes", sql=MES_SQL + "select_final select entity, idx, mes, lrmes from ms")
def _(m):
    return S.add_mes(_moments(m), A, 0.4)


SES_SQL = X.BALANCE + """
shx as (select r.*, i.r_m from rets r join idx_rets i on r.idx = i.idx),
""" + LIABILITIES_SQL.replace("from rets r", "from shx r")


def _sheet(m):
    return with_liabilities(m, _pair(m))


@query("systemic_expected_shortfall", keys="entity", ints="idx", nums="ses_m", digits=8, sql=BASE + SES_SQL + """
gw as (select *, case when idx = 1 then 0 else (lb - lag(lb) over w)/lag(lb) over w end as dl, case when idx = 1 then 0 else (cap - lag(cap) over w)/lag(cap) over w end as dc
  from sheet_rolled window w as (partition by entity order by idx))
select_final select entity, idx, case when x < 0 then 0.0 else x end/1e6 as ses_m from (select *, 0.08*lb*(1 + dl) - 0.92*cap*(1 + dc) as x from gw)""")
def _(m):
    return S.add_ses(_sheet(m)).withColumn("ses_m", F.col("ses") / SCALE)


@query("srisk", keys="entity", ints="idx", nums="srisk_m", sql=MES_SQL + SES_SQL + """
select_final select s.entity, s.idx, case when x < 0 then 0.0 else x end/1e6 as srisk_m from (
  select r.entity, r.idx, 0.08*lbr - 0.92*(1 - lrmes)*r.cap as x from sheet_rolled r join ms on r.entity = ms.entity and r.idx = ms.idx) s""")
def _(m):
    return S.add_srisk(S.add_mes(S.add_beta(S.dynamic_moments(_sheet(m))), A, 0.4)).withColumn("srisk_m", F.col("srisk") / SCALE)


@query("cross_sectional_averages", keys="date", nums="beta, var, es, mes", sql=MES_SQL + """
select_final select date, sum(beta*cap)/sum(cap) as beta, sum(var*cap)/sum(cap) as var, sum(es*cap)/sum(cap) as es, sum(mes*cap)/sum(cap) as mes from ms group by 1""")
def _(m):
    rows = S.add_mes(S.add_var_es(_moments(m), A), A, 0.4)
    return rows.groupBy("date").agg(*[(F.sum(F.col(c) * F.col("cap")) / F.sum("cap")).alias(c) for c in ("beta", "var", "es", "mes")])


@query("cross_sectional_fitted", keys="entity", ints="idx", nums="beta, var, es, covar, dcovar, mes, ses_m, srisk_m", digits=4)
def _(m):
    """Whole family with scanned volatility and correlation parameters."""
    rows = cut_lineage(S.add_beta(S.dynamic_moments(_sheet(m), fitted=True)))
    out = S.add_srisk(S.add_ses(S.add_mes(S.add_covar(S.add_var_es(rows, A), A), A, 0.4)))
    return out.withColumns({"ses_m": F.col("ses") / SCALE, "srisk_m": F.col("srisk") / SCALE})


CAVIAR = (-0.01, -0.01, -0.2, 0.0, 0.0, -0.2, 0.8, 0.0, 0.05, 0.8)
_P = [repr(v) for v in CAVIAR]


@query("caviar_path", keys="entity", ints="idx", nums="q_m, q_f", sql=BASE + f"""
cb as materialized (select r.entity, r.idx, r.r, i.r_m from rets r join idx_rets i on r.idx = i.idx),
st as (select entity, list(r_m order by r_m)[5] as q_m, list(r order by r)[5] as q_f from cb where idx <= 100 group by 1),
cv(entity, idx, q_m, q_f) as (select entity, 1, q_m, q_f from st union all
  select c.entity, c.idx + 1, {_P[0]} + {_P[2]}*abs(b.r_m) + {_P[4]}*abs(b.r) + {_P[6]}*q_m + {_P[8]}*q_f, {_P[1]} + {_P[3]}*abs(b.r_m) + {_P[5]}*abs(b.r) + {_P[7]}*q_m + {_P[9]}*q_f
  from cv c join cb b on b.entity = c.entity and b.idx = c.idx where c.idx < (select max(idx) from cb))
select_final select entity, idx, q_m, q_f from cv""")
def _(m):
    return S.caviar_path(_pair(m), CAVIAR, A)


@query("caviar_fit", keys="entity", nums="b1, b2, b3, loss")
def _(m):
    return S.caviar_fit(_pair(m), "r", A)


@query("caviar_fitted_path", keys="entity", ints="idx", nums="q_m, q_f")
def _(m):
    rows = _pair(m)
    params = cut_lineage(S.caviar_params(S.caviar_fit(rows, "r_m", A), S.caviar_fit(rows, "r", A)))
    return S.caviar_path(rows, params, A)


@query("caviar_impulse_response", keys="entity", ints="step", nums="ir_fm, ir_mf", digits=9, sql=BASE + f"""
cb as (select r.entity, r.idx, r.r, i.r_m from rets r join idx_rets i on r.idx = i.idx),
cc as (select entity, var_samp(r_m) as v, covar_samp(r_m, r) as c, var_samp(r) as w from cb group by 1),
ch as (select entity, sqrt(v) as l11, c/sqrt(v) as l21, sqrt(w - c*c/v) as l22 from cc),
sh as (select entity, 'fm' as dir, abs(2*l11) as m, abs(2*l21) as f from ch union all select entity, 'mf', 0.0, abs(2*l22) from ch),
ir(entity, dir, step, m, f) as (select entity, dir, 1, {_P[2]}*m + {_P[4]}*f, {_P[3]}*m + {_P[5]}*f from sh
  union all select entity, dir, step + 1, {_P[6]}*m + {_P[8]}*f, {_P[7]}*m + {_P[9]}*f from ir where step < 200)
select_final select entity, step, max(case when dir = 'fm' then f end) as ir_fm, max(case when dir = 'mf' then m end) as ir_mf from ir group by 1, 2""")
def _(m):
    return S.caviar_irf(_pair(m), CAVIAR)


_RANKED = ("r", "cap", "cds", "volume")
_POS = ", ".join(f"row_number() over (partition by idx order by {c}, entity) as p_{c}" for c in _RANKED)
KENDALL_SQL = BASE + f"""
ps as materialized (select entity, idx, row_number() over (partition by idx order by entity) as id, {_POS} from (select entity, idx, r, cap, round(cds, 9) as cds, volume from rets)),
lg as materialized (""" + " union all ".join(f"select '{c}' as measure, idx, p_{c} as pos, id from ps" for c in _RANKED) + "),"


def _ranked(m):
    return m.returns().withColumn("cds", F.round("cds", 9))


@query("kendall_concordance", keys="left_name, right_name", nums="rc", sql=KENDALL_SQL + """
pw as (select a.measure as left_name, b.measure as right_name, a.idx, sum(power(a.id + b.id, 2)) as q, sum(a.id + b.id) as t, cast(count(*) as double) as n from lg a join lg b
  on a.idx = b.idx and a.pos = b.pos and (case a.measure when 'r' then 1 when 'cap' then 2 when 'cds' then 3 else 4 end) < (case b.measure when 'r' then 1 when 'cap' then 2 when 'cds' then 3 else 4 end)
  group by 1, 2, 3)
select_final select left_name, right_name, avg(12.0*(q - t*t/n)/(4.0*(n*n*n - n))) as rc from pw group by 1, 2""")
def _(m):
    return S.kendall_concordance(_ranked(m), list(_RANKED)).withColumnsRenamed({"left": "left_name", "right": "right_name"})


@query("kendall_concordance_ranks", keys="left_name, right_name", nums="rc", sql=KENDALL_SQL + """
tr as (select a.measure as left_name, b.measure as right_name, a.idx, sum(power(a.pos + b.pos, 2)) as q, sum(a.pos + b.pos) as t, cast(count(*) as double) as n from lg a join lg b
  on a.idx = b.idx and a.id = b.id and (case a.measure when 'r' then 1 when 'cap' then 2 when 'cds' then 3 else 4 end) < (case b.measure when 'r' then 1 when 'cap' then 2 when 'cds' then 3 else 4 end)
  group by 1, 2, 3)
select_final select left_name, right_name, avg(12.0*(q - t*t/n)/(4.0*(n*n*n - n))) as rc from tr group by 1, 2""")
def _(m):
    return S.kendall_concordance(_ranked(m), list(_RANKED), true_ranks=True).withColumnsRenamed({"left": "left_name", "right": "right_name"})


@query("rank_stability", keys="measure", nums="rs", sql=KENDALL_SQL + """
sb as (select a.measure, a.idx, sum(power(a.id + b.id, 2)) as q, sum(a.id + b.id) as t, cast(count(*) as double) as n from lg a join lg b
  on a.measure = b.measure and a.pos = b.pos and a.idx = b.idx + 1 group by 1, 2)
select_final select measure, avg(12.0*(q - t*t/n)/(4.0*(n*n*n - n))) as rs from sb group by 1""")
def _(m):
    return S.rank_stability(_ranked(m), list(_RANKED))


@query("concordance_flags", keys="src, dst", ints="flag", sql=KENDALL_SQL + """
pw as (select a.measure as src, b.measure as dst, a.idx, sum(power(a.id + b.id, 2)) as q, sum(a.id + b.id) as t, cast(count(*) as double) as n from lg a join lg b
  on a.idx = b.idx and a.pos = b.pos and (case a.measure when 'r' then 1 when 'cap' then 2 when 'cds' then 3 else 4 end) < (case b.measure when 'r' then 1 when 'cap' then 2 when 'cds' then 3 else 4 end)
  group by 1, 2, 3)
select_final select src, dst, case when avg(12.0*(q - t*t/n)/(4.0*(n*n*n - n))) > 0.5 then 1 else 0 end as flag from pw group by 1, 2""")
def _(m):
    rc = S.kendall_concordance(_ranked(m), list(_RANKED)).withColumnsRenamed({"left": "src", "right": "dst"})
    return D.threshold_matrix(rc, "rc", 0.5)
