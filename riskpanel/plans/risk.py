"""Default, liquidity, regime, spillover and tail queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from riskpanel.operators import default as V
from riskpanel.operators import liquidity as L
from riskpanel.operators import regime as G
from riskpanel.operators import spillover as P
from riskpanel.operators import tail as A
from riskpanel.operators import transforms as T
from riskpanel.plans import sqltext as X
from riskpanel.plans.component import GROUP_SQL, group_panel
from riskpanel.plans.registry import query
from riskpanel.plans.transforms import LIABILITIES_SQL, MAGNITUDE_SQL, ewma_sql, with_liabilities
from riskpanel.session import cut_lineage

BW = 52
K = T.head_rows(BW)
CAR = 0.08

# ---------------------------------------------------------------- default

SHEET_SQL = X.panel() + X.index() + X.BALANCE + LIABILITIES_SQL.replace(
    "from rets r", "from (select r.*, i.rf from rets r join idx_rets i on r.idx = i.idx) r") + """
bar as materialized (select entity, date, idx, rf, cds, cap/1e6 as eq, lb/1e6 as lb, 0.25*lb/1e6 + 0.6*0.75*lb/1e6 as db from sheet_rolled),
"""


def kmv_sql(rows: str, name: str) -> str:
    """CTE `name`: `rows` (entity, idx, rf, eq, db) with the asset values of the fixed point, one list per series and step."""
    each = "list_transform(range(1, n + 1), lambda i: {})"
    return f"""
src_{name} as materialized (select entity, count(*) as n, list(eq order by idx) as eq, list(db order by idx) as db, list(rf order by idx) as rf, list(db*exp(-rf) order by idx) as pv
  from {rows} group by 1),
fix_{name}(entity, k, va, moved) as (select entity, 0, list(eq + db*exp(-rf) order by idx), cast(1 as double) from {rows} group by 1 union all
  select entity, k + 1, nv, sqrt(list_avg({each.format('power(nv[i] - va[i], 2)')})) from (
    select *, {each.format(f"eq[i] + va[i]*(1 - {X.norm_cdf('d1[i]')}) + pv[i]*{X.norm_cdf('(d1[i] - s)')}")} as nv from (
      select *, {each.format('(ln(va[i]/db[i]) + rf[i] + 0.5*s*s)/s')} as d1 from (
        select f.entity, k, va, n, eq, db, rf, pv, sqrt(252)*list_aggregate(list_transform(range(2, n + 1), lambda i: ln(va[i]) - ln(va[i - 1])), 'stddev_samp') as s
        from fix_{name} f join src_{name} using (entity) where moved > 1e-8 and k < 10000)))),
end_{name} as (select entity, arg_max(va, k) as v from fix_{name} group by 1),
at_{name} as (select r.*, v[row_number() over (partition by r.entity order by idx)] as va from {rows} r join end_{name} e on r.entity = e.entity),
lr_{name} as (select entity, ln(va) - lag(ln(va)) over (partition by entity order by idx) as dr from at_{name}),
zs_{name} as (select entity, count(dr) as n, stddev_samp(dr) as sd, avg(dr) as mu, stddev_pop(dr) as sp from lr_{name} group by 1),
ms_{name} as (select l.entity, any_value(n)::double as n, any_value(sd) as sd, avg(power((dr - mu)/sp, 3)) as m3, avg(power((dr - mu)/sp, 4)) as m4
  from lr_{name} l join zs_{name} z on l.entity = z.entity where dr is not null group by 1),
{name} as materialized (select a.*, sqrt(252)*sd as va_s, m3*sqrt(n*(n - 1))/(n - 2)/sqrt(252) as va_g,
  (n - 1)/((n - 2)*(n - 3))*((n + 1)*m4 - 3*(n - 1))/252 as va_k from at_{name} a join ms_{name} m on a.entity = m.entity),
"""


ASSETS_SQL = SHEET_SQL + kmv_sql("bar", "va")


def barriers(m):
    """Returns with balance sheet, risk-free rate and default barrier, money in millions."""
    rows = with_liabilities(m, m.returns().join(m.index().select("idx", "rf"), "idx"))
    scaled = rows.select("entity", "date", "idx", "rf", "cds", (F.col("cap") / 1e6).alias("cap"), (F.col("lb") / 1e6).alias("lb"))
    return V.default_barrier(scaled, 3.0)


@query("default_barrier", keys="entity", ints="idx", nums="db", sql=SHEET_SQL + "select_final select entity, idx, db from bar")
def _(m):
    return barriers(m)


def _assets(m):
    rows = cut_lineage(barriers(m))
    return rows.join(V.kmv_assets(rows), ["entity", "idx"])


@query("kmv_assets", keys="entity", ints="idx", nums="va, va_s, va_g, va_k", sql=ASSETS_SQL + "select_final select entity, idx, va, va_s, va_g, va_k from va")
def _(m):
    return _assets(m)


DIST = "(ln(va/({b})) + (rf + 0.5*va_s*va_s))/va_s - va_s"


@query("default_distances", keys="entity", ints="idx", nums="d2d, d2c", sql=ASSETS_SQL + f"""
select_final select entity, idx, {DIST.format(b='db')} as d2d, {DIST.format(b='db/0.92')} as d2c from va""")
def _(m):
    return V.add_distances(_assets(m), CAR)


def _claims_sql(more: str = "0.0") -> str:
    return ASSETS_SQL + f"""
cl0 as (select *, db*exp(-rf) as dbd, (ln(va/db) + (rf + 0.5*va_s*va_s))/va_s as d1 from va),
cl1 as (select *, greatest(0.0, dbd*{X.norm_cdf('(va_s - d1)')} - va*{X.norm_cdf('(-d1)')} - {more}) as el from cl0),
cl2 as (select *, least(dbd*(1 - exp(-cds*greatest(0.5, db/(dbd - el) - 1))), el) as cput from cl1),
claims as materialized (select entity, idx, el, case when el > 0 then least(greatest(1 - cput/el, 0.0), 1.0) else 0.0 end as alpha from cl2),
"""


CLAIMS_SQL = _claims_sql()
GRAM_CHARLIER = f"va*{X.norm_cdf('d1')}*va_s*(va_g/6*(2*va_s - d1) - va_k/24*(1 - d1*d1 + 3*d1*va_s - 3*va_s*va_s))"


@query("contingent_claims", keys="entity", ints="idx", nums="el, cl, alpha", sql=CLAIMS_SQL + "select_final select entity, idx, el, el*alpha as cl, alpha from claims")
def _(m):
    return V.add_contingent_claims(_assets(m))


@query("contingent_claims_gram_charlier", keys="entity", ints="idx", nums="el, cl, alpha", sql=_claims_sql(GRAM_CHARLIER) + "select_final select entity, idx, el, el*alpha as cl, alpha from claims")
def _(m):
    return V.add_contingent_claims(_assets(m), gram_charlier=True)


@query("contingent_claims_totals", ints="idx", nums="el, cl, alpha", sql=CLAIMS_SQL + """
select_final select idx, sum(el) as el, sum(el*alpha) as cl, sum(el*alpha)/sum(el) as alpha from claims group by 1""")
def _(m):
    return V.scca_totals(V.add_contingent_claims(_assets(m)))


@query("default_indicators", keys="date", nums="ad2d, ad2c, pd2d, pd2c", sql=ASSETS_SQL + """
pool as (select 'PORTFOLIO' as entity, date, idx, any_value(rf) as rf, sum(eq) as eq, sum(db) as db from bar group by 2, 3),""" + kmv_sql("pool", "vp") + f"""
each as (select idx, date, sum(eq*({DIST.format(b='db')}))/sum(eq) as ad2d, sum(eq*({DIST.format(b='db/0.92')}))/sum(eq) as ad2c from va group by 1, 2)
select_final select each.date, ad2d, ad2c, {DIST.format(b='db')} as pd2d, {DIST.format(b='db/0.92')} as pd2c from each join vp on each.idx = vp.idx""")
def _(m):
    """Cap-weighted average distances next to those of the portfolio taken as one entity."""
    rows = _assets(m)
    each = V.add_distances(rows, CAR).groupBy("date", "idx").agg(
        *[(F.sum(F.col(c) * F.col("cap")) / F.sum("cap")).alias("a" + c) for c in ("d2d", "d2c")])
    pooled = cut_lineage(V.portfolio(rows))
    whole = V.add_distances(pooled.join(V.kmv_assets(pooled), ["entity", "idx"]), CAR).select(
        "idx", F.col("d2d").alias("pd2d"), F.col("d2c").alias("pd2c"))
    return each.join(whole, "idx")


MARGIN_SQL = X.panel() + f"""
lw as (select a.entity, a.idx, list(-b.r order by -b.r) as l, count(*) as t from rets a join rets b on a.entity = b.entity and b.idx between a.idx - {BW - 1} and greatest(a.idx, {K}) group by 1, 2),
sx as (select entity, idx, l, t, unnest(range(1, t//4 + 1)) as s from lw),
ax as (select *, sqrt(ln((t - s)/t)/ln(s/t)) as a from sx),
qx as (select *, cast(floor(t*power(s/t, a)) as bigint) as q1 from ax),
xr as (select entity, idx, t, l, sum(-ln((l[t - s] - l[q1])/greatest(1e-8, l[q1] - l[s]))/ln(a))/max(s) as x from qx group by 1, 2, 3, 4),
xi as materialized (select entity, idx, t, l, case when x > 0 then greatest(0.01, least(2.0, x)) else greatest(-1.0, least(-0.01, x)) end as xi from xr),
iy as (select entity, idx, t, xi, unnest(l) as z, unnest(range(1, t + 1)) as i from xi),
yy as (select entity, idx, xi, z, (power(-ln(i/(t + 1)), -xi) - 1)/xi as y from iy where i > t//10 and i <= t - t//10),
margins as (select entity, idx, xi, regr_intercept(z, y) as mu, regr_slope(z, y) as sigma from yy group by 1, 2, 3),
"""


def _losses(m):
    return m.returns().withColumn("loss", -F.col("r"))


@query("joint_extreme_margins", keys="entity", ints="idx", nums="xi, mu, sigma", sql=MARGIN_SQL + "select_final select * from margins")
def _(m):
    return V.mgev_margins(_losses(m), "loss", BW)


@query("joint_extreme_dependence", ints="idx", nums="d", sql=X.panel() + f"""
wr as (select a.entity, a.idx, b.idx as row_at, -b.r as l, count(*) over (partition by a.entity, a.idx) as t from rets a join rets b on a.entity = b.entity and b.idx between a.idx - {BW - 1} and greatest(a.idx, {K})),
rk as (select *, (rank() over (partition by entity, idx order by l) + (count(*) over (partition by entity, idx, l) - 1)/2.0)/(t + 1) as p from wr),
dv as (select entity, idx, row_at, -1/ln(p)/avg(-1/ln(p)) over (partition by entity, idx) as v from rk),
mn as (select idx, row_at, min(v) as low, count(*) as n from dv group by 1, 2)
select_final select idx, least(1.0, greatest(1/(avg(low)*max(n)), 1.0/max(n))) as d from mn group by 1""")
def _(m):
    return V.mgev_dependence(_losses(m), "loss", BW)


def _joint(m):
    x = _losses(m)
    return V.joint_var(V.mgev_margins(x, "loss", BW), V.mgev_dependence(x, "loss", BW), 0.90)


@query("joint_value_at_risk", ints="idx", nums="level, jvar")
def _(m):
    return _joint(m)


@query("joint_expected_shortfall", ints="idx", nums="jes")
def _(m):
    return V.joint_es(_joint(m))


@query("default_parameters", keys="entity", ints="idx", nums="threshold, weight, volume", sql=SHEET_SQL + f"""
v as (select *, sum(lb) over (partition by idx) as volume from bar)
select_final select entity, idx, {X.norm_inv('(1.0 - exp(-cds/0.55))')} as threshold, lb/volume as weight, volume from v""")
def _(m):
    return V.default_parameters(barriers(m))


@query("factor_loadings", keys="entity", ints="idx, factor", nums="loading")
def _(m):
    return V.factor_loadings(m.returns(), BW, 2)


# ---------------------------------------------------------------- liquidity

R = X.panel()
ALPHA = 2.0 / (BW + 1)
TURN = "case when cap <> 0 then volume/cap else 0.0 end"


def _scaled(src: str, c: str) -> str:
    return f"select entity, idx, ({c} - min({c}) over p)/(max({c}) over p - min({c}) over p) as {c} from {src} window p as (partition by entity)"


HHLR_SQL = R + f"""
rg as (select entity, idx, volume, cap, max(price) over w as hi, min(price) over w as lo from rets window w as (partition by entity order by idx rows between 4 preceding and current row)),
rh as (""" + X.head_fill("rg", ["hi", "lo"], T.head_rows(5)) + f"""),
rt as (select entity, idx, case when ({TURN}) <> 0 then ((hi - lo)/lo)/({TURN}) else 0.0 end as x from rh),
rf5 as (select entity, idx, case when idx <= 5 then avg(case when idx between 6 and 11 then x end) over (partition by entity) else x end as x from rt),
em as (""" + ewma_sql("rf5", "x", ALPHA) + ") select_final " + _scaled("(select entity, idx, ewma as hhlr from em)", "hhlr")


@query("liquidity_hhlr", keys="entity", ints="idx", nums="hhlr", sql=HHLR_SQL)
def _(m):
    return L.hhlr(m.returns(), BW, 5)


@query("liquidity_turnover", keys="entity", ints="idx", nums="tr", sql=R + f"tv as (select entity, idx, {TURN} as x from rets), em as ("
       + ewma_sql("tv", "x", ALPHA) + ") select_final " + _scaled("(select entity, idx, ewma as tr from em)", "tr"))
def _(m):
    return L.turnover(m.returns(), BW)


_VR = f"""
vl as (select entity, idx, var_samp(r) over w as v1, var_samp(r) over s as v2 from rets window w as (partition by entity order by idx rows between {BW - 1} preceding and current row),
  s as (partition by entity order by idx rows between 12 preceding and current row)),
v1 as (""" + X.head_fill("vl", ["v1"], K) + "), v2 as (" + X.head_fill("v1", ["v2"], T.head_rows(13)) + f"""),
vq as (select entity, idx, v1/({BW}/13.0*v2) as x from v2),
vf as (select entity, idx, case when idx <= 13 then avg(case when idx between 14 and 27 then x end) over (partition by entity) else x end as x from vq),
em as (""" + ewma_sql("vf", "x", ALPHA) + ") select_final select entity, idx, ewma as vr from em"


@query("liquidity_variance_ratio", keys="entity", ints="idx", nums="vr", sql=R + _VR)
def _(m):
    return L.variance_ratio(m.returns(), BW, 13)


def mag(m):
    """The power of ten of the whole panel, as one value that every row reads."""
    return T.magnitude(m.returns()).scalar()


AMI_SQL = R + f"""
mg as materialized ({MAGNITUDE_SQL}),
am0 as (select entity, idx, r, nullif(case when volume <> 0 then magnitude*abs(r)/volume end, 0) as x from rets, mg),
am as materialized (select entity, idx, r, coalesce(x, avg(x) over (partition by entity)) as v from am0),
"""


@query("amihud_input", keys="entity", ints="idx", nums="amihud", sql=AMI_SQL + "select_final select entity, idx, v as amihud from am")
def _(m):
    return L.amihud_input(m.returns(), mag(m))


def _mem_sql(a, g, b):
    return AMI_SQL + f"""
mn as (select entity, avg(v) as m from am group by 1),
mu(entity, idx, mu) as (select entity, 1, m from mn union all select u.entity, u.idx + 1,
  {1 - a - 0.5 * g - b!r} + ({a} + {g}*(case when r < 0 then 1 else 0 end))*v + {b}*u.mu from mu u join am on am.entity = u.entity and am.idx = u.idx where u.idx < (select max(idx) from am))
"""


@query("mem_mean", keys="entity", ints="idx", nums="mu", sql=_mem_sql(0.10, 0.0, 0.75) + "select_final select entity, idx, mu from mu")
def _(m):
    return L.mem_mean(L.amihud_input(m.returns(), mag(m)), "amihud", (0.10, 0.0, 0.75))


@query("mem_mean_asymmetric", keys="entity", ints="idx", nums="mu", sql=_mem_sql(0.05, 0.10, 0.70) + "select_final select entity, idx, mu from mu")
def _(m):
    return L.mem_mean(L.amihud_input(m.returns(), mag(m)), "amihud", (0.05, 0.10, 0.70), asymmetric=True)


@query("mem_fit", keys="entity", nums="a, b, gamma, loss")
def _(m):
    return L.mem_fit(L.amihud_input(m.returns(), mag(m)), "amihud")


@query("mem_fit_asymmetric", keys="entity", nums="a, g, b, gamma, loss")
def _(m):
    return L.mem_fit(L.amihud_input(m.returns(), mag(m)), "amihud", asymmetric=True)


@query("illiquidity", keys="entity", ints="idx", nums="illiq")
def _(m):
    return L.illiq(m.returns(), mag(m), BW)


def _with_states(m):
    from pyspark.sql import Window
    from riskpanel.plans.dynamics import STATES_COLS, with_states
    rows = with_states(m).withColumn("idx", F.row_number().over(Window.partitionBy("entity").orderBy("date")).cast("bigint"))
    return cut_lineage(rows), STATES_COLS


@query("illiquidity_with_states", keys="entity", ints="idx", nums="illiq")
def _(m):
    rows, controls = _with_states(m)
    return L.illiq(rows, mag(m), BW, controls)


@query("illiquidity_covariate_gap", keys="entity", ints="idx", nums="gap")
def _(m):
    rows, controls = _with_states(m)
    return L.covariate_gap(L.illiq(rows, mag(m), BW), L.illiq(rows, mag(m), BW, controls))


@query("roll_spread", keys="entity", ints="idx", nums="ris", sql=R + f"""
dd as (select entity, idx, ln(price) - lag(ln(price)) over (partition by entity order by idx) as d from rets),
dl as (select entity, idx, d, lag(d) over (partition by entity order by idx) as l from dd),
cv as (select entity, idx, covar_samp(d, l) over (partition by entity order by idx rows between {BW - 1} preceding and current row) as c from dl),
ch as (""" + X.head_fill("cv", ["c"], K) + """), rs as (select entity, idx, 2*sqrt(greatest(0.0, -coalesce(c, 0.0))) as x from ch),
em as (""" + ewma_sql("rs", "x", ALPHA) + ") select_final select entity, idx, ewma as ris from em")
def _(m):
    return L.roll_spread(m.returns(), BW)


# ---------------------------------------------------------------- regimes

def _regimes(m, k):
    rows = cut_lineage(m.returns().select("entity", "idx", "r"))
    return rows, cut_lineage(G.regime_fit(rows, k))


for _k in (2, 3, 4):
    @query(f"regime_fit_{_k}_states", keys="entity", nums=", ".join(G.parameter_names(_k)) + ", loss")
    def _(m, k=_k):
        return _regimes(m, k)[1]

    @query(f"regime_indicators_{_k}_states", ints="idx", nums="ap, jp")
    def _(m, k=_k):
        rows, params = _regimes(m, k)
        return G.regime_indicators(G.smoothed_probabilities(rows, params, k), k)


@query("regime_probabilities", keys="entity", ints="idx", nums="f1, f2, s1, s2, cmu, cs2, e")
def _(m):
    rows, params = _regimes(m, 2)
    return G.smoothed_probabilities(rows, params, 2)


@query("regime_durations", keys="entity", nums="duration1, duration2")
def _(m):
    return G.durations(_regimes(m, 2)[1], 2)


# Filter and smoother with given parameters; each is one recursion over the calendar.
SMOOTH_SQL = R + """
pr as (select entity, 1.5*var_samp(r) as c1, 0.5*var_samp(r) as c2, least(coalesce(avg(r) filter (r < 0), 0), -2e-6) as m1,
  greatest(coalesce(avg(r) filter (r > 0), 0), 2e-6) as m2, max(idx) as t from rets group by 1),
dz as materialized (select r.entity, idx, r, exp(-0.5*power(r - m1, 2)/c1)/sqrt(2*pi()*c1) as z1, exp(-0.5*power(r - m2, 2)/c2)/sqrt(2*pi()*c2) as z2, c1, c2, m1, m2, t
  from rets r join pr on r.entity = pr.entity),
fw(entity, idx, a1, a2, g1, g2) as (select entity, idx, 0.5::double, 0.5::double, z1/(z1 + z2), z2/(z1 + z2) from dz where idx = 1 union all
  select entity, idx, a1, a2, a1*z1/(a1*z1 + a2*z2), a2*z2/(a1*z1 + a2*z2) from (
    select d.entity, d.idx, 0.9*g1 + 0.1*g2 as a1, 0.1*g1 + 0.9*g2 as a2, z1, z2 from fw join dz d on d.entity = fw.entity and d.idx = fw.idx + 1)),
kept as materialized (select * from fw),
bw(entity, idx, s1, s2) as (select k.entity, k.idx, g1, g2 from kept k join pr on k.entity = pr.entity and k.idx = t union all
  select k.entity, k.idx, k.g1*(0.9*s1/n.a1 + 0.1*s2/n.a2), k.g2*(0.1*s1/n.a1 + 0.9*s2/n.a2) from bw
  join kept n on n.entity = bw.entity and n.idx = bw.idx join kept k on k.entity = bw.entity and k.idx = bw.idx - 1),
sm as (select k.entity, k.idx, g1 as f1, g2 as f2, s1, s2, a1*m1 + a2*m2 as cmu, a1*sqrt(c1) + a2*sqrt(c2) as cs2, r - (a1*m1 + a2*m2) as e0
  from kept k join bw b on k.entity = b.entity and k.idx = b.idx join dz d on d.entity = k.entity and d.idx = k.idx),
"""


def _smoothed(m):
    rows = cut_lineage(m.returns().select("entity", "idx", "r"))
    return G.smoothed_probabilities(rows, G.given_parameters(rows), 2)


@query("regime_probabilities_given", keys="entity", ints="idx", nums="f1, f2, s1, s2, cmu, cs2, e", sql=SMOOTH_SQL + """
select_final select *, (e0 - avg(e0) over (partition by entity))/stddev_samp(e0) over (partition by entity) as e from sm""")
def _(m):
    return _smoothed(m)


@query("regime_averages", ints="idx", nums="ap, jp", digits=9, sql=SMOOTH_SQL + "select_final select idx, avg(s1) as ap, product(s1) as jp from sm group by 1")
def _(m):
    return G.regime_indicators(_smoothed(m), 2)


# ---------------------------------------------------------------- spillovers between the four groups

def _vd(m, generalised=True, step=1):
    return P.variance_decomposition(group_panel(m), BW, 2, 4, generalised, step)


@query("variance_decomposition", keys="src, dst", ints="idx", nums="value")
def _(m):
    return _vd(m)


@query("variance_decomposition_orthogonal", keys="src, dst", ints="idx", nums="value")
def _(m):
    return _vd(m, generalised=False)


@query("variance_decomposition_filled", keys="src, dst", ints="idx", nums="value")
def _(m):
    panel = group_panel(m)
    return P.fill_decomposition(cut_lineage(_vd(m, step=10)), panel.select("idx"))


SHARES_SQL = GROUP_SQL + f"""
cp as (select a.idx, a.entity as src, b.entity as dst, a.r as x, b.r as y from gp0 a join gp0 b on a.idx = b.idx),
c2 as (select src, dst, idx, power(corr(x, y) over (partition by src, dst order by idx rows between {BW - 1} preceding and current row), 2) as v from cp),
c3 as (""" + X.head_fill("c2", ["v"], K, "src, dst") + """),
vd as materialized (select idx, src, dst, v/sum(v) over (partition by idx, src) as value from c3),
sff as (select idx, src as entity, least(greatest(sum(value), 0.0), 1.0) as sf from vd where src <> dst group by 1, 2),
stt as (select idx, dst as entity, sum(value) as st from vd where src <> dst group by 1, 2),
spill as materialized (select sff.idx, sff.entity, sf, st, st - sf as sn from sff join stt on sff.idx = stt.idx and sff.entity = stt.entity),
"""


def _shares(m):
    """A simple decomposition SQL can follow: squared window correlations, rows scaled to 1."""
    from pyspark.sql import Window
    from riskpanel.operators.component import rolling_cov
    cov = cut_lineage(rolling_cov(group_panel(m), BW))
    var = cov.filter("src = dst").select("idx", F.col("src").alias("e"), F.col("cov").alias("v"))
    j = cov.join(var.withColumnsRenamed({"e": "src", "v": "v1"}), ["idx", "src"]).join(var.withColumnsRenamed({"e": "dst", "v": "v2"}), ["idx", "dst"])
    sq = j.select("idx", "src", "dst", (F.col("cov") * F.col("cov") / F.col("v1") / F.col("v2")).alias("v"))
    both = sq.unionByName(sq.filter("src <> dst").select("idx", F.col("dst").alias("src"), F.col("src").alias("dst"), "v"))
    return both.withColumn("value", F.col("v") / F.sum("v").over(Window.partitionBy("idx", "src")))


@query("spillovers", keys="entity", ints="idx", nums="sf, st, sn", sql=SHARES_SQL + "select_final select * from spill")
def _(m):
    return P.spillovers(_shares(m))


@query("spillover_index", ints="idx", nums="si", sql=SHARES_SQL + """
dg as (select idx, sum(value) as d from vd where src = dst group by 1), sm as (select idx, sum(sf) as s from spill group by 1)
select_final select dg.idx, s/(d + s) as si from dg join sm on dg.idx = sm.idx""")
def _(m):
    return P.spillover_index(_shares(m))


@query("spillover_index_fitted", ints="idx", nums="si")
def _(m):
    return P.spillover_index(P.fill_decomposition(cut_lineage(_vd(m, step=10)), group_panel(m).select("idx")))


_SM = ", ".join(f"avg(b.{c}) as {c}" for c in ("sf", "st", "sn"))


@query("spillover_shares", keys="entity", ints="idx", nums="from_share, to_share, net_low, net_high", sql=SHARES_SQL + f"""
nn as (select max(idx) as n from spill),
sm as (select a.idx, a.entity, {_SM} from spill a, nn join spill b on a.entity = b.entity and b.idx between a.idx - least(a.idx - 1, n - a.idx, 10) and a.idx + least(a.idx - 1, n - a.idx, 10) group by 1, 2)
select_final select idx, entity, sf/sum(sf) over p as from_share, st/sum(st) over p as to_share, min(sn) over p as net_low, max(sn) over p as net_high from sm window p as (partition by idx)""")
def _(m):
    return P.spillover_shares(P.spillovers(_shares(m)), 21)


# ---------------------------------------------------------------- tail dependence

def tail_bandwidth(m):
    return A.expand_bandwidth(BW, m.observations().select("date").distinct().count() - 1)


BWT = 156
KT = T.head_rows(BWT)
Z975 = NormalDist().inv_cdf(0.975)
CHI_SQL = R + f"""
wr as (select a.entity, a.idx, b.idx as row_at, b.r, count(*) over (partition by a.entity, a.idx) as t from rets a join rets b on a.entity = b.entity and b.idx between a.idx - {BWT - 1} and greatest(a.idx, {KT})),
zz as materialized (select entity, idx, row_at, t, -1/ln(1 - (rank() over (partition by entity, idx order by r) + (count(*) over (partition by entity, idx, r) - 1)/2.0)/(t + 1)) as z from wr),
tp as (select a.idx, a.entity as src, b.entity as dst, a.t, list(least(a.z, b.z)) as zs from zz a join zz b on a.idx = b.idx and a.row_at = b.row_at and a.entity < b.entity group by 1, 2, 3, 4),
ts as (select idx, src, dst, t, greatest(cast(floor(t*0.1 + 0.5) as bigint), 1) as nu, list_reverse_sort(zs) as zs from tp),
et as (select *, zs[nu + 1] as base, case when nu = 1 then 0 else list_sum(list_transform(zs[1:nu], lambda v: ln(v/zs[nu + 1]))) end as eta from ts),
br as (select *, 2.0/(nu + 1)*eta - 1 as bar, case when idx <= {BWT} then 0.5 + 0.5*(idx - 1)/{BWT - 1}.0 else 1.0 end as damp from et),
chi as materialized (select idx, src, dst, (case when bar + {Z975!r}*(bar + 1)/sqrt(nu + 1) >= 1 then base*(nu + 1)/t else 0.0 end)*damp as chi, bar*damp as chi_bar from br),
"""


@query("tail_dependence", keys="src, dst", ints="idx", nums="chi, chi_bar", sql=CHI_SQL + "select_final select * from chi")
def _(m):
    return A.chi_pairs(m.returns(), tail_bandwidth(m))


@query("tail_dependence_indicators", ints="idx", nums="achi, adr", sql=CHI_SQL + """
select_final select idx, avg(chi) as achi, avg(case when chi > 0 then 1.0 else 0.0 end) as adr from chi group by 1""")
def _(m):
    return A.chi_metrics(A.chi_sums(m.returns(), tail_bandwidth(m)))


PENALTY_SQL = R + X.STATES + f"""
xs as (select entity as var, idx, r as x from rets union all select 'state ' || var, idx, value from states join (select distinct date, idx from rets) d on d.date = states.date),
win as materialized (select a.entity, a.idx, b.idx as row_at, b.r as y, row_number() over (partition by a.entity, a.idx order by b.r) as rk, count(*) over (partition by a.entity, a.idx) as t
  from rets a join rets b on a.entity = b.entity and b.idx between a.idx - {BW - 1} and greatest(a.idx, {K})),
qs as (select entity, idx, y as q from win where rk = floor(t*0.05) + 1),
el as (select w.entity, w.idx, q, max(row_at) as e from win w join qs on w.entity = qs.entity and w.idx = qs.idx and w.y = qs.q group by 1, 2, 3),
wt as (select w.entity, w.idx, row_at, e, case when y < q then 0.95 when y > q then -0.05 else 0 end as g from win w join el on w.entity = el.entity and w.idx = el.idx),
gn as (select wt.entity, wt.idx, v.var, sum(g*(coalesce(x.x, 0) - coalesce(xe.x, 0))) as gain from wt cross join (select distinct var from xs) v left join xs x on x.var = v.var and x.idx = wt.row_at
  left join xs xe on xe.var = v.var and xe.idx = wt.e where v.var <> wt.entity group by 1, 2, 3),
pen as (select entity, idx, abs(least(min(gain), 0.0)) as penalty from gn group by 1, 2),
"""


def _penalties(m):
    r = m.returns()
    states = m.states().join(r.select("date", "idx").distinct(), "date").select("var", "idx", "value")
    return A.entry_penalty(r, states, BW, 0.05)


@query("tail_entry_penalty", keys="entity", ints="idx", nums="penalty", sql=PENALTY_SQL + "select_final select * from pen")
def _(m):
    return _penalties(m)


@query("financial_risk_meter", ints="idx", nums="frm", sql=PENALTY_SQL + "select_final select idx, avg(penalty) as frm from pen group by 1")
def _(m):
    return A.frm(_penalties(m))
