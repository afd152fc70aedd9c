"""Component and cross-entropy queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskpanel.functions.scalar import half_up
from riskpanel.operators import component as C
from riskpanel.operators import describe as D
from riskpanel.operators import entropy as E
from riskpanel.operators import transforms as T
from riskpanel.plans import sqltext as X
from riskpanel.plans.registry import query
from riskpanel.plans.transforms import with_liabilities
from riskpanel.session import cut_lineage
from riskpanel.sources import panels

BW = 52
K = T.head_rows(BW)
A = 0.05
R = X.panel()


@query("rolling_cov", keys="src, dst", ints="idx", nums="cov", digits=8, sql=R + f"""
pr as (select a.entity as src, b.entity as dst, a.idx, a.r as x, b.r as y from rets a join rets b on a.idx = b.idx and a.entity <= b.entity),
cv as (select src, dst, idx, covar_samp(x, y) over (partition by src, dst order by idx rows between {BW - 1} preceding and current row) as cov from pr)
select_final """ + X.head_fill("cv", ["cov"], K, "src, dst"))
def _(m):
    return C.rolling_cov(m.returns(), BW)


@query("component_indicators", ints="idx", nums="ar, cs, ti")
def _(m):
    return C.component_metrics(m.returns(), BW, 0.2)


@query("correlation_surprise_denominator", ints="idx", nums="denominator", sql=R + f"""
v as (select entity, idx, r - avg(r) over p as v, var_samp(r) over f as s2 from rets
  window p as (partition by entity order by idx rows between {BW - 1} preceding and 1 preceding),
  f as (partition by entity order by idx rows between {BW - 1} preceding and current row))
select_final select idx, sum(v*v/s2) as denominator from v where idx >= {BW} group by 1""")
def _(m):
    return C.surprise_denominator(m.returns(), BW)


@query("window_pca", keys="entity", ints="idx, component", nums="loading, explained")
def _(m):
    return C.window_pca(m.returns(), BW)


@query("explained_sums", ints="idx, component", nums="explained_sum")
def _(m):
    return C.explained_sums(C.window_pca(m.returns(), BW))


def _measures_pca(m):
    from riskpanel.plans.describe import _MEASURES, measures
    return C.pca_wide(measures(m), list(_MEASURES), ["date"]), list(_MEASURES)


@query("pca_overall_scores", keys="date", nums="pc1, pc2, pc3")
def _(m):
    (_, _, scores), _ = _measures_pca(m)
    return scores


@query("pca_biplot", keys="date", nums="pc1, pc2, pc3")
def _(m):
    (load, _, scores), cols = _measures_pca(m)
    return C.pca_biplot(load, cols, scores, ["date"])


WINDOWS_SQL = R + f"""
rp as (select idx, avg(r) as rp from rets group by 1),
win as materialized (select w.idx, b.idx as at, b.rp, row_number() over (partition by w.idx order by b.idx) as pos, count(*) over (partition by w.idx) as t
  from rp w join rp b on b.idx between w.idx - {BW - 1} and greatest(w.idx, {K})),
"""


def _rp(m):
    return T.equal_weight_portfolio(m.returns())


@query("var_nonparametric", ints="idx", nums="var_np", sql=WINDOWS_SQL + f"""
c as (select idx, rp, sum((1 - 0.98)/(1 - power(0.98, t))*power(0.98, t - pos)) over (partition by idx order by rp, pos rows unbounded preceding) as cum from win)
select_final select idx, least(min(rp), 0.0) as var_np from c where cum >= {A} - 1e-12 group by 1""")
def _(m):
    return C.var_nonparametric(_rp(m), BW, A)


GPD_SQL = f"""
ls as (select *, -rp as loss, row_number() over (partition by idx order by -rp, pos) as rk from win),
th as (select idx, loss as threshold from ls where rk = t - 20),
ex as (select ls.idx, ls.t, threshold, loss - threshold as y, row_number() over (partition by ls.idx order by loss, pos) as i,
  count(*) over (partition by ls.idx) as n from ls join th on ls.idx = th.idx where loss > threshold),
gp as (select idx, t, threshold, avg(y) as a0, avg(y*(1 - (i - 0.35)/n)) as a1 from ex group by 1, 2, 3),
gq as (select *, 2 - a0/(a0 - 2*a1) as xi, 2*a0*a1/(a0 - 2*a1) as beta from gp),
gpd as (select idx, least(-(threshold + beta/xi*(power(t/20.0*{A}, -xi) - 1)), 0.0) as var_gpd from gq)
"""


@query("var_gpd", ints="idx", nums="var_gpd", sql=WINDOWS_SQL + GPD_SQL + "select_final select idx, var_gpd from gpd")
def _(m):
    return C.var_gpd(_rp(m), BW, A)


THETA_SQL = """
kk as (select *, greatest(floor(power(t, 1/1.81) + 0.5), 5) as k from win),
mx as (select a.idx, a.t, a.k, a.pos, max(b.rp) as top from kk a join kk b on a.idx = b.idx and b.pos between a.pos and a.pos + a.k - 1
  where a.pos <= a.t - a.k + 1 group by 1, 2, 3, 4),
sh as (select mx.idx, mx.pos, mx.k, sum(case when w.rp <= top then 1 else 0 end)/mx.t as share from mx join win w on mx.idx = w.idx group by mx.idx, mx.pos, mx.k, mx.t),
th0 as (select idx, 1/avg(-k*ln(share)) as theta from sh group by 1)
"""


@query("extremal_index", ints="idx", nums="theta", sql=WINDOWS_SQL + THETA_SQL + "select_final select idx, theta from th0")
def _(m):
    return C.extremal_index(_rp(m), BW)


GEV_SQL = f""",
bl as (select idx, t, k, least(floor((pos - 1)/floor(t/k)), k - 1) as block, max(rp) as x from kk group by 1, 2, 3, 4),
jj as (select *, row_number() over (partition by idx order by x, block) - 1 as j from bl),
bs as (select idx, t, k, avg(x) as b0, avg(x*j/(k - 1)) as b1, avg(x*j*(j - 1)/((k - 1)*(k - 2))) as b2 from jj group by 1, 2, 3),
lm as (select *, 2*b1 - b0 as l2, 2/(3 + (6*b2 - 6*b1 + b0)/(2*b1 - b0)) - ln(2)/ln(3) as c from bs),
hh as (select *, 7.8590*c + 2.9554*c*c as h from lm), gg as (select *, gamma(1 + h) as g from hh),
si as (select *, l2*h/((1 - power(2, -h))*g) as sigma from gg), mu as (select *, b0 - sigma*(1 - g)/h as mu, -h as xi from si),
gev as (select mu.idx, least(-(mu - sigma/xi*(1 - power(-(t/k)*theta*ln(1 - {A}), -xi))), 0.0) as var_gev from mu join th0 on mu.idx = th0.idx)
"""


@query("var_gev", ints="idx", nums="var_gev", sql=WINDOWS_SQL + THETA_SQL + GEV_SQL + "select_final select idx, var_gev from gev")
def _(m):
    return C.var_gev(_rp(m), BW, A)


@query("catfin", ints="idx", nums="var_np, var_gpd, var_gev, catfin")
def _(m):
    return C.catfin(_rp(m), BW, A)


# ---------------------------------------------------------------- cross entropy on the four groups

def group_panel(m):
    """Group returns and spreads as a panel whose entities are the group names."""
    g = T.group_aggregate(m.returns(), panels.entity_groups(m.observations(), m.groups()))
    return cut_lineage(g.withColumnRenamed("short_name", "entity"))


GROUP_SQL = R + X.ENTITY_GROUP + """
gp0 as materialized (select short_name as entity, idx, date, avg(r) as r, avg(cds) as cds, sum(cap) as cap from rets join entity_group using (entity) group by 1, 2, 3),
"""
POD_SQL = f"""
pw as (select a.entity, a.idx, sum(b.cds/0.4*power(0.98, a.idx - b.idx))*(1 - 0.98)/(1 - power(0.98, count(*))) as pod
  from gp0 a join gp0 b on a.entity = b.entity and b.idx between a.idx - {BW - 1} and a.idx group by 1, 2),
pods as materialized (""" + X.head_fill("pw", ["pod"], K) + "),"


@query("default_probabilities", keys="entity", ints="idx", nums="pod", sql=GROUP_SQL + POD_SQL + "select_final select entity, idx, pod from pods")
def _(m):
    return E.pods(group_panel(m), BW)


@query("default_probabilities_plain", keys="entity", ints="idx", nums="pod", digits=9, sql=GROUP_SQL + f"""
pw as (select entity, idx, avg(cds/0.4) over (partition by entity order by idx rows between {BW - 1} preceding and current row) as pod from gp0)
select_final """ + X.head_fill("pw", ["pod"], K))
def _(m):
    return E.pods(group_panel(m), BW, weighted=False)


@query("orthants", ints="state, defaults", sql="""
n as (select count(distinct l_returnflag || l_linestatus) as n from lineitem)
select_final select s as state, bit_count(s) as defaults from n, range(0, cast(power(2, n) as bigint)) t(s)""")
def _(m):
    n = m.table("lineitem").select("l_returnflag", "l_linestatus").distinct().count()
    return E.orthants(m.spark, n)


def _portfolio(m, panel):
    return E.members(panel.select(F.lit("groups").alias("portfolio"), "idx", "entity"))


def _prior(m):
    panel = group_panel(m)
    member, pod = _portfolio(m, panel), cut_lineage(E.pods(panel, BW))
    return cut_lineage(E.orthant_prior(panel, member, pod, BW, 4)), member, pod


PRIOR_SQL = GROUP_SQL + POD_SQL + f"""
st0 as (select entity, idx, avg(r) over w as mu, stddev_samp(r) over w as sd from gp0
  window w as (partition by entity order by idx rows between {BW - 1} preceding and current row)),
st as (""" + X.head_fill("st0", ["mu", "sd"], K) + f"""),
lv as (select p.entity, p.idx, pod, row_number() over (partition by p.idx order by p.entity) - 1 as slot, mu + sd*{X.norm_inv('(1.0 - pod)')} as level
  from pods p join st on p.entity = st.entity and p.idx = st.idx),
sts as (select l.idx, b.idx as at, sum(case when b.r > level then cast(1 as bigint) << slot else 0 end) as state from lv l join gp0 b
  on l.entity = b.entity and b.idx between l.idx - {BW - 1} and greatest(l.idx, {K}) group by 1, 2),
tt as (select idx, count(*) as t from sts group by 1), ct as (select idx, state, count(*) as c from sts group by 1, 2),
states as materialized (select tt.idx, s as state, (coalesce(c, 0) + 1/16.0)/(t + 1.0) as p from tt cross join range(0, 16) r(s) left join ct on ct.idx = tt.idx and ct.state = s),
"""


@query("orthant_prior", ints="idx, state", nums="p", sql=PRIOR_SQL + "select_final select idx, state, p from states")
def _(m):
    return _prior(m)[0]


_BIT = "(s >> (k % 4)) & 1 = 1"
# Each step of the recursion fits one member's marginal; a table is a list of 16 numbers.
POST_SQL = PRIOR_SQL.replace("states as materialized", "prior_states as materialized") + f"""
tabs as (select idx, list(p order by state) as p from prior_states group by 1), targets as (select idx, list(pod order by slot) as t from lv group by 1),
ipf(idx, k, p) as (select idx, 0, p from tabs union all
  select u.idx, k + 1, list_transform(range(0, 16), lambda s: case when {_BIT} then p[s + 1]*t[k % 4 + 1]/m else p[s + 1]*(1 - t[k % 4 + 1])/(1 - m) end)
  from (select idx, k, p, list_sum(list_transform(range(0, 16), lambda s: case when {_BIT} then p[s + 1] else 0.0 end)) as m from ipf where k < 400) u
  join targets on targets.idx = u.idx),
states as materialized (select idx, unnest(range(0, 16)) as state, unnest(p) as p from ipf where k = 400),
"""


def _post(m):
    prior, member, pod = _prior(m)
    return cut_lineage(E.min_xent_posterior(prior, member, pod, 4)), member, pod


@query("min_xent_posterior", ints="idx, state", nums="p", sql=POST_SQL + "select_final select idx, state, p from states")
def _(m):
    return _post(m)[0]


JOINT_SQL = """
js as (select idx, sum(p) filter (bit_count(state) = 4) as jpod, sum(p) filter (state = 0) as p0, sum(p) filter (bit_count(state) >= 2) as p2,
  sum(p) filter (bit_count(state) >= 1) as p1 from states group by 1), sp as (select idx, sum(pod) as s from pods group by 1),
joint_ind as (select js.idx, jpod, least(greatest(s/(1 - p0), 1.0), 4.0) as fsi, p2/p1 as pce from js join sp on js.idx = sp.idx),
"""


@query("cross_entropy_indicators", ints="idx", nums="jpod, fsi, pce", sql=POST_SQL + JOINT_SQL + "select_final select * from joint_ind")
@query("joint_default_indicators", ints="idx", nums="jpod, fsi, pce", sql=POST_SQL + JOINT_SQL + "select_final select * from joint_ind")
def _(m):
    post, member, pod = _post(m)
    return E.joint_indicators(post, member, pod, 4)


DIDE_SQL = """
dide as materialized (select a.idx, a.entity as src, b.entity as dst, a.pod as pod_src, case when a.entity = b.entity then 1.0 else s.p/b.pod end as dide
  from lv a join lv b on a.idx = b.idx left join states s on s.idx = a.idx and a.slot <> b.slot and s.state = (cast(1 as bigint) << a.slot) + (cast(1 as bigint) << b.slot)),
"""


@query("distress_dependence", keys="src, dst", ints="idx", nums="dide", sql=POST_SQL + DIDE_SQL + "select_final select idx, src, dst, dide from dide")
def _(m):
    return E.distress_dependence(*_post(m))


IMPACT_SQL = """
off as (select idx, src, dst, dide*pod_src as v from dide where src <> dst),
si as (select idx, src as entity, sum(v) as si from off group by 1, 2), sv as (select idx, dst as entity, sum(v) as sv from off group by 1, 2),
impact as (select si.idx, si.entity, si, sv from si join sv on si.idx = sv.idx and si.entity = sv.entity),
"""


@query("systemic_impact", keys="entity", ints="idx", nums="si, sv", sql=POST_SQL + DIDE_SQL + IMPACT_SQL + "select_final select * from impact")
def _(m):
    return E.systemic_impact(E.distress_dependence(*_post(m)))


@query("systemic_impact_scaled", keys="entity", ints="idx", nums="si, sv", sql=POST_SQL + DIDE_SQL + IMPACT_SQL + """
select_final select idx, entity, (si - min(si) over ())/(max(si) over () - min(si) over ()) as si, (sv - min(sv) over ())/(max(sv) over () - min(sv) over ()) as sv from impact""")
def _(m):
    return E.scaled_impact(E.systemic_impact(E.distress_dependence(*_post(m))))


@query("conditional_joint_pods", keys="entity", ints="idx", nums="cojpod", sql=POST_SQL + JOINT_SQL + """
select_final select p.idx, p.entity, jpod/pod as cojpod from pods p join joint_ind j on p.idx = j.idx""")
def _(m):
    post, member, pod = _post(m)
    return E.cojpods(E.joint_indicators(post, member, pod, 4), member, pod)


@query("average_distress_dependence", keys="src, dst, flagged", nums="dide", sql=POST_SQL + DIDE_SQL + """
select_final select src, dst, avg(dide) as dide, case when src <> dst then avg(dide) >= 0.2 end as flagged from dide group by 1, 2""")
def _(m):
    avg = E.average_dide(E.distress_dependence(*_post(m)))
    return D.threshold_matrix(avg, "dide", 0.2, inclusive=True).withColumn("flagged", F.col("flag") == 1)


@query("portfolio_indicators", ints="idx", nums="jpod, fsi, pce")
def _(m):
    """Four portfolios per date (3 largest and 3 smallest by spread, risk, size, liabilities), averaged."""
    r = with_liabilities(m)
    keyed = T.rolling(r, BW, risk=F.stddev_samp("r"))
    parts = None
    for name in ("cds", "risk", "cap", "lb"):
        picked = T.rank_topbottom(keyed.filter(F.col(name).isNotNull()), name, 3).select(F.lit(name).alias("portfolio"), "idx", "entity")
        parts = picked if parts is None else parts.unionByName(picked)
    member, pod = E.members(parts), E.pods(r, BW)
    prior = E.orthant_prior(r, member, pod, BW, 6)
    return E.average_over_portfolios(E.joint_indicators(E.min_xent_posterior(prior, member, pod, 6), member, pod, 6))
