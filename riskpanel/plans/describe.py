"""Scalar functions, descriptive statistics and tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskpanel.functions import order as O
from riskpanel.functions import scalar as S
from riskpanel.operators import describe as D
from riskpanel.operators import transforms as T
from riskpanel.plans import sqltext as X
from riskpanel.plans.registry import query
from riskpanel.plans.transforms import EWMA_A, ewma_sql

SUP = X.panel("supplier")
BRAND = X.panel()


def chi2_sf_sql(x: str, df: str) -> str:
    if float(df) == 1.0:
        return f"2.0*{X.norm_cdf(f'(-sqrt({x}))')}"
    v = f"(2.0/(9.0*{df}))"
    return f"(1.0 - {X.norm_cdf(f'((power(({x})/({df}), 1.0/3.0) - (1.0 - {v}))/sqrt({v}))')})"


def t_sf_sql(t: str, df: str) -> str:
    z = f"(sqrt({df}*ln(1.0 + ({t})*({t})/{df}))*(8.0*{df} + 1.0)/(8.0*{df} + 3.0))"
    c = X.norm_cdf(z)
    return f"(case when ({t}) >= 0 then 1.0 - {c} else {c} end)"


def f_inv_sql(p: str, d1: str, d2: str) -> str:
    a, b, z = f"(2.0/(9.0*{d1}))", f"(2.0/(9.0*{d2}))", X.norm_inv(p)
    den = f"((1.0-{b})*(1.0-{b}) - {z}*{z}*{b})"
    num = f"((1.0-{a})*(1.0-{b}) + {z}*sqrt({a}*(1.0-{b})*(1.0-{b}) + {b}*(1.0-{a})*(1.0-{a}) - {a}*{b}*{z}*{z}))"
    return f"power({num}/{den}, 3.0)"


@query("norm_functions", keys="entity, date", nums="cdf, pdf, inv", sql=SUP + f"""
u as (select entity, date, r*4.0 as x, (row_number() over (partition by entity order by r, date) - 0.375)/(count(*) over (partition by entity) + 0.25) as p from rets)
select_final select entity, date, {X.norm_cdf('x')} as cdf, exp(-0.5*x*x)/sqrt(2*pi()) as pdf, {X.norm_inv('p')} as inv from u""")
def _(m):
    from pyspark.sql import Window
    w = Window.partitionBy("entity")
    u = m.returns("supplier").withColumn("x", F.col("r") * 4.0).withColumn(
        "p", (F.row_number().over(w.orderBy("r", "date")) - 0.375) / (F.count("r").over(w) + 0.25))
    return u.select("entity", "date", S.norm_cdf(F.col("x")).alias("cdf"), S.norm_pdf(F.col("x")).alias("pdf"),
                    S.norm_inv(F.col("p")).alias("inv"))


@query("quantile_hf5", keys="entity", nums="q05, q50, q95", sql=SUP + f"""
l as (select entity, list(r order by r) as x from rets group by 1)
select_final select entity, {X.hf5('x', 0.05)} as q05, {X.hf5('x', 0.5)} as q50, {X.hf5('x', 0.95)} as q95 from l""")
def _(m):
    return m.returns("supplier").groupBy("entity").agg(*[O.quantile_hf5("r", p).alias(n) for n, p in
                                                         (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))])


@query("quantile_hf7", keys="entity", nums="q05, q95", sql=SUP + """
select_final select entity, quantile_cont(r, 0.05) as q05, quantile_cont(r, 0.95) as q95 from rets group by 1""")
def _(m):
    return m.returns("supplier").groupBy("entity").agg(O.quantile_hf7("r", 0.05).alias("q05"), O.quantile_hf7("r", 0.95).alias("q95"))


@query("distribution_tails", keys="entity", nums="chi2_tail, t_tail, f_critical", sql=SUP + f"""
g as (select entity, avg(r)/(stddev_samp(r)/sqrt(count(*))) as t, cast(count(*) - 1 as double) as df from rets group by 1)
select_final select entity, {chi2_sf_sql('t*t', '1.0')} as chi2_tail, {t_sf_sql('t', 'df')} as t_tail,
  {f_inv_sql('0.95::double', '3.0', 'df')} as f_critical from g""")
def _(m):
    g = m.returns("supplier").groupBy("entity").agg(
        (F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r")))).alias("t"), (F.count("r") - 1).cast("double").alias("df"))
    t, df = F.col("t"), F.col("df")
    return g.select("entity", S.chi2_sf(t * t, F.lit(1.0)).alias("chi2_tail"), S.t_sf(t, df).alias("t_tail"),
                    S.f_inv(F.lit(0.95), F.lit(3.0), df).alias("f_critical"))


@query("tied_rank", keys="entity, date", nums="ranked", sql=SUP + """
select_final select entity, date, rank() over (partition by entity order by c) + (count(*) over (partition by entity, c) - 1)/2.0 as ranked
from (select entity, date, round(cds, 9) as c from rets)""")
def _(m):
    return O.tied_rank(m.returns("supplier").withColumn("c", F.round("cds", 9)), ["entity"], "c", "ranked")


_IC = {"aic": "k*ln(sse/k) + 2.0*d", "bic": "k*ln(sse/k) + ln(k)*d", "fpe": "k*ln(sse/k) + ln((k+d+1.0)/(k-d-1.0))",
       "hqic": "k*ln(sse/k) + 2.0*ln(ln(k))*d"}


@query("information_criteria", keys="entity", nums="aic, bic, fpe, hqic", sql=SUP + """
lagged as (select entity, r, lag(r) over (partition by entity order by idx) as p from rets),
g as (select entity, cast(regr_count(r, p) as double) as k, regr_syy(r, p)*(1 - regr_r2(r, p)) as sse, 2.0 as d from lagged group by 1)
select_final select entity, """ + ", ".join(f"{v} as {k}" for k, v in _IC.items()) + " from g")
def _(m):
    lagged = m.returns("supplier").withColumn("p", F.lag("r").over(T.series()))
    g = lagged.groupBy("entity").agg(F.regr_count("r", "p").cast("double").alias("k"),
                                     (F.regr_syy("r", "p") * (1 - F.regr_r2("r", "p"))).alias("sse"))
    return g.select("entity", *[O.criterion(c.upper(), F.col("sse"), F.col("k"), F.lit(2.0)).alias(c) for c in _IC])


@query("describe_returns", keys="entity", ints="n", nums="max, min, mean, median, std, skewness, kurtosis", sql=SUP + """
select_final select entity, count(r) as n, max(r) as max, min(r) as min, avg(r) as mean, median(r) as median, stddev_samp(r) as std,
  skewness(r) as skewness, kurtosis(r) + 3.0 as kurtosis from rets group by 1""")
def _(m):
    return D.describe_returns(m.returns("supplier"), "r")


@query("box_stats", keys="entity", nums="q1, median, q3, adjacent_low, adjacent_high", sql=SUP + f"""
l as (select entity, list(r order by r) as x from rets group by 1),
q as (select entity, x, {X.hf5('x', 0.25)} as q1, {X.hf5('x', 0.5)} as median, {X.hf5('x', 0.75)} as q3 from l)
select_final select q.entity, q1, median, q3, min(r) as adjacent_low, max(r) as adjacent_high from q join rets on q.entity = rets.entity
  and r between q1 - 1.5*(q3 - q1) and q3 + 1.5*(q3 - q1) group by 1, 2, 3, 4""")
def _(m):
    return D.box_stats(m.returns("supplier"), "r")


@query("histogram_pdf", keys="entity", ints="bin, hits", nums="density", sql=SUP + """
e as (select entity, r, min(r) over p as lo, (max(r) over p - min(r) over p)/50 as w, count(*) over p as n from rets window p as (partition by entity))
select_final select entity, least(floor((r - lo)/w), 49) as bin, count(*) as hits, count(*)/(n*w) as density from e group by entity, bin, n, w""")
def _(m):
    return D.histogram_pdf(m.returns("supplier"), "r", 50)


@query("kde_grid", keys="entity", ints="point", nums="grid_x, density", sql=SUP + """
md as (select entity, median(r) as med from rets group by 1),
s as (select entity, count(*) as n, min(r) as lo, max(r) as hi, median(abs(r - med)) as mad from rets join md using (entity) group by 1),
h as (select *, mad/0.6745*power(4.0/(3.0*n), 0.2) as h from s),
grid_pts as (select entity, n, h, unnest(range(100)) as point, lo - 3*h as a, hi + 3*h as b from h),
pts as (select *, a + (b - a)*point/99.0 as "at" from grid_pts)
select_final select entity, point, "at" as grid_x, sum(exp(-0.5*power(("at" - r)/h, 2)))/(n*h)*0.3989422804014327 as density
from pts join rets using (entity) group by entity, point, "at", n, h""")
def _(m):
    return D.kde_grid(m.returns("supplier"), "r", 100).withColumnRenamed("at", "grid_x")


_RANKED = SUP + f"""
rk as (select entity, r as x, row_number() over (partition by entity order by r) as i, count(*) over (partition by entity) as n from rets),
sc as materialized (select *, {X.norm_inv('((i - 0.375)/(n + 0.25))')} as m from rk),
fr as (select entity, n, sum(m*x)*sum(m*x)/(sum(m*m)*var_pop(x)*count(*)) as k, ln(n) as nu from sc group by entity, n),
francia as (select entity, n, (ln(1 - k) - (-1.27250 + 1.05210*(ln(nu) - nu)))/(1.03080 - 0.26758*(ln(nu) + 2/nu)) as stat from fr),
ag as (select entity, n, sum(m*m) as mm, max(m) as ml, max(case when i = n - 1 then m end) as ms,
  sum(case when i > 2 and i < n - 1 then m*x else 0 end) as mx, max(x) - min(x) as dl,
  max(case when i = n - 1 then x end) - max(case when i = 2 then x end) as ds, var_pop(x)*count(*) as xx, 1/sqrt(n) as u from sc group by entity, n),
wt as (select *, -2.7060560*power(u,5) + 4.434685*power(u,4) - 2.071190*power(u,3) - 0.147981*u*u + 0.221157*u + ml/sqrt(mm) as wl,
  -3.5826330*power(u,5) + 5.682633*power(u,4) - 1.752461*power(u,3) - 0.293762*u*u + 0.042981*u + ms/sqrt(mm) as ws from ag),
kk as (select entity, n, ln(n) as l, power(wl*dl + ws*ds + mx/sqrt((mm - 2*ml*ml - 2*ms*ms)/(1 - 2*wl*wl - 2*ws*ws)), 2)/xx as k from wt),
wilk as (select entity, n, (ln(1 - k) - (0.0038915*power(l,3) - 0.083751*l*l - 0.310820*l - 1.586100))/exp(0.0030302*l*l - 0.082676*l - 0.480300) as stat from kk)
"""


@query("shapiro_francia", keys="entity", ints="n", nums="stat, p_value", sql=_RANKED + f"""
select_final select entity, n, stat, 1 - {X.norm_cdf('stat')} as p_value from francia""")
def _(m):
    return D.shapiro_francia(m.returns("supplier"), "r")


@query("shapiro_wilk", keys="entity", ints="n", nums="stat, p_value", sql=_RANKED + f"""
select_final select entity, n, stat, 1 - {X.norm_cdf('stat')} as p_value from wilk""")
def _(m):
    return D.shapiro_wilk(m.returns("supplier"), "r")


@query("shapiro_test", keys="entity, heavy, rejected", nums="stat", sql=_RANKED + f"""
, hv as (select entity, kurtosis_pop(r) > 0 as heavy from rets group by 1)
select_final select entity, heavy, stat, (1 - {X.norm_cdf('stat')}) <= 0.05 as rejected from (
  select h.entity, h.heavy, case when heavy then f.stat else w.stat end as stat from hv h join francia f on h.entity = f.entity join wilk w on h.entity = w.entity)""")
def _(m):
    return D.shapiro_test(m.returns("supplier"), "r")


_SQ = """
e1 as (select entity, idx, power(r - avg(r) over (partition by entity), 2) as e from rets),
e2 as (select entity, idx, e, e - avg(e) over (partition by entity) as d from e1),
"""


@query("ljung_box", keys="entity", ints="n", nums="stat, p_value", sql=SUP + _SQ + f"""
c as (select a.entity, b.idx - a.idx as k, sum(a.d*b.d) as ck from e2 a join e2 b on a.entity = b.entity and b.idx - a.idx between 0 and 20 group by 1, 2),
z as (select entity, count(*) as n, sum(d*d) as c0 from e2 group by 1),
q as (select z.entity, n, n*(n + 2.0)*sum(power(ck/c0, 2)/(n - k)) as stat from z join c on z.entity = c.entity where k >= 1 group by 1, 2)
select_final select entity, n, stat, {chi2_sf_sql('stat', '20.0')} as p_value from q""")
def _(m):
    return D.ljung_box(m.returns("supplier"), "r", 20)


@query("arch_lm", keys="entity", nums="stat, p_value", sql=SUP + _SQ + f"""
l as (select entity, e, lag(e) over (partition by entity order by idx) as p from e1),
q as (select entity, regr_r2(e, p)*regr_count(e, p) as stat from l group by 1)
select_final select entity, stat, {chi2_sf_sql('stat', '1.0')} as p_value from q""")
def _(m):
    return D.arch_lm(m.returns("supplier"), "r")


_MEASURES = ("ew", "dispersion", "volume", "spread", "concentration")
MEASURES_SQL = """
measures as materialized (select date, row_number() over (order by date) as idx, ew, dispersion, volume, spread, concentration from (
  select date, avg(r) as ew, stddev_samp(r) as dispersion, sum(volume)/1e6 as volume, avg(cds)*100 as spread,
    max(cap)/sum(cap) as concentration from rets group by 1)),
"""


def measures(m):
    """Five simple market indicators, one row per week: the input of the comparison queries."""
    return m.returns().groupBy("date", "idx").agg(
        F.avg("r").alias("ew"), F.stddev_samp("r").alias("dispersion"), (F.sum("volume") / 1e6).alias("volume"),
        (F.avg("cds") * 100).alias("spread"), (F.max("cap") / F.sum("cap")).alias("concentration"))


_CORR = " union all ".join(f"select '{a}' as left_name, '{b}' as right_name, corr({a}, {b}) as r, cast(count(*) as double) as n from measures"
                           for a, b in combinations(_MEASURES, 2))
_TVAL = "(r*sqrt((n - 2)/(1 - r*r)))"


@query("corr_matrix", keys="left_name, right_name", ints="n", nums="r, p_value", sql=BRAND + MEASURES_SQL + f"""
p as ({_CORR}) select_final select left_name, right_name, n, r, 2.0*{t_sf_sql(f'abs{_TVAL}', '(n - 2)')} as p_value from p""")
def _(m):
    out = D.corr_matrix(measures(m), list(_MEASURES))
    return out.withColumnsRenamed({"left": "left_name", "right": "right_name"})


@query("window_threshold", keys="entity, date, above", nums="threshold", sql=BRAND + "em as (" + ewma_sql("rets", "cds", EWMA_A) + f"""),
w as (select a.entity, a.date, a.idx, list(b.cds order by b.cds) as x from rets a join rets b on a.entity = b.entity and b.idx between a.idx - 52 and a.idx + 52 group by 1, 2, 3),
q as (select entity, date, idx, {X.hf5('x', 0.75)} as threshold from w)
select_final select q.entity, date, ewma > threshold as above, threshold from q join em on q.entity = em.entity and q.idx = em.idx""", digits=9)
def _(m):
    r = m.returns()
    return D.window_threshold(r.join(T.ewma(r, "cds", 52), ["entity", "idx"]), "cds", "ewma", 52, 0.75)


@query("three_sigma_filter", keys="entity, date", nums="kept, rescaled", sql=SUP + """
k as (select entity, date, case when abs(r - avg(r) over p) <= 3.0*stddev_samp(r) over p then r end as kept from rets window p as (partition by entity))
select_final select entity, date, kept, 0.25 + 0.5*(kept - min(kept) over p)/(max(kept) over p - min(kept) over p) as rescaled from k window p as (partition by entity)""")
def _(m):
    return D.three_sigma_filter(m.returns("supplier"), "r")


@query("rank_table", keys="entity", ints="position", nums="vol", sql=SUP + """
v as (select entity, stddev_samp(r) as vol from rets group by 1)
select_final select entity, vol, row_number() over (order by vol desc, entity) as position from v""")
def _(m):
    return D.rank_table(m.returns("supplier").groupBy("entity").agg(F.stddev_samp("r").alias("vol")), "vol")
