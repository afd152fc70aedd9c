"""Comparison of indicators over the weekly panel."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskpanel.operators import compare as K
from riskpanel.operators import describe as D
from riskpanel.plans import sqltext as X
from riskpanel.plans.describe import _MEASURES, MEASURES_SQL, f_inv_sql, measures
from riskpanel.plans.registry import query
from riskpanel.session import cut_lineage
from riskpanel.sources import panels

COLS = list(_MEASURES)
Z = ", ".join(f"({c} - avg({c}) over ())/stddev_pop({c}) over () as {c}" for c in COLS)
PAIRS = " union all ".join(f"select '{a}' as left_name, '{b}' as right_name, idx, {a} as x, {b} as y from std" for a, b in combinations(COLS, 2))
STD_SQL = X.panel() + MEASURES_SQL + f"std as materialized (select date, idx, {Z} from measures), pr as materialized ({PAIRS}),"
NAMES = {"left": "left_name", "right": "right_name"}


def _std(m):
    return K.standardise(measures(m), COLS)


def _pairs(m):
    return K.pair_rows(_std(m), COLS)


@query("standardised_indicators", keys="date", nums=", ".join(COLS), sql=STD_SQL + "select_final select * from std")
def _(m):
    return _std(m)


@query("distance_correlation", keys="left_name, right_name", nums="dcor", sql=STD_SQL + """
ds as (select p.left_name, p.right_name, p.idx as i, q.idx as j, abs(p.x - q.x) as a, abs(p.y - q.y) as b from pr p join pr q on p.left_name = q.left_name and p.right_name = q.right_name),
rm as (select left_name, right_name, i, avg(a) as ma, avg(b) as mb from ds group by 1, 2, 3),
gm as (select left_name, right_name, avg(a) as ga, avg(b) as gb from ds group by 1, 2),
ce as (select d.left_name, d.right_name, a - r.ma - s.ma + ga as ca, b - r.mb - s.mb + gb as cb from ds d join rm r on r.left_name = d.left_name and r.right_name = d.right_name and r.i = d.i
  join rm s on s.left_name = d.left_name and s.right_name = d.right_name and s.i = d.j join gm g on g.left_name = d.left_name and g.right_name = d.right_name)
select_final select left_name, right_name, sqrt(avg(ca*cb))/sqrt(sqrt(avg(ca*ca))*sqrt(avg(cb*cb))) as dcor from ce group by 1, 2""")
def _(m):
    return K.distance_correlation(_pairs(m)).withColumnsRenamed(NAMES)


@query("rms_similarity", keys="left_name, right_name", nums="rmss", sql=STD_SQL + """
select_final select left_name, right_name, sqrt(avg(power(1 - abs(x - y)/nullif(abs(x) + abs(y), 0), 2))) as rmss from pr group by 1, 2""")
def _(m):
    return K.rms_similarity(_pairs(m)).withColumnsRenamed(NAMES)


@query("similarity_flags", keys="src, dst", ints="flag", sql=STD_SQL + """
select_final select left_name as src, right_name as dst, case when sqrt(avg(power(1 - abs(x - y)/nullif(abs(x) + abs(y), 0), 2))) > 0.5 then 1 else 0 end as flag from pr group by 1, 2""")
def _(m):
    rms = K.rms_similarity(_pairs(m)).withColumnsRenamed({"left": "src", "right": "dst"})
    return D.threshold_matrix(rms, "rmss", 0.5)


def _tests(m):
    return K.granger_ftest(_pairs(m), a=0.10, lag_max=5)


@query("granger_tests", keys="left_name, right_name, rejected", ints="lag_r, lag_u", nums="stat, cv")
def _(m):
    return _tests(m).withColumnsRenamed(NAMES)


# One lag each way, so that SQL can follow: the restricted fit has one regressor, the other two.
GRANGER_ONE = STD_SQL + f"""
lg as (select *, lag(x) over w as x1, lag(y) over w as y1 from pr window w as (partition by left_name, right_name order by idx)),
sm as (select left_name, right_name, cast(regr_count(x, x1) as double) as k, regr_sxx(x, x1) as c11, regr_syy(x, x1) as c00, regr_sxy(x, x1) as c01,
  regr_sxx(x, y1) as c22, regr_sxy(x, y1) as c02, regr_sxy(x1, y1) as c12 from lg group by 1, 2),
fs as (select left_name, right_name, k, c00 - c01*c01/c11 as rss_r, c00 - (c01*(c22*c01 - c12*c02) + c02*(c11*c02 - c12*c01))/(c11*c22 - c12*c12) as rss_u from sm),
tst as (select left_name, right_name, greatest(rss_r - rss_u, 0)/(rss_u/(k + 1.0)) as stat, {f_inv_sql('0.90::double', '1.0', '(k + 1.0)')} as cv from fs),
"""


def _one_lag(m):
    return K.granger_ftest(_pairs(m), a=0.10, lag_max=1)


@query("granger_tests_one_lag", keys="left_name, right_name", nums="stat, cv", sql=GRANGER_ONE + "select_final select * from tst")
def _(m):
    return _one_lag(m).withColumnsRenamed(NAMES)


def _score_sql(points: str) -> str:
    return (f"pts as ({points}), sc as (select label, sum(p) as s from pts group by 1) select_final select label, "
            "case when max(abs(s)) over () = 0 then 0.0 else round((s - min(s) over ())/(max(s) over () - min(s) over ())*100.0, 2) end as score from sc")


@query("granger_scores", keys="label", nums="score", sql=GRANGER_ONE + _score_sql(
    "select left_name as label, case when stat > cv then -1 else 0 end as p from tst union all select right_name, case when stat > cv then 1 else 0 end from tst"))
def _(m):
    return K.gc_scores(_one_lag(m))


def with_dummy(m):
    """Standardised indicators with the 0/1 crisis dummy."""
    s = cut_lineage(_std(m))
    return cut_lineage(s.join(panels.crisis_ranges(s.select("date"), m.crises()).select("date", F.col("any_crisis").alias("crisis")), "date"))


#: Newton rounds of the logistic regression in SQL, from zero; the library stops when the likelihood stands still.
ROUNDS = 12
LOGIT_SQL = STD_SQL + X.CRISES + """
cd as (select d.date, cast(max(case when c.name is null then 0 else 1 end) as double) as y from std d left join crises c on d.date between c.start_date and c.end_date group by 1),
lx as materialized (select label, x, y from (unpivot (select y, """ + ", ".join(COLS) + " from std join cd using (date)) on " + ", ".join(COLS) + """ into name label value x)),
n0 as (select distinct label, 0.0::double as b0, 0.0::double as b1 from lx),
""" + "".join(f"""n{k} as materialized (select label,
  any_value(b0) + (sum(w*x*x)*sum(y - p) - sum(w*x)*sum((y - p)*x))/(sum(w)*sum(w*x*x) - sum(w*x)*sum(w*x)) as b0,
  any_value(b1) + (sum(w)*sum((y - p)*x) - sum(w*x)*sum(y - p))/(sum(w)*sum(w*x*x) - sum(w*x)*sum(w*x)) as b1
  from (select *, p*(1 - p) as w from (select lx.*, b0, b1, 1/(1 + exp(-b0 - b1*x)) as p from lx join n{k - 1} using (label))) group by label),
""" for k in range(1, ROUNDS + 1)) + f"""
lg2 as (select label, 1 - sum(y*(b0 + b1*x) - ln(1 + exp(b0 + b1*x)))/(count(*)*(avg(y)*ln(avg(y)) + (1 - avg(y))*ln(1 - avg(y)))) as r2
  from lx join n{ROUNDS} using (label) group by label),
"""
# every indicator against every other; a tie is a difference below the tolerance
TOURNAMENT = "select a.label, case when a.r2 > b.r2 + 1e-11 then 1 when b.r2 > a.r2 + 1e-11 then -1 else 0 end as p from lg2 a join lg2 b on a.label <> b.label"


@query("logit_pseudo_r2", keys="label", nums="r2", sql=LOGIT_SQL + "select_final select * from lg2")
def _(m):
    return K.logit_mcfadden(with_dummy(m), COLS, "crisis")


@query("predictive_power", keys="label", nums="pps")
def _(m):
    return K.predictive_power(with_dummy(m), COLS, "crisis")


@query("price_discovery", keys="left_name, right_name", ints="lag", nums="m1, m2")
def _(m):
    return K.price_discovery(_pairs(m), "GG").withColumnsRenamed(NAMES)


@query("price_discovery_information_share", keys="left_name, right_name", ints="lag", nums="m1, m2")
def _(m):
    return K.price_discovery(_pairs(m), "H").withColumnsRenamed(NAMES)


# lag_max = 1: a difference on the equilibrium error, a one-regressor fit.
DISCOVERY_ONE = STD_SQL + """
rg as (select left_name, right_name, regr_slope(y, x) as b, regr_intercept(y, x) as a from pr group by 1, 2),
gp as (select pr.left_name, pr.right_name, idx, x, y, y - a - b*x as e from pr join rg on pr.left_name = rg.left_name and pr.right_name = rg.right_name),
df as (select left_name, right_name, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(e, 2) over w as e2 from gp window w as (partition by left_name, right_name order by idx)),
dd as (select left_name, right_name, abs(regr_slope(dx, e2)) as d1, abs(regr_slope(dy, e2)) as d2 from df group by 1, 2),
disc as (select left_name, right_name, d1/(d1 + d2) as m1, 1 - d1/(d1 + d2) as m2 from dd),
"""


@query("price_discovery_one_lag", keys="left_name, right_name", nums="m1, m2", sql=DISCOVERY_ONE + "select_final select * from disc")
def _(m):
    return K.price_discovery(_pairs(m), "GG", lag_max=1).withColumnsRenamed(NAMES)


@query("price_discovery_scores", keys="label", nums="score", sql=DISCOVERY_ONE + _score_sql(
    "select left_name as label, case when m1 > 0.5 then 1 when m2 > 0.5 then -1 else 0 end as p from disc union all "
    "select right_name, case when m1 > 0.5 then -1 when m2 > 0.5 then 1 else 0 end from disc"))
def _(m):
    return K.pd_scores(K.price_discovery(_pairs(m), "GG", lag_max=1))


@query("indicator_tournament", keys="label", nums="score", sql=STD_SQL + """
cr as (select label, abs(corr(x, idx)) as r2 from (unpivot (select idx, """ + ", ".join(COLS) + " from std) on " + ", ".join(COLS) + """ into name label value x) group by 1),
""" + _score_sql("select a.label, case when a.r2 > b.r2 + 1e-11 then 1 when b.r2 > a.r2 + 1e-11 then -1 else 0 end as p from cr a join cr b on a.label <> b.label"))
def _(m):
    trend = _std(m).unpivot(["idx"], COLS, "label", "x").groupBy("label").agg(F.abs(F.corr("x", "idx")).alias("r2"))
    return K.tournament(trend, "r2")


@query("logit_scores", keys="label", nums="score", sql=LOGIT_SQL + _score_sql(TOURNAMENT))
def _(m):
    return K.tournament(K.logit_mcfadden(with_dummy(m), COLS, "crisis"), "r2")


@query("predictive_power_scores", keys="label", nums="score")
def _(m):
    return K.tournament(cut_lineage(K.predictive_power(with_dummy(m), COLS, "crisis")), "pps")


@query("overall_scores_simple", keys="label", nums="score", sql=DISCOVERY_ONE + GRANGER_ONE[len(STD_SQL):] + """
gpt as (select left_name as label, case when stat > cv then -1 else 0 end as p from tst union all select right_name, case when stat > cv then 1 else 0 end from tst),
gsc as (select label, sum(p) as s from gpt group by 1),
gs as (select label, case when max(abs(s)) over () = 0 then 0.0 else round((s - min(s) over ())/(max(s) over () - min(s) over ())*100.0, 2) end as score from gsc),
dpt as (select left_name as label, case when m1 > 0.5 then 1 when m2 > 0.5 then -1 else 0 end as p from disc union all
  select right_name, case when m1 > 0.5 then -1 when m2 > 0.5 then 1 else 0 end from disc),
dsc as (select label, sum(p) as s from dpt group by 1),
dss as (select label, case when max(abs(s)) over () = 0 then 0.0 else round((s - min(s) over ())/(max(s) over () - min(s) over ())*100.0, 2) end as score from dsc)
select_final select g.label, round(g.score*0.75 + d.score*0.25, 2) as score from gs g join dss d on g.label = d.label""")
def _(m):
    pairs = cut_lineage(_pairs(m))
    return K.overall_score([(K.gc_scores(K.granger_ftest(pairs, 0.10, 1)), 3.0), (K.pd_scores(K.price_discovery(pairs, "GG", 1)), 1.0)])


def comparison_wide(m):
    """Indicators of several families, one column each, from one panel."""
    from riskpanel.plans import connectedness
    from riskpanel.operators import tail, component
    r = m.returns()
    dci = connectedness.dci(m).select("idx", "date", "dci")
    parts = component.component_metrics(r, 52).select("idx", "ar")
    chi = tail.chi_metrics(tail.chi_sums(r, 156)).select("idx", "achi")
    return cut_lineage(dci.join(parts, "idx").join(chi, "idx").join(measures(m).drop("date"), "idx"))


@query("comparison_scores", keys="label", nums="score")
def _(m):
    """End to end: indicators of several families, standardised after a cut-off, scored by all four models."""
    wide = comparison_wide(m)
    cols = ["dci", "ar", "achi", *COLS]
    std = cut_lineage(K.standardise(wide, cols, cutoff=52))
    dummy = panels.crisis_ranges(std.select("date"), m.crises()).select("date", F.col("any_crisis").alias("crisis"))
    both = cut_lineage(std.join(dummy, "date"))
    pairs = K.pair_rows(std, cols)
    return K.overall_score([
        (K.gc_scores(cut_lineage(K.granger_ftest(pairs, 0.01, 21))), 1.0),
        (K.tournament(K.logit_mcfadden(both, cols, "crisis"), "r2"), 1.0),
        (K.tournament(cut_lineage(K.predictive_power(both, cols, "crisis")), "pps"), 1.0),
        (K.pd_scores(cut_lineage(K.price_discovery(pairs, "GG", 21))), 1.0)])


@query("ranked_scores", keys="entity", ints="position", nums="total", sql=STD_SQL + """
cr as (select label, abs(corr(x, idx)) as r2 from (unpivot (select idx, """ + ", ".join(COLS) + " from std) on " + ", ".join(COLS) + """ into name label value x) group by 1)
select_final select label as entity, r2 as total, row_number() over (order by r2 desc, label) as position from cr""")
def _(m):
    trend = _std(m).unpivot(["idx"], COLS, "entity", "x").groupBy("entity").agg(F.abs(F.corr("x", "idx")).alias("total"))
    return D.rank_table(trend, "total")
