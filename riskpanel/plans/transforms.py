"""Panel transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.operators import transforms as T
from riskpanel.plans import sqltext as X
from riskpanel.plans.registry import query
from riskpanel.sources import panels

BW = 52
K = T.head_rows(BW)
SUP = X.panel("supplier")
EWMA_A = 2.0 / (BW + 1)


def ewma_sql(src: str, value: str, a: float, keys: str = "entity") -> str:
    """Recursion-free EWMA: weights (1-a)^age over the whole past, the first value weighing (1-a)^(t-1)."""
    cond = " and ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(",") if k.strip()) or "true"
    cols = ", ".join(f"y.{k.strip()}" for k in keys.split(",") if k.strip())
    cols = cols + ", " if cols else ""
    return (f"select {cols}y.idx, sum(x.{value} * power({1 - a!r}::double, y.idx - x.idx) * "
            f"(case when x.idx = 1 then 1.0 else {a!r}::double end)) as ewma "
            f"from {src} y join {src} x on {cond} and x.idx <= y.idx group by {cols}y.idx")


@query("log_returns", keys="entity, date", ints="idx", nums="r", sql=SUP + "select_final select entity, date, idx, r from rets")
def _(m):
    return m.returns("supplier")


@query("cds_to_decimal", keys="entity, date", nums="spread", digits=9, sql=SUP + "select_final select entity, date, cds/10000.0 as spread from panel")
def _(m):
    return T.cds_to_decimal(m.panel("supplier").withColumn("spread", F.col("cds")), ["spread"])


@query("liabilities", keys="entity, period", nums="lb_m", sql=X.BALANCE + "select_final select entity, period, (assets - equity)/1e6 as lb_m from balance")
def _(m):
    return T.liabilities(m.balance()).withColumn("lb_m", F.col("liabilities") / 1e6)


@query("clamped_crises", keys="name, start_date, end_date", sql="""
spans as (select o_orderpriority as name, min(cast(o_orderdate as date)) - 30 as s, max(cast(o_orderdate as date)) + 400 as e from orders group by 1),
b as (select min(cast(date_trunc('week', l_shipdate) as date)) as lo, max(cast(date_trunc('week', l_shipdate) as date)) as hi from lineitem)
select_final select name, greatest(s, lo) as start_date, least(e, hi) as end_date from spans, b""")
def _(m):
    day = F.to_date("o_orderdate")
    spans = m.table("orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.date_sub(F.min(day), 30).alias("start_date"), F.date_add(F.max(day), 400).alias("end_date"))
    return T.clamp_crisis_bounds(spans, m.calendar())


STOPPED = X.panel() + """
stopped as (select entity, date, idx, r, case when entity = 'Brand#7' and idx > 330 then 0.0 else price end as price,
  case when entity = 'Brand#7' and idx > 330 then 0.0 else volume end as volume from (
    select p.*, 0.0 as r from panel p)),
last as (select entity, max(idx) as t, max(case when price <> 0 then idx else 0 end) as lp,
  max(case when volume <> 0 then idx else 0 end) as lv from stopped group by 1),
distress as (select entity, least(case when t - lp >= greatest(floor(t*0.05 + 0.5), 1) then lp + 1 end,
  case when t - lv >= greatest(floor(t*0.05 + 0.5), 1) then lv + 1 end) as distress_idx from last),
"""


def stopped(m):
    """The brand panel with one brand that stops trading after row 330."""
    gone = (F.col("entity") == "Brand#7") & (F.col("idx") > 330)
    return m.panel().withColumns({c: F.when(gone, 0.0).otherwise(F.col(c)) for c in ("price", "volume")})


def defaults(df):
    return T.detect_distress(df, {"price": F.col("price") == 0, "volume": F.col("volume") == 0})


@query("detect_default", keys="entity", ints="distress_idx", sql=STOPPED + "select_final select entity, distress_idx from distress")
def _(m):
    return defaults(stopped(m))


@query("detect_insolvency", keys="entity", ints="distress_idx", sql=X.BALANCE + """
eq as (select entity, period, row_number() over (partition by entity order by period) as idx,
  case when entity = 'Brand#9' and period >= date '2001-01-01' then -1.0 else equity end as equity from balance),
last as (select entity, max(idx) as t, max(case when equity < 0 then 0 else idx end) as l from eq group by 1)
select_final select entity, case when t - l >= greatest(floor(t*0.05 + 0.5), 1) then l + 1 end as distress_idx from last""")
def _(m):
    from pyspark.sql import Window
    gone = (F.col("entity") == "Brand#9") & (F.col("period") >= F.lit("2001-01-01").cast("date"))
    eq = m.balance().withColumn("equity", F.when(gone, -1.0).otherwise(F.col("equity"))).withColumn(
        "idx", F.row_number().over(Window.partitionBy("entity").orderBy("period")))
    return T.detect_distress(eq, {"equity": F.col("equity") < 0})


@query("mask_distress", keys="entity, date", nums="price", sql=STOPPED + """
select_final select s.entity, s.date, case when idx >= distress_idx then null else price end as price
from stopped s left join distress d on s.entity = d.entity""", digits=9)
def _(m):
    p = stopped(m)
    return T.mask_distress(p, defaults(p), ["price", "volume"])


@query("select_series", keys="entity, date", nums="r, cds", sql=SUP + "select_final select entity, date, r, cds from rets")
def _(m):
    return T.select_series(m.returns("supplier"), ["r", "cds"])


@query("window_bounds_short_panel", ints="idx, lo, hi", sql=X.panel() + """
select_final select max(idx) as idx, 1 as lo, max(idx) as hi from rets""")
def _(m):
    return T.window_bounds(m.returns(), 1000)


@query("rolling_windows_short_panel", keys="entity, date", nums="mean_r, std_r, max_r", sql=SUP + """
select_final select entity, max(date) as date, avg(r) as mean_r, stddev_samp(r) as std_r, max(r) as max_r from rets group by 1""")
def _(m):
    return T.rolling(m.returns("supplier"), 1000, mean_r=F.avg("r"), std_r=F.stddev_samp("r"), max_r=F.max("r"))


_ROLL = f"""
raw_roll as (select entity, date, idx, avg(r) over w as mean_r, stddev_samp(r) over w as std_r, max(r) over w as max_r from rets
  window w as (partition by entity order by idx rows between {BW - 1} preceding and current row)),
"""


@query("rolling_windows", keys="entity, date", nums="mean_r, std_r, max_r", sql=SUP + _ROLL + "select_final " +
       X.head_fill("raw_roll", ["mean_r", "std_r", "max_r"], K))
def _(m):
    return T.rolling(m.returns("supplier"), BW, mean_r=F.avg("r"), std_r=F.stddev_samp("r"), max_r=F.max("r"))


@query("rolling_windows_full_only", keys="entity, date", nums="mean_r, std_r", sql=SUP + _ROLL +
       f"select_final select entity, date, mean_r, std_r from raw_roll where idx >= {BW}")
def _(m):
    return T.rolling(m.returns("supplier"), BW, truncate=True, mean_r=F.avg("r"), std_r=F.stddev_samp("r"))


@query("window_bounds", ints="idx, lo, hi", sql=X.panel() + f"""
select_final select distinct idx, greatest(idx - {BW} + 1, 1) as lo, greatest(idx, {K}) as hi from rets""")
def _(m):
    return T.window_bounds(m.returns(), BW)


@query("forward_roll", keys="entity, date", nums="rolled", digits=9, sql=SUP + """
mo as (select entity, date, idx, price, (dense_rank() over (partition by entity order by date_trunc('month', date)) - 1) // 3 as block from panel)
select_final select entity, date, first_value(price) over (partition by entity, block order by idx) as rolled from mo""")
def _(m):
    return T.forward_roll(m.panel("supplier"), "price", 3)


_GAPS = SUP + """
gaps as (select entity, date, idx, case when volume > 0 then ln(price) end as x from panel),
marks as (select *, last_value(x ignore nulls) over b as pv, last_value(case when x is not null then idx end ignore nulls) over b as pi,
    first_value(x ignore nulls) over a as nv, first_value(case when x is not null then idx end ignore nulls) over a as ni
  from gaps window b as (partition by entity order by idx rows between unbounded preceding and current row),
    a as (partition by entity order by idx rows between current row and unbounded following)),
"""


@query("fill_linear", keys="entity, date", nums="x", sql=_GAPS + """
select_final select entity, date, case when x is not null then x when pv is null then nv when nv is null then pv
  else pv + (nv - pv)*(idx - pi)/(ni - pi) end as x from marks""")
def _(m):
    return T.fill_gaps(m.panel("supplier").withColumn("x", F.when(F.col("volume") > 0, F.ln("price"))), "x")


@query("mad_outliers", keys="entity, date, is_outlier", nums="x", sql=SUP + f"""
s as (select entity, date, idx, ln(price) as x from panel),
win as (select a.entity, a.date, a.idx, a.x, b.x as y from s a join s b on a.entity = b.entity and b.idx >= a.idx - 10
  and b.idx <= a.idx + (case when a.idx <= 10 then 10 else 11 end)),
med as (select entity, date, idx, x, median(y) as med, list(y) as ys from win group by all),
mad as (select entity, date, idx, x, med, {T.MAD_SCALE!r}::double*list_aggregate(list_transform(ys, lambda v: abs(v - med)), 'median') as mad from med),
flag as (select *, abs(x - med) > 3.0*mad as is_outlier, case when abs(x - med) > 3.0*mad then null else x end as z from mad),
marks as (select *, last_value(z ignore nulls) over b as pv, last_value(case when z is not null then idx end ignore nulls) over b as pi,
    first_value(z ignore nulls) over a as nv, first_value(case when z is not null then idx end ignore nulls) over a as ni
  from flag window b as (partition by entity order by idx rows between unbounded preceding and current row),
    a as (partition by entity order by idx rows between current row and unbounded following))
select_final select entity, date, is_outlier, case when z is not null then z when pv is null then nv when nv is null then pv
  else pv + (nv - pv)*(idx - pi)/(ni - pi) end as x from marks""")
def _(m):
    return T.mad_outliers(m.panel("supplier").withColumn("x", F.ln("price")), "x", 21)


@query("clamp", keys="entity, date", nums="clamped", sql=SUP + "select_final select entity, date, least(greatest(r, -0.2), 0.2) as clamped from rets")
def _(m):
    return m.returns("supplier").withColumn("clamped", T.clip(F.col("r"), -0.2, 0.2))


@query("smooth", keys="entity, date", nums="smoothed", sql=_GAPS + """
sized as (select *, count(*) over (partition by entity) as n from gaps)
select_final select a.entity, a.date, case when max(a.x) is null then null else avg(b.x) end as smoothed from sized a join sized b on a.entity = b.entity
  and b.idx between a.idx - least(a.idx - 1, a.n - a.idx, 10) and a.idx + least(a.idx - 1, a.n - a.idx, 10) group by 1, 2""")
def _(m):
    return T.smooth(m.panel("supplier").withColumn("x", F.when(F.col("volume") > 0, F.ln("price"))), "x", 21)


@query("ewma", keys="entity", ints="idx", nums="ewma", sql=SUP + "select_final " + ewma_sql("rets", "r", EWMA_A))
def _(m):
    return T.ewma(m.returns("supplier"), "r", BW)


@query("minmax_norm", keys="entity, date", nums="scaled", sql=SUP + """
select_final select entity, date, (r - min(r) over (partition by entity))/(max(r) over (partition by entity) - min(r) over (partition by entity)) as scaled from rets""")
def _(m):
    return T.minmax_norm(m.returns("supplier"), "r")


@query("zscore", keys="entity, date", nums="z", sql=SUP + """
select_final select entity, date, (r - avg(r) over (partition by entity))/stddev_pop(r) over (partition by entity) as z from rets where idx >= 10""")
def _(m):
    return T.zscore(m.returns("supplier"), "r", 10)


@query("equal_weight_portfolio", keys="date", nums="rp", sql=SUP + "select_final select date, avg(r) as rp from rets group by 1")
def _(m):
    return T.equal_weight_portfolio(m.returns("supplier"))


@query("cap_weighted_average", keys="date", nums="weighted", sql=SUP + """
select_final select date, sum(r*greatest(0.0, cap/tot)) as weighted from (select *, sum(cap) over (partition by date) as tot from rets) group by 1""")
def _(m):
    return T.cap_weighted_average(m.returns("supplier"), "r")


@query("group_aggregate", keys="date, short_name", nums="r, cds, cap_m", digits=10, sql=X.panel() + X.ENTITY_GROUP + """
select_final select date, short_name, avg(r) as r, avg(cds) as cds, sum(cap)/1e6 as cap_m from rets join entity_group using (entity) group by 1, 2""")
def _(m):
    groups = panels.entity_groups(m.observations(), m.groups())
    return T.group_aggregate(m.returns(), groups).withColumn("cap_m", F.col("cap") / 1e6)


@query("mean_impute", keys="entity, date", nums="x", sql=_GAPS + "select_final select entity, date, coalesce(x, avg(x) over (partition by entity)) as x from gaps")
def _(m):
    return T.mean_impute(m.panel("supplier").withColumn("x", F.when(F.col("volume") > 0, F.ln("price"))), "x")


@query("pct_change", keys="entity, date", nums="pct", sql=SUP + """
select_final select entity, date, coalesce(100.0*(price/lag(price) over (partition by entity order by idx) - 1.0), 0.0) as pct from panel""")
def _(m):
    return T.pct_change(m.panel("supplier"), "price")


def with_liabilities(m, base=None):
    """Weekly panel or returns with balance-sheet columns; weeks before the first quarter row stay missing."""
    rows = panels.align_periods(m.returns() if base is None else base, m.balance())
    return T.adjust_liabilities(T.liabilities(rows))


LIABILITIES_SQL = """
sheet as materialized (select r.*, b.assets, b.equity, b.assets - b.equity as liabilities, b.separate_accounts,
    b.assets - b.equity - 0.6*b.separate_accounts as lb from rets r
  left join balance b on r.entity = b.entity and b.period = date_trunc('quarter', r.date)),
sheet_blocks as (select *, (dense_rank() over (partition by entity order by date_trunc('month', date)) - 1) // 3 as block from sheet),
sheet_rolled as materialized (select *, first_value(lb) over (partition by entity, block order by idx) as lbr from sheet_blocks),
"""


@query("adjust_liabilities", keys="entity, date", nums="lb_m, lbr_m", sql=X.panel() + X.BALANCE + LIABILITIES_SQL +
       "select_final select entity, date, lb/1e6 as lb_m, lbr/1e6 as lbr_m from sheet_rolled")
def _(m):
    return with_liabilities(m).withColumns({"lb_m": F.col("lb") / 1e6, "lbr_m": F.col("lbr") / 1e6})


@query("group_aggregate_liabilities", keys="date, short_name", nums="r, cds, cap_m, lb_m", digits=10, sql=X.panel() + X.ENTITY_GROUP + X.BALANCE + LIABILITIES_SQL + """
select_final select date, short_name, avg(r) as r, avg(cds) as cds, sum(cap)/1e6 as cap_m, sum(lb)/1e6 as lb_m from sheet join entity_group using (entity) group by 1, 2""")
def _(m):
    groups = panels.entity_groups(m.observations(), m.groups())
    return T.group_aggregate(with_liabilities(m), groups).withColumns({"cap_m": F.col("cap") / 1e6, "lb_m": F.col("lb") / 1e6})


@query("rank_topbottom_liabilities", keys="entity, date", nums="lb_m", sql=X.panel() + X.BALANCE + LIABILITIES_SQL + """
ranked as (select *, row_number() over (partition by date order by lb desc, entity) as top, row_number() over (partition by date order by lb, entity) as low from sheet where lb is not null)
select_final select entity, date, lb/1e6 as lb_m from ranked where top <= 3 or low <= 3""")
def _(m):
    """Weeks before the first balance sheet of an entity leave it out of the order."""
    return T.rank_topbottom(with_liabilities(m).filter("lb is not null"), "lb", 3).withColumn("lb_m", F.col("lb") / 1e6)


@query("step_windows", keys="entity, date", nums="std_r", sql=SUP + _ROLL + "picked as (" + X.head_fill("raw_roll", ["std_r"], K) + """)
select_final select entity, date, std_r from picked where (idx - 1) % 10 = 0 or idx = (select max(idx) from picked)""")
def _(m):
    return T.step_dates(T.rolling(m.returns("supplier"), BW, std_r=F.stddev_samp("r")), 10)


@query("age_weights", keys="entity, date", nums="weighted", sql=SUP + f"""
w as (select a.entity, a.date, a.idx, sum(b.cds*power(0.98, a.idx - b.idx))*(1 - 0.98)/(1 - power(0.98, count(*))) as weighted
  from rets a join rets b on a.entity = b.entity and b.idx between a.idx - {BW - 1} and a.idx group by 1, 2, 3)
select_final """ + X.head_fill("w", ["weighted"], K))
def _(m):
    return T.age_weighted_sum(m.returns("supplier"), "cds", BW)


_RANKED = SUP + """
ranked as (select entity, date, cap, row_number() over (partition by date order by cap desc, entity) as top_rank,
  row_number() over (partition by date order by cap, entity) as low_rank from rets),
picked as (select * from ranked where top_rank <= 3 or low_rank <= 3)
"""


def _slots(m):
    picked = T.rank_topbottom(m.returns("supplier"), "cap", 3)
    return picked.withColumn("slot", F.when(F.col("top_rank") <= 3, F.concat(F.lit("top"), F.col("top_rank").cast("string")))
                             .otherwise(F.concat(F.lit("low"), F.col("low_rank").cast("string"))))


@query("rank_topbottom", keys="date, entity, slot", sql=_RANKED + """
select_final select date, entity, case when top_rank <= 3 then 'top' || cast(top_rank as varchar) else 'low' || cast(low_rank as varchar) end as slot from picked""")
def _(m):
    return _slots(m)


@query("portfolio_coverage", keys="entity", ints="n", nums="coverage", sql=_RANKED + """
, c as (select entity, count(*) as n from picked group by 1)
select_final select entity, n, n/(select max(n) from c) as coverage from c""")
def _(m):
    return T.portfolio_coverage(_slots(m))


MAGNITUDE_SQL = """select power(10.0, floor(abs(avg(floor(round(log10(abs(nullif(r, 0))), 15)))) + 0.5) +
  round(avg(floor(round(log10(nullif(volume, 0)), 15))))) as magnitude from rets"""


@query("magnitude", nums="magnitude", sql=SUP + "select_final " + MAGNITUDE_SQL)
def _(m):
    return T.magnitude(m.returns("supplier"))
