"""Sources, sinks and quality rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskpanel.operators import quality as Q
from riskpanel.operators import transforms as T
from riskpanel.plans import sqltext as X
from riskpanel.plans.registry import query
from riskpanel.session import shared_folder
from riskpanel.sources import panels, results
from riskpanel.sources.market import period_start

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _order_wide(m):
    """Wide table: a Date column and one column per order priority."""
    orders = m.table("orders").select(period_start(F.col("o_orderdate"), "week").alias("Date"), "o_orderpriority",
                                      "o_totalprice")
    return orders.groupBy("Date").pivot("o_orderpriority", PRIORITIES).agg((F.avg("o_totalprice") / 1e5).alias("v"))


@query("wide_panel_source", keys="date, entity", nums="value", digits=12, sql="""
select_final select d.date, p.entity, v.value
from (select distinct cast(date_trunc('week', o_orderdate) as date) as date from orders) d
cross join (select * from (values ('1-URGENT'),('2-HIGH'),('3-MEDIUM'),('4-NOT SPECIFIED'),('5-LOW')) t(entity)) p
left join (select cast(date_trunc('week', o_orderdate) as date) as date, o_orderpriority as entity,
  avg(o_totalprice)/1e5 as value from orders group by 1, 2) v on v.date = d.date and v.entity = p.entity""")
def _(m):
    return panels.from_wide(_order_wide(m), "Date")


@query("period_aligned_balance", keys="entity, date, period", nums="assets_m, equity_m, separate_m", sql=X.panel() + X.BALANCE + """
select_final select p.entity, p.date, cast(date_trunc('quarter', p.date) as date) as period, assets/1e6 as assets_m,
  equity/1e6 as equity_m, separate_accounts/1e6 as separate_m from panel p
left join balance b on p.entity = b.entity and b.period = date_trunc('quarter', p.date)""")
def _(m):
    out = panels.align_periods(m.panel(), m.balance())
    return out.withColumns({"assets_m": F.col("assets") / 1e6, "equity_m": F.col("equity") / 1e6,
                            "separate_m": F.col("separate_accounts") / 1e6})


@query("group_source", keys="entity, short_name", ints="pos", sql=X.panel() + X.ENTITY_GROUP + """
select_final select entity, short_name, pos from entity_group""")
def _(m):
    return panels.entity_groups(m.observations(), m.groups())


_EVENTS = """
ev as (select cast(date_trunc('week', l_shipdate) as date) as date, count(*) as n from lineitem
  where l_returnflag = 'R' group by 1),
ev_dates as (select date from ev where n > (select avg(n) from ev)),
dates as (select distinct cast(date_trunc('week', l_shipdate) as date) as date from lineitem),
"""


def _dates(m):
    return m.table("lineitem").select(period_start(F.col("l_shipdate"), "week").alias("date")).distinct()


def _return_events(m):
    """Weeks with more returned items than the average week."""
    weekly = m.table("lineitem").filter("l_returnflag = 'R'").groupBy(
        period_start(F.col("l_shipdate"), "week").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return weekly.withColumn("mean", weekly.agg(F.avg("n").alias("a")).scalar()).filter("n > mean").select("date")


@query("event_crises", keys="date", ints="crisis", sql=_EVENTS + """
select_final select d.date, case when e.date is null then 0 else 1 end as crisis
from dates d left join ev_dates e on d.date = e.date""")
def _(m):
    return panels.crisis_events(_dates(m), _return_events(m))


@query("range_crises", keys="date", ints="any_crisis", sql=_EVENTS + X.CRISES + """
select_final select d.date, max(case when c.name is null then 0 else 1 end) as any_crisis
from dates d left join crises c on d.date between c.start_date and c.end_date group by 1""")
def _(m):
    return panels.crisis_ranges(_dates(m), m.crises())


@query("crisis_dummies", keys="date, name", ints="crisis", sql=_EVENTS + X.CRISES + """
select_final select date, name, case when date between start_date and end_date then 1 else 0 end as crisis
from dates cross join crises""")
def _(m):
    return panels.crisis_dummies(_dates(m), m.crises())


@query("trailing_blank_trim", keys="entity, date", nums="traded", digits=9, sql=X.panel("supplier") + """
blanked as (select entity, date, idx, case when volume > 0 then price end as traded from panel)
select_final select entity, date, traded from (select *, count(traded) over (partition by entity order by idx
  rows between current row and unbounded following) as ahead from blanked) where ahead > 0""")
def _(m):
    p = m.panel("supplier").withColumn("traded", F.when(F.col("volume") > 0, F.col("price")))
    return panels.trim_trailing_blank(p, ["traded"])


@query("indicator_rows", keys="serial, category, indicator, date", nums="value", sql=X.panel() + """
t as (select date, avg(r) as mean_return, sum(volume)/1e6 as volume_m from rets group by 1)
select_final select 'S1' as serial, 'Component' as category, 'mean_return' as indicator, date, mean_return as value from t
union all select 'S1', 'Component', 'volume_m', date, volume_m from t""")
def _(m):
    daily = m.returns().groupBy("date").agg(F.avg("r").alias("mean_return"), (F.sum("volume") / 1e6).alias("volume_m"))
    return results.indicators(daily, "S1", "Component", ["mean_return", "volume_m"])


@query("result_round_trip", keys="serial, category, indicator, date", nums="value", sql=X.panel() + """
t as (select date, avg(r) as mean_return, sum(volume)/1e6 as volume_m, stddev_samp(r) as spread from rets group by 1)
select_final select 'S1' as serial, 'Component' as category, 'mean_return' as indicator, date, mean_return as value from t
union all select 'S1', 'Component', 'volume_m', date, volume_m from t union all select 'S1', 'Liquidity', 'spread', date, spread from t""")
def _(m):
    """A first draft, then the same results twice: what is read back are the results once."""
    daily = m.returns().groupBy("date").agg(F.avg("r").alias("mean_return"), (F.sum("volume") / 1e6).alias("volume_m"), F.stddev_samp("r").alias("spread"))
    component = results.indicators(daily, "S1", "Component", ["mean_return", "volume_m"])
    root = f"{shared_folder(m.spark)}/results-{uuid.uuid4().hex}"
    results.store(component.withColumn("value", -F.col("value")), root)
    for _ in range(2):
        results.store(component.unionByName(results.indicators(daily, "S1", "Liquidity", ["spread"])), root)
    return results.stored(m.spark, root)


@query("table_contract", keys="rule, name", ints="cells", sql="""
select_final select 'type' as rule, 'o_orderpriority' as name, count(*) filter (o_orderpriority is not null and try_cast(o_orderpriority as int) is null) as cells from orders
union all select 'type', 'o_totalprice', count(*) filter (o_totalprice is not null and try_cast(o_totalprice as float) is null) from orders
union all select 'null', 'o_orderkey', count(*) filter (o_orderkey is null) from orders
union all select 'missing', 'o_clerk', count(*) from orders
union all select 'extra', 'o_orderstatus', count(o_orderstatus) from orders union all select 'extra', 'o_orderdate', count(o_orderdate) from orders""")
def _(m):
    orders = m.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return Q.table_contract(orders, StructType.fromDDL(
        "o_orderkey bigint not null, o_custkey bigint, o_totalprice float, o_orderpriority int, o_clerk string"))


_WIDE = ["b" + str(i) for i in range(1, 6)]


@query("result_wide_view", keys="date", nums=", ".join(_WIDE), sql=X.STATES + "select_final select date, " + ", ".join(
    f"max(case when var = '{p}' then value end) as {c}" for p, c in zip(PRIORITIES, _WIDE)) + " from states group by 1")
def _(m):
    wide = results.wide_view(m.states(), "var", PRIORITIES)
    return wide.select("date", *[F.col(f"`{p}`").alias(c) for p, c in zip(PRIORITIES, _WIDE)])


@query("result_catalogue", keys="serial, category, result_date", ints="is_last", sql="""
catalogue as (select cast(o_custkey % 7 as varchar) as serial, case when o_orderstatus = 'P' then 'Comparison'
  else o_orderpriority end as category, cast(o_orderdate as date) as result_date from orders),
ranked as (select *, row_number() over (partition by category order by result_date desc, serial) as rn from catalogue)
select_final select serial, category, result_date, case when category = 'Comparison' then 1 else 0 end as is_last
from ranked where rn = 1 and (category <> 'Comparison' or (select count(distinct serial) from catalogue) = 1)""")
def _(m):
    status = F.when(F.col("o_orderstatus") == "P", "Comparison").otherwise(F.col("o_orderpriority"))
    catalogue = m.table("orders").select((F.col("o_custkey") % 7).cast("string").alias("serial"), status.alias("category"),
                                         F.to_date("o_orderdate").alias("result_date"))
    return results.latest_results(catalogue.distinct())


@query("comparison_assembly", keys="date, label", nums="value", sql=X.panel() + """
t as (select date, avg(r) as ew, sum(r*cap)/sum(cap) as cw from rets group by 1),
u as (select date, var_samp(r) as dispersion from rets group by 1)
select_final select date, 'CO-ew' as label, ew as value from t union all select date, 'CO-cw', cw from t
union all select date, 'XS-dispersion', dispersion from u""")
def _(m):
    r = m.returns()
    a = results.indicators(r.groupBy("date").agg(
        F.avg("r").alias("ew"), (F.sum(F.col("r") * F.col("cap")) / F.sum("cap")).alias("cw"),
        F.max("r").alias("top")), "S", "Component", ["ew", "cw", "top"])
    b = results.indicators(r.groupBy("date").agg(F.var_samp("r").alias("dispersion")), "S", "Cross", ["dispersion"])
    return results.comparison_input([("CO", a, ["ew", "cw"]), ("XS", b, ["dispersion"])])


# ---------------------------------------------------------------- quality rules



_CELLS = X.panel("supplier") + "seen as (select *, case when volume > 0 then price end as traded from panel)"


def _seen(m):
    return m.panel("supplier").withColumn("traded", F.when(F.col("volume") > 0, F.col("price")))


@query("rule_missing_values", keys="rule, key, detail", sql=_CELLS + """
select_final select 'missing' as rule, entity || '@' || cast(date as varchar) as key, 'traded' as detail
from seen where traded is null""")
def _(m):
    return Q.missing_values(_seen(m), ["traded", "cap"])


@query("rule_non_finite", keys="rule, key, detail", sql=_CELLS + """
select_final select 'non_finite' as rule, entity || '@' || cast(date as varchar) as key, 'traded' as detail
from seen where volume = 0""")
def _(m):
    nan = F.when(F.col("volume") > 0, F.col("price")).otherwise(F.lit(float("nan")))
    return Q.non_finite(m.panel("supplier").withColumn("traded", nan), ["traded", "cap"])


@query("rule_negatives", keys="rule, key, detail", sql=X.panel() + """
select_final select 'negative' as rule, entity || '@' || cast(date as varchar) as key, 'r' as detail from rets where r < 0""")
def _(m):
    return Q.negatives(m.returns().withColumn("rf", -F.col("cds")), ["r", "price", "rf"], exempt=("rf",))


_RAW = """
raw as (select 'S' || cast(l_suppkey as varchar) as entity, cast(l_shipdate as date) as date, l_orderkey, l_linenumber
  from lineitem)"""


def _raw(m):
    return m.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity"),
                                      F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey",
                                      "l_quantity", "l_extendedprice")


@query("rule_duplicate_dates", keys="rule, key, detail", sql=_RAW + """
select_final select 'duplicate_date' as rule, entity || '@' || cast(date as varchar) as key, cast(count(*) as varchar) as detail
from raw group by entity, date having count(*) > 1""")
def _(m):
    return Q.duplicate_dates(_raw(m))


@query("rule_unsorted_dates", keys="rule, key, detail", sql="""
raw as (select 'S' || cast(l_suppkey as varchar) as entity, cast(l_shipdate as date) as date, l_orderkey,
  l_linenumber, l_extendedprice, l_partkey from lineitem),
late as (select entity, date, lag(date) over (partition by entity order by l_orderkey, l_linenumber, l_partkey, l_extendedprice)
  as prev from raw)
select_final select 'unsorted' as rule, entity as key, cast(count(*) as varchar) as detail
from late where prev > date group by entity""")
def _(m):
    tie = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    return Q.unsorted_dates(_raw(m).withColumn("tie", tie), "l_orderkey", "tie", span=2000)


@query("rule_date_mismatch", keys="rule, key, detail", sql="""
a as (select distinct cast(l_shipdate as date) as date from lineitem), b as (select distinct cast(o_orderdate as date) as date from orders)
select_final select 'date_extra' as rule, cast(date as varchar) as key, '' as detail from a where date not in (select date from b)
union all select 'date_absent', cast(date as varchar), '' from b where date not in (select date from a)""")
def _(m):
    return Q.date_mismatch(m.table("lineitem").select(F.to_date("l_shipdate").alias("date")), m.table("orders").select(F.to_date("o_orderdate").alias("date")))


@query("rule_period_coverage", keys="rule, key, detail", sql=X.panel("supplier") + """
held_periods as (select distinct entity, date_trunc('quarter', date) as period from obs),
need as (select distinct entity, cast(date_trunc('quarter', date) as date) as period from panel)
select_final select 'period_absent' as rule, n.entity as key, cast(n.period as varchar) as detail
from need n left join held_periods h on n.entity = h.entity and n.period = h.period where h.entity is null""")
def _(m):
    have = m.observations("supplier").select("entity", F.to_date(F.date_trunc("quarter", F.col("date"))).alias("period")).distinct()
    return Q.period_coverage(m.panel("supplier"), have)


@query("rule_entity_mismatch", keys="rule, key, detail", sql="""
a as (select distinct cast(o_custkey as varchar) as entity from orders), b as (select distinct cast(c_custkey as varchar) as entity from customer)
select_final select 'entity_extra' as rule, entity as key, '' as detail from a where entity not in (select entity from b)
union all select 'entity_absent', entity, '' from b where entity not in (select entity from a)""")
def _(m):
    a = m.table("orders").select(F.col("o_custkey").cast("string").alias("entity"))
    return Q.entity_mismatch(a, m.table("customer").select(F.col("c_custkey").cast("string").alias("entity")))


@query("rule_invalid_names", keys="rule, key, detail", sql="""
names as (select p_brand as entity from part union all select 'S' || cast(l_suppkey as varchar) from lineitem)
select_final select distinct 'invalid_name' as rule, entity as key, '' as detail from names
where not regexp_full_match(entity, '[A-Za-z][A-Za-z0-9]{0,11}')""")
def _(m):
    names = m.table("part").select(F.col("p_brand").alias("entity")).unionByName(_raw(m).select("entity"))
    return Q.invalid_names(names)


@query("rule_minimum_size", keys="rule, key, detail", sql=X.panel("supplier") + """
n as (select entity, count(*) as n from obs group by 1)
select_final select 'too_few_rows' as rule, entity as key, cast(n as varchar) as detail from n where n < 252
union all select 'too_few_firms', '', cast(c as varchar) from (select count(*) as c from n) where c < 3""")
def _(m):
    return Q.minimum_size(m.observations("supplier"))


@query("rule_group_counts", keys="rule, key, detail", sql=X.GROUPS + """
tot as (select sum(cnt) as total from groups), n as (select count(distinct l_suppkey) as n from lineitem)
select_final select 'group_total' as rule, cast(total as varchar) as key, cast(n as varchar) as detail from tot, n where total <> n""")
def _(m):
    return Q.group_counts(m.groups(), _raw(m))


@query("rule_crises", keys="rule, key, detail", sql="""
shifted as (select o_orderpriority as name, min(cast(o_orderdate as date)) + 3000 as start_date, max(cast(o_orderdate as date)) as end_date
  from orders group by 1),
d as (select min(cast(l_shipdate as date)) as lo, max(cast(l_shipdate as date)) as hi from lineitem)
select_final select 'crisis_reversed' as rule, name as key, cast(start_date as varchar) as detail from shifted where start_date > end_date
union all select 'crisis_outside', name, cast(start_date as varchar) from shifted, d where end_date < lo or start_date > hi""")
def _(m):
    day = F.to_date("o_orderdate")
    spans = m.table("orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.date_add(F.min(day), 3000).alias("start_date"), F.max(day).alias("end_date"))
    return Q.crisis_rules(spans, m.table("lineitem").select(F.to_date("l_shipdate").alias("date")))


@query("rule_distress", keys="rule, key, detail", sql=X.panel("supplier") + """
last as (select entity, max(idx) as t, max(case when volume > 0 then idx else 0 end) as l from panel group by 1),
d as (select entity, case when t - l >= greatest(floor(t*0.005 + 0.5), 1) then l + 1 end as s from last)
select_final select 'distressed_early' as rule, entity as key, cast(s as varchar) as detail from d where s < 357
union all select 'distressed_many', cast(count(s) as varchar), cast(count(*) as varchar) from d
having count(s) > ceil(count(*)*0.25)""")
def _(m):
    d = T.detect_distress(m.panel("supplier"), {"volume": F.col("volume") == 0}, threshold=0.005)
    return Q.distress_rules(d, earliest=357)


@query("capability_flags", keys="family, supported", sql="""
t as (select count(*) > 0 as prices, count(l_discount) > 0 as cds from lineitem)
select_final select f as family, s as supported from (
select unnest(['bubbles_detection','component','connectedness','cross_entropy','cross_quantilogram','cross_sectional','default',
'liquidity','regime_switching','spillover','tail_dependence']) as f,
unnest([prices,prices,prices,prices and cds,prices,prices,prices and cds,prices,prices,prices,prices]) as s from t)""")
def _(m):
    obs = m.table("lineitem").agg(F.count(F.lit(1)).alias("n"), F.count("l_discount").alias("cds"))
    base = Q.capabilities(m.spark, {"prices", "returns", "caps", "volumes", "liabilities", "cds"})
    have = base.withColumn("n", obs.select("n").scalar()).withColumn("c", obs.select("cds").scalar())
    needs_cds = F.col("family").isin("cross_entropy", "default")
    return have.select("family", (F.col("supported") & (F.col("n") > 0) & (~needs_cds | (F.col("c") > 0))).alias("supported"))


@query("panel_contract", keys="rule", ints="violations", sql=X.panel() + """
select_final select unnest(['price_missing','price_outside','cds_missing','cds_outside','r_missing','r_outside']) as rule,
  unnest([count(*) filter (price is null), count(*) filter (price < 0), count(*) filter (cds is null),
  count(*) filter (cds < 0 or cds > 0.06), count(*) filter (r is null), count(*) filter (r < -0.5 or r > 0.5)]) as violations from rets""")
def _(m):
    return Q.panel_contract(m.returns(), {"price": (0.0, None), "cds": (0.0, 0.06), "r": (-0.5, 0.5)})


@query("rule_missing_share", keys="rule, key", sql=_CELLS + """
select_final select 'series_missing' as rule, entity as key from seen group by entity
  having avg(case when traded is null then 1.0 else 0.0 end) > 0.2
union all select 'panel_missing', '' from seen having avg(case when traded is null then 1.0 else 0.0 end) > 0.1""")
def _(m):
    return Q.missing_share(_seen(m), "traded", 0.2, 0.1)
