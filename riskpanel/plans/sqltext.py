"""Text of the shared common table expressions, for the SQL side of the registered queries."""

from __future__ import annotations

from riskpanel.functions import scalar as S


def panel(by: str = "brand", unit: str = "week") -> str:
    """CTEs obs, panel, rets."""
    if by == "supplier":
        src, key, unit_value = "lineitem", "'S' || cast(l_suppkey as varchar)", "1000.0"
    else:
        src, key, unit_value = "lineitem join part on l_partkey = p_partkey", "p_" + by, "p_retailprice"
    return f"""
obs as materialized (select {key} as entity, cast(date_trunc('{unit}', l_shipdate) as date) as date,
    sum(l_extendedprice)/sum(l_quantity) as price, sum(l_extendedprice) as volume,
    sum(l_quantity*{unit_value}) as cap, avg(l_discount) as cds from {src} group by 1, 2),
days as (select distinct cast(date_trunc('{unit}', l_shipdate) as date) as date from lineitem),
grid as (select e.entity, d.date from (select distinct entity from obs) e cross join days d),
marked as (select grid.entity, grid.date, price, volume, cap, cds,
    count(price) over (partition by grid.entity order by grid.date) as g
  from grid left join obs on grid.entity = obs.entity and grid.date = obs.date),
held as (select *, greatest(g, 1) as h from marked),
panel as materialized (select entity, date, row_number() over (partition by entity order by date) as idx,
    max(price) over (partition by entity, h) as price, coalesce(volume, 0.0) as volume,
    max(cap) over (partition by entity, h) as cap, max(cds) over (partition by entity, h) as cds from held),
rets as materialized (select entity, date, idx - 1 as idx, r, price, volume, cap, cds from (
    select *, ln(price) - ln(lag(price) over (partition by entity order by idx)) as r from panel) where idx > 1),
"""


def index(unit: str = "week") -> str:
    """CTE idx_rets (date, idx, r_m, rf)."""
    return f"""
idx_obs as (select cast(date_trunc('{unit}', l_shipdate) as date) as date,
    sum(l_extendedprice)/sum(l_quantity) as price, avg(l_tax) as rf from lineitem group by 1),
idx_rets as materialized (select * from (select date, row_number() over (order by date) - 1 as idx,
    ln(price) - ln(lag(price) over (order by date)) as r_m, rf from idx_obs) where idx > 0),
"""


BALANCE = """
balance as materialized (select p_brand as entity, cast(date_trunc('quarter', l_shipdate) as date) as period,
    sum(l_extendedprice) as assets, sum(l_extendedprice*l_discount) as equity,
    sum(case when l_returnflag = 'R' then 0.1*l_extendedprice else 0.0 end) as separate_accounts
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
"""

STATES = """
states as materialized (select cast(date_trunc('week', o_orderdate) as date) as date, o_orderpriority as var,
    avg(o_totalprice)/1e5 as value from orders group by 1, 2),
"""

GROUPS = """
groups as (select * from (values ('Group A','GA',7),('Group B','GB',6),('Group C','GC',8),('Group D','GD',4))
  as t(group_name, short_name, cnt)),
"""

CRISES = """
crises as (select name, cast(s as date) as start_date, cast(e as date) as end_date from (values
  ('Crisis 1','1996-03-04','1996-09-30'),('Crisis 2','1998-08-03','1999-01-29'),
  ('Crisis 3','2000-11-06','2001-03-26')) as t(name, s, e)),
"""

ENTITY_GROUP = GROUPS + """
ordered as (select entity, row_number() over (order by entity) as pos from (select distinct entity from panel)),
delims as (select short_name, sum(cnt) over (order by short_name) - cnt + 1 as lo,
    sum(cnt) over (order by short_name) as hi from groups),
entity_group as (select entity, pos, short_name from ordered join delims on pos between lo and hi),
"""


def norm_cdf(x: str) -> str:
    a = f"abs({x})"
    num, den = _horner(a, S.HART_NUM), _horner(a, S.HART_DEN)
    body = f"exp(-0.5*({x})*({x}))"
    far = f"{body}/({a}+1.0/({a}+2.0/({a}+3.0/({a}+4.0/({a}+0.65)))))/2.506628274631"
    tail = f"(case when {a} > 37.0 then 0.0 when {a} < 7.07106781186547 then {body}*{num}/{den} else {far} end)"
    return f"(case when ({x}) is null then null when ({x}) > 0 then 1.0 - {tail} else {tail} end)"


def norm_inv(p: str) -> str:
    q = f"(({p})-0.5)"
    s = f"(0.180625-{q}*{q})"
    r = f"sqrt(-ln(case when {q} < 0 then ({p}) else 1.0-({p}) end))"
    r1, r2 = f"({r}-1.6)", f"({r}-5.0)"
    tail = (f"(case when {r} <= 5.0 then {_horner(r1, S.AS241_C[::-1])}/{_horner(r1, S.AS241_D[::-1])} "
            f"else {_horner(r2, S.AS241_E[::-1])}/{_horner(r2, S.AS241_F[::-1])} end)")
    mid = f"{q}*{_horner(s, S.AS241_A[::-1])}/{_horner(s, S.AS241_B[::-1])}"
    return (f"(case when ({p}) <= 0.0 or ({p}) >= 1.0 then null when abs({q}) <= 0.425 then {mid} "
            f"when {q} < 0 then -{tail} else {tail} end)")


def _horner(x: str, coefficients) -> str:
    text = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        text = f"({text}*{x}+{c!r}::double)"
    return text


def hf5(sorted_list: str, p: float) -> str:
    """Definition-5 quantile of an ascending list expression."""
    n = f"len({sorted_list})"
    pos = f"least(greatest({n}*{p}+0.5, 1.0), {n}::double)"
    lo = f"cast(floor({pos}) as bigint)"
    low, high = f"{sorted_list}[{lo}]", f"{sorted_list}[least({lo}+1, {n})]"
    return f"({low} + ({pos} - {lo})*({high} - {low}))"


def head_fill(src: str, cols: list[str], k: int, keys: str = "entity") -> str:
    """Select that gives rows before k the values of row k."""
    rep = ", ".join(f"case when idx < {k} then max(case when idx = {k} then {c} end) over (partition by {keys}) "
                    f"else {c} end as {c}" for c in cols)
    return f"select * replace ({rep}) from {src}"
