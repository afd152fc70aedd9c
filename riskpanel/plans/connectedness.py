"""Causality network queries over the weekly brand panel."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from riskpanel.operators import describe as D
from riskpanel.operators import network as N
from riskpanel.operators import transforms as T
from riskpanel.plans import sqltext as X
from riskpanel.plans.registry import query
from riskpanel.plans.transforms import STOPPED, defaults, stopped
from riskpanel.session import cut_lineage
from riskpanel.sources import panels

BW = 52
K = T.head_rows(BW)
CUT = NormalDist().inv_cdf(0.95)
EDGES_SQL = X.panel() + X.ENTITY_GROUP + f"""
lags as (select entity, idx, r as y, lag(r) over (partition by entity order by idx) as x from rets),
prods as (select a.entity as src, b.entity as dst, a.idx, b.x*b.x as oo, a.x*a.x as ii, b.x*a.x as oi, b.x*b.y as oy, a.x*b.y as iy, b.y*b.y as yy
  from lags a join lags b on a.idx = b.idx and a.entity <> b.entity),
sums as (select src, dst, idx, least(idx, {BW}) as t, sum(oo) over w as oo, sum(ii) over w as ii, sum(oi) over w as oi, sum(oy) over w as oy,
  sum(iy) over w as iy, sum(case when x0 then 0.0 else yy end) over w as yy from (select *, oo is null as x0 from prods)
  window w as (partition by src, dst order by idx rows between {BW - 2} preceding and current row)),
coefs as (select *, oo*ii - oi*oi as d, (ii*oy - oi*iy)/(oo*ii - oi*oi) as b1, (oo*iy - oi*oy)/(oo*ii - oi*oi) as b2 from sums where idx >= {K}),
stats as (select *, b2/sqrt((yy - b1*oy - b2*iy)/(t - 3)*oo/d) as stat from coefs),
late_edges as (select idx, src, dst from stats where stat > {CUT!r}),
edges as materialized (select idx, src, dst from late_edges union all
  select g, src, dst from late_edges, range(1, {K}) t(g) where idx = {K}),
nn as (select count(*) as n from ordered), dates as (select distinct idx, date from rets),
"""


def edges(m, robust=False):
    return N.causal_edges(m.returns(), BW, 0.05, robust)


def nodes(m):
    """Every (idx, entity) of the panel."""
    return m.returns().select("idx", "entity")


def dates(m):
    return m.returns().select("idx", "date").distinct()


def count_entities(m) -> int:
    return m.observations().select("entity").distinct().count()


@query("connectedness_edges", keys="src, dst", ints="idx", sql=EDGES_SQL + "select_final select idx, src, dst from edges")
def _(m):
    return edges(m)


@query("connectedness_edges_robust", keys="src, dst", ints="idx")
def _(m):
    return edges(m, robust=True)


def dci(m, by="brand"):
    returns = cut_lineage(m.returns(by).select("entity", "idx", "date", "r"), lean=True)  # read three times
    return N.connectedness_sums(N.causal_degrees(returns, BW), m.observations(by), returns.select("idx", "date").distinct())


def _connectedness(m):
    groups = panels.entity_groups(m.observations(), m.groups())
    return N.connectedness_sums(N.causal_degrees(m.returns(), BW, entity_group=groups), m.observations(), dates(m), grouped=True)


@query("connectedness_dci", keys="date", nums="dci", sql=EDGES_SQL + """
c as (select idx, count(*) as e from edges group by 1)
select_final select d.date, coalesce(e, 0)/(n*n - n) as dci from dates d left join c on d.idx = c.idx, nn""")
def _(m):
    return dci(m)


@query("connectedness_dci_suppliers", keys="date", nums="dci", sql=EDGES_SQL.replace(X.panel(), X.panel("supplier")) + """
c as (select idx, count(*) as e from edges group by 1)
select_final select d.date, coalesce(e, 0)/(n*n - n) as dci from dates d left join c on d.idx = c.idx, nn""")
def _(m):
    return dci(m, "supplier")


@query("connectedness_after_distress", keys="date", nums="dci, cio", sql=STOPPED + """
kept as (select r.* from rets r left join distress d on r.entity = d.entity where distress_idx is null or r.idx + 1 < distress_idx),
""" + EDGES_SQL.removeprefix(X.panel()).replace("as x from rets)", "as x from kept)") + """
c as (select idx, count(*) as e from edges group by 1)
select_final select d.date, coalesce(e, 0)/(n*n - n) as dci, coalesce(e, 0)/(n - 1) as cio from dates d left join c on d.idx = c.idx, nn""")
def _(m):
    """From detection to measure: a brand that stops trading has no edges from then on."""
    panel = stopped(m)
    returns = T.masked_returns(T.log_returns(panel), defaults(panel))
    return N.connectedness_sums(N.causal_degrees(returns, BW), m.observations(), dates(m))


@query("connectedness_in_out", keys="date", nums="cio, cioo", sql=EDGES_SQL + """
c as (select e.idx, count(*) as e, sum(case when a.short_name is distinct from b.short_name then 1 else 0 end) as x from edges e
  left join entity_group a on e.src = a.entity left join entity_group b on e.dst = b.entity group by 1)
select_final select d.date, coalesce(e, 0)/(n - 1) as cio, coalesce(x, 0)/n as cioo from dates d left join c on d.idx = c.idx, nn""")
def _(m):
    return _connectedness(m)


_SYM = """
sym as (select e.idx, count(*) filter (b.src is null) = 0 as is_symmetric from edges e left join edges b
  on e.idx = b.idx and e.src = b.dst and e.dst = b.src group by 1),
deg0 as (select idx, entity, sum(i) as deg_in, sum(o) as deg_out from (select idx, src as entity, 0 as i, 1 as o from edges union all
  select idx, dst, 1, 0 from edges) group by 1, 2),
degs as (select d.*, is_symmetric, case when is_symmetric then deg_in else deg_in + deg_out end as deg from deg0 d join sym s on d.idx = s.idx),
"""


def _degrees(m):
    return N.complete(N.degree_sums(N.causal_degrees(m.returns(), BW), m.observations()), nodes(m), ["deg_in", "deg_out", "deg", "degree_centrality"])


@query("connectedness_degrees", keys="entity", ints="idx, deg_in, deg_out, deg", nums="degree_centrality", sql=EDGES_SQL + _SYM + """
select_final select r.idx, r.entity, coalesce(deg_in, 0) as deg_in, coalesce(deg_out, 0) as deg_out, coalesce(deg, 0) as deg, coalesce(deg, 0)/(n - 1) as degree_centrality
from rets r left join degs d on r.idx = d.idx and r.entity = d.entity, nn""")
def _(m):
    return _degrees(m)


_PATHS = """
hops(idx, src, node, depth) as (select idx, src, dst, 1 from edges
  union select h.idx, h.src, e.dst, h.depth + 1 from hops h join edges e on h.idx = e.idx and h.node = e.src
  where h.depth < 24 and e.dst <> h.src),
dist as (select idx, src, node, min(depth) as depth from hops group by 1, 2, 3),
"""


@query("connectedness_closeness", keys="entity", ints="idx", nums="closeness", sql=EDGES_SQL + _PATHS + """
select_final select r.idx, r.entity, coalesce((n - 1.0)/sum(depth), 0) as closeness from rets r left join dist on r.idx = dist.idx and r.entity = src, nn group by r.idx, r.entity, n""")
def _(m):
    return N.complete(N.batched_closeness(edges(m), count_entities(m)), nodes(m), ["closeness"])


_BETWEEN = """
sig(idx, src, node, depth, paths) as (select idx, src, dst, 1, 1.0::double from edges
  union all select s.idx, s.src, e.dst, s.depth + 1, sum(s.paths) from sig s join edges e on s.idx = e.idx and s.node = e.src
  join dist d on d.idx = s.idx and d.src = s.src and d.node = e.dst and d.depth = s.depth + 1 group by s.idx, s.src, e.dst, s.depth),
mid as (select a.idx, a.node as entity, sum(a.paths*b.paths/c.paths) as total from sig a join sig b on a.idx = b.idx and a.node = b.src and b.node <> a.src
  join sig c on c.idx = a.idx and c.src = a.src and c.node = b.node and c.depth = a.depth + b.depth group by 1, 2)
"""


@query("connectedness_betweenness", keys="entity", ints="idx", nums="betweenness", sql=EDGES_SQL + _PATHS + _BETWEEN + """
select_final select r.idx, r.entity, coalesce(total, 0)*2.0/((n - 1)*(n - 2)) as betweenness from rets r left join mid on r.idx = mid.idx and r.entity = mid.entity, nn""")
def _(m):
    return N.complete(N.batched_betweenness(edges(m), count_entities(m)), nodes(m), ["betweenness"])


@query("connectedness_eigenvector", keys="entity", ints="idx", nums="eigenvector")
def _(m):
    return N.complete(N.eigenvector_centrality(edges(m)), nodes(m), ["eigenvector"])


@query("connectedness_katz", keys="entity", ints="idx", nums="katz")
def _(m):
    return N.katz_centrality(edges(m), nodes(m))


_CLUST = _SYM + """
sub as (select a.idx, a.src as entity, count(*) as links, count(r.src) as two_way from edges a join edges b on a.idx = b.idx and a.src = b.src
  join edges c on c.idx = a.idx and c.src = a.dst and c.dst = b.dst left join edges r on r.idx = a.idx and r.src = b.dst and r.dst = a.dst group by 1, 2),
clust as (select d.idx, d.entity, case when deg > 1 then (case when is_symmetric then 2.0 else 1.0 end)*
  (case when coalesce(links, 0) = coalesce(two_way, 0) then coalesce(links, 0)/2.0 else links end)/(deg*(deg - 1)) else 0.0 end as clustering
  from degs d left join sub s on d.idx = s.idx and d.entity = s.entity)
"""


@query("connectedness_clustering", keys="entity", ints="idx", nums="clustering", sql=EDGES_SQL + _CLUST + """
select_final select r.idx, r.entity, coalesce(clustering, 0) as clustering from rets r left join clust c on r.idx = c.idx and r.entity = c.entity""")
def _(m):
    return N.complete(N.clustering(edges(m)), nodes(m), ["clustering"])


_AVERAGE = """
, share as (select src, dst, count(*)/(select count(*) from dates) as share from edges group by 1, 2),
avg_edges as (select 0 as idx, src, dst, share from share where share >= (select sum(share) from share)/(select n*n from nn))
"""


def _average(m):
    return N.average_adjacency(edges(m), dates(m).count(), count_entities(m))


@query("average_adjacency", keys="src, dst", nums="share", sql=EDGES_SQL.rstrip().rstrip(",") + _AVERAGE + "select_final select src, dst, share from avg_edges")
def _(m):
    return _average(m)


@query("average_adjacency_clustering", keys="entity", nums="clustering",
       sql=EDGES_SQL.replace("edges as materialized", "all_edges as materialized").rstrip().rstrip(",")
       + _AVERAGE.replace("from edges", "from all_edges").replace("avg_edges", "edges") + "," + _CLUST + "select_final select entity, clustering from clust")
def _(m):
    return N.clustering(_average(m))


@query("network_weights", keys="entity", nums="mean_degree, weight", sql=EDGES_SQL + _SYM + """
md as (select r.entity, coalesce(sum(deg), 0)/(select count(*) from dates) as mean_degree from rets r left join degs d on r.idx = d.idx and r.entity = d.entity group by 1)
select_final select entity, mean_degree, 0.25 + 3.75*(mean_degree - min(mean_degree) over ())/(max(mean_degree) over () - min(mean_degree) over ()) as weight from md""")
def _(m):
    return N.network_weights(_degrees(m), dates(m).count())


@query("ranked_centrality", keys="entity", ints="position", nums="total", sql=EDGES_SQL + _SYM + """
md as (select r.entity, coalesce(sum(deg/(n - 1)), 0) as total from rets r left join degs d on r.idx = d.idx and r.entity = d.entity, nn group by 1)
select_final select entity, total, row_number() over (order by round(total, 9) desc, entity) as position from md""")
def _(m):
    total = _degrees(m).groupBy("entity").agg(F.round(F.sum("degree_centrality"), 9).alias("total"))
    return D.rank_table(total, "total")
