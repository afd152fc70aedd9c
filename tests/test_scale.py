"""Structures that keep work spread: places over ranges, sums inside blocks, and growing quantile hits."""

import datetime
import math
import os
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskpanel.operators import blocks, network, quality, quantilogram, tail, transforms
from riskpanel.operators.ranks import positions, running_sums
from riskpanel.session import cut_lineage
from riskpanel.sources import panels, results


@pytest.fixture(scope="module")
def amounts(spark):
    """Two thirds of the rows share one group, one group key is null, and values repeat."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [None, "a", "b", "b", "b", "b"][i % 6], int(rng.integers(0, 9)), None if i % 7 == 0 else int(rng.integers(1, 50))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, kind string, v long, amount long"), rows


def test_positions_over_the_table_and_in_groups(amounts):
    df, rows = amounts
    got = {r.id: r.place for r in positions(df, [F.desc("v"), F.asc("id")], "place").collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    got = {r.id: r.place for r in positions(df, [F.asc("v"), F.asc("id")], "place", by=("kind",)).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    assert got == {r[0]: n for g in groups.values() for n, r in enumerate(sorted(g, key=lambda r: (r[2], r[0])), 1)}


def test_positions_hold_no_whole_table_in_one_task(amounts):
    for by in ((), ("kind",)):
        plan = positions(amounts[0], [F.asc("id")], "place", by=by)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Window" not in plan
    plan = running_sums(amounts[0], [F.asc("id")], "amount", "total")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_positions_of_empty_and_repeated_rows(spark, amounts):
    none = amounts[0].filter("id < 0")
    assert positions(none, [F.asc("id")], "place", by=("kind",)).collect() == []
    assert running_sums(none, [F.asc("id")], "amount", "total").collect() == []
    same = spark.createDataFrame([("x", 1)] * 50, "kind string, v long")
    assert sorted(r.place for r in positions(same, [F.asc("v")], "place").collect()) == list(range(1, 51))


def test_running_sums_skip_nulls(amounts):
    df, rows = amounts
    got = {r.id: r.total for r in running_sums(df, [F.asc("id")], "amount", "total").collect()}
    total, seen = 0, False
    for r in rows:
        total, seen = total + (r[3] or 0), seen or r[3] is not None
        assert got[r[0]] == (total if seen else None)


def test_group_bounds(spark):
    groups = spark.createDataFrame([("B", "b", 3), ("A", "a", 2), ("C", "c", 1)], "name string, short_name string, cnt long")
    assert {(r.short_name, r.lo, r.hi) for r in panels.group_bounds(groups).collect()} == {("a", 1, 2), ("b", 3, 5), ("c", 6, 6)}


@pytest.mark.parametrize("robust", [False, True])
def test_degrees_summed_in_blocks(returns, spark, monkeypatch, robust):
    """Blocks of two entities, so that every pair of buckets is a task; a series with a gap; entities outside all groups."""
    small = returns.filter("idx <= 70 and not (entity = 'Brand#3' and idx = 40)")
    whole = blocks.pair_blocks
    monkeypatch.setattr(blocks, "pair_blocks", lambda df, value, bw, kernel, schema, block=64, chunk=64, label=None: whole(
        df, value, bw, kernel, schema, 2, chunk, label))
    group = {"Brand#1": "x", "Brand#2": "x", "Brand#3": "y", "Brand#4": None, "Brand#5": None}
    groups = spark.createDataFrame(list(group.items()), "entity string, short_name string")
    edges = {(r.idx, r.src, r.dst) for r in network.causal_edges(small, 30, 0.2, robust).collect()}
    out, back, mutual, cross = Counter(), Counter(), Counter(), Counter()
    for i, s, d in edges:
        out[i, s] += 1
        back[i, d] += 1
        mutual[i, s] += (i, d, s) in edges
        cross[i, s] += group[s] != group[d]
    got = network.causal_degrees(small, 30, 0.2, robust, groups).collect()
    assert len(got) == len(out.keys() | back.keys()) and sum(out.values()) == len(edges) > 100
    assert all((r.deg_out, r.deg_in, r.mutual, r.cross_out) == tuple(c[r.idx, r.entity] for c in (out, back, mutual, cross)) for r in got)


def test_connectedness_from_sums_is_that_from_edges(returns, spark):
    small = returns.filter("idx <= 70")
    groups = spark.createDataFrame([("Brand#1", "x"), ("Brand#2", "x"), ("Brand#3", "y")], "entity string, short_name string")
    dates, edges = small.select("idx").distinct(), network.causal_edges(small, 30)
    for g in (None, groups):
        a = network.connectedness(edges, small, dates, g)
        b = network.connectedness_sums(network.causal_degrees(small, 30, entity_group=g), small, dates, g is not None)
        assert sorted(map(tuple, a.select("idx", "dci", "cio", "cioo").collect())) == sorted(map(tuple, b.select("idx", "dci", "cio", "cioo").collect()))
    cols = ["idx", "entity", "deg_in", "deg_out", "deg", "degree_centrality"]
    a, b = network.degrees(edges, entities=small), network.degree_sums(network.causal_degrees(small, 30), small)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_chi_summed_in_blocks(returns):
    pairs = defaultdict(list)
    for r in tail.chi_pairs(returns, 60).collect():
        pairs[r.idx].append(r.chi)
    got = tail.chi_metrics(tail.chi_sums(returns, 60)).collect()
    assert {r.idx for r in got} == pairs.keys()
    for r in got:
        assert math.isclose(r.achi, np.mean(pairs[r.idx]), abs_tol=1e-12) and math.isclose(r.adr, np.mean(np.array(pairs[r.idx]) > 0), abs_tol=1e-12)


@pytest.mark.parametrize("columns, ties", [(2, False), (2, True), (4, False), (3, True)])
def test_growing_hits_are_those_of_every_sample(columns, ties):
    """Against hits taken anew for each sample size; with ties many values stand at the quantile."""
    x = np.random.default_rng(columns).standard_normal((90, columns))
    x, lags = np.round(x * 2) if ties else x, 25
    counts = quantilogram.GrowingHits(x, 0.1, lags)
    for n in range(1, 91):
        counts.take()
        hits = (x[:n] <= np.quantile(x[:n], 0.1, axis=0)) - 0.1
        for lead in (0, 1):
            h = hits[:, [lead, 1 - lead, *range(2, columns)]]
            grams = counts.grams(lead)
            for k in range(1, lags + 1):
                if k >= n:
                    assert np.isnan(grams[k - 1]).all()
                    continue
                d = np.column_stack([h[k:, 0], h[:n - k, 1:]])
                np.testing.assert_allclose(grams[k - 1], d.T @ d, atol=1e-9)


# ---------------------------------------------------------------- results, schema, short panels, distress

def test_results_count_once_their_entry_is_written(spark, tmp_path, monkeypatch):
    """A repeated write replaces, a job that dies before its entry leaves nothing, another serial stays."""
    root = str(tmp_path / "results")

    def rows(serial, category, *values):
        return spark.createDataFrame([(serial, category, "x", datetime.date(2020, 1, n), float(v)) for n, v in enumerate(values, 1)],
                                     "serial string, category string, indicator string, date date, value double")

    def read():
        return sorted(((r.serial, r.category, r.date.day, r.value) for r in results.stored(spark, root).collect()), key=str)

    old = results.store(rows("007", "A", 1, 2), root)
    results.store(rows("8", "A", 5), root)
    assert read() == [("007", "A", 1, 1.0), ("007", "A", 2, 2.0), ("8", "A", 1, 5.0)]
    results.store(rows("007", "A", 3).unionByName(rows("007", None, 4)), root)
    assert read() == [("007", "A", 1, 3.0), ("007", None, 1, 4.0), ("8", "A", 1, 5.0)]
    with monkeypatch.context() as patch:
        patch.setattr(F, "current_timestamp", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            results.store(rows("8", "A", 9, 9), root)
    assert [r.rows for r in results.catalogue(spark, root).collect()] == [1, 1, 1]
    assert read() == [("007", "A", 1, 3.0), ("007", None, 1, 4.0), ("8", "A", 1, 5.0)]
    gone = results.drop_superseded(spark, root)
    assert old in gone and len(gone) == 2
    assert results.stored(spark, root).count() == 3


def test_table_contract(spark):
    df = spark.createDataFrame([(1, "5", None), (None, "x", 2.0), (3, None, None)], "a long, b string, `c.d` double")
    got = {(r.rule, r.name): r.cells for r in quality.table_contract(df, StructType.fromDDL("a long not null, b int, e date")).collect()}
    assert got == {("null", "a"): 1, ("type", "b"): 1, ("missing", "e"): 3, ("extra", "c.d"): 1}
    same = StructType.fromDDL("a long, b string, `c.d` double")
    assert quality.table_contract(df, same).collect() == []
    none = quality.table_contract(df.limit(0), StructType.fromDDL("a long not null, b int, `c.d` double")).collect()
    assert {(r.rule, r.name): r.cells for r in none} == {("null", "a"): 0, ("type", "b"): 0}


@pytest.mark.parametrize("length, bw", [(3, 30), (30, 30), (31, 30), (12, 5)])
@pytest.mark.parametrize("truncate", [False, True])
def test_windows_of_short_series(spark, length, bw, truncate):
    """As many rows as the bandwidth, or fewer, are one window, even below the first head row."""
    x = [float((7 * i) % 11) for i in range(length)]
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate(x, 1)], "entity string, idx long, r double")
    k = transforms.head_rows(bw)
    if bw >= length:
        want = {length: sum(x)}
    elif truncate:
        want = {i: sum(x[i - bw:i]) for i in range(bw, length + 1)}
    else:
        want = {i: sum(x[max(0, i - bw):max(i, k)]) for i in range(1, length + 1)}
    got = {r.idx: r.s for r in transforms.rolling(df, bw, truncate, s=F.sum("r")).collect()}
    assert got == want
    if not truncate:
        assert {r.idx: sum(x[r.lo - 1:r.hi]) for r in transforms.window_bounds(df, bw).collect()} == want


def test_returns_after_distress_are_missing(spark, returns):
    """The panel row of distress is one after the return's."""
    distress = spark.createDataFrame([("Brand#1", 50), ("Brand#2", None)], "entity string, distress_idx long")
    got = {(r.entity, r.idx): r.r for r in transforms.masked_returns(returns, distress).collect()}
    assert len(got) == returns.count()
    assert all((v is None) == (e == "Brand#1" and i >= 49) for (e, i), v in got.items())
    edges = network.causal_edges(transforms.masked_returns(returns, distress), 30).filter("'Brand#1' in (src, dst)")
    assert edges.count() > 0 and edges.filter("idx >= 49").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_length_deals_out_rows_and_not_pairs(spark):
    from riskpanel.operators import quantilogram
    x = np.random.default_rng(3).normal(size=90).cumsum() * 0.1
    rows = [("a", i, float(v)) for i, v in enumerate(x) if i not in (20, 21)] + [("b", i, float(v)) for i, v in enumerate(np.diff(x))] + [("a", 30, 0.5), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "entity string, idx long, r double")
    out = quantilogram.optimal_block_length(df, "r")
    dealt = [line for line in _plan(out).splitlines() if "hashpartitioning" in line]
    assert dealt and not any("idx" in line.split("hashpartitioning")[1].split(")")[0] for line in dealt)

    def length(rows):
        t, at = len(rows), [(i, v) for _, i, v in rows]
        run = math.floor(max(math.sqrt(math.log10(t)), 5))
        limit = math.ceil(math.sqrt(t)) + run
        pairs = {k: [(i, v, w) for i, v in at for j, w in at if i - j == k] for k in range(limit + 1)}
        rho = {k: np.corrcoef([(v, w) for i, v, w in pairs[k] if i > limit], rowvar=False)[0, 1] for k in range(1, limit + 1)}
        small = {k: abs(c) < 2 * math.sqrt(math.log10(t) / t) for k, c in rho.items()}
        quiet = [k for k in small if all(small.get(k + j, False) for j in range(run))]
        m = min(2 * (min(quiet) if quiet else max([k for k in small if not small[k]], default=1)), limit)
        cov = {k: np.cov([(v, w) for i, v, w in pairs[k] if i > m], rowvar=False)[0, 1] for k in range(m + 1)}
        weight = {k: (1 if k / m < 0.5 else 2 * (1 - k / m)) * (2 if k else 1) for k in cov}
        level, slope = sum(weight[k] * cov[k] for k in cov), sum(weight[k] * cov[k] * k for k in cov)
        return min((slope * slope * t / level ** 2) ** (1 / 3), math.ceil(min(3 * math.sqrt(t), t / 3)))

    got = {r.entity: r.block_length for r in out.collect()}
    assert got.keys() == {"a", "b"}
    for e, v in got.items():
        assert math.isclose(v, length([r for r in rows if r[0] == e]), rel_tol=1e-9)


@pytest.mark.parametrize("same", [True, False])
def test_causal_links_of_all_pairs_at_once(monkeypatch, same):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(52, 60))
    x[1:, 1] = x[:-1, 0]  # led
    x[:, 2], x[:, 3], x[:, 4] = x[:, 0], 2 * x[:, 0], x[:, 0] + 1e-9 * x[:, 5]  # equal, collinear, nearly so
    x[:, 6], x[7, 7], x[:, 8] = 0.0, np.nan, 0.9 ** np.arange(52)  # nothing, a gap, its own past alone
    x[:, 9], x[:, 10] = 0.0, 0.0
    x[5, 9], x[51, 10] = 1.0, 1.0
    block = blocks.Block.__new__(blocks.Block)
    block.x, block.names, block.same = x, np.array([f"n{i}" for i in range(60)]), same
    block.left, block.right = (np.arange(60), np.arange(60)) if same else (np.arange(0, 60, 2), np.arange(1, 60, 2))
    cut, looked = 1.6448536269514722, []
    pairs = [np.repeat(block.left, len(block.right)), np.tile(block.right, len(block.left))]
    with np.errstate(all="ignore"):
        want = network._tested(x, *pairs, cut, False), network._tested(x, *pairs[::-1], cut, False)
    whole = network._regression
    monkeypatch.setattr(network, "_regression", lambda y, o, i: looked.append(y.shape[1]) or whole(y, o, i))
    to, back = network._links(block, 0, 52, cut, False)
    shape = (len(block.left), len(block.right))
    assert (to == want[0].reshape(shape)).all() and (back == want[1].reshape(shape)).all() and to.sum() + back.sum() > 50
    assert sum(looked) < 0.1 * to.size


def _odd_columns(rng, x):
    x[1:, 1] = x[:-1, 0]
    x[:, 2], x[:, 3], x[:, 4], x[:, 5] = x[:, 0], -x[:, 0], x[:, 0] + 1e-9 * x[:, 5], x[:, 0] + 0.05 * x[:, 5]
    x[:, 6], x[3, 7], x[:, 8], x[:, 9] = 0.0, np.nan, 0.9 ** np.arange(len(x)), 0.0
    x[5, 9] = 1.0
    return x


def _brute_degrees(x, cut, group):
    """By regressions of all ordered pairs of columns: edges out, in, those with a counterpart, those into other groups."""
    n = x.shape[1]
    src, dst = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    with np.errstate(all="ignore"):
        edge = network._tested(x, src, dst, cut, False).reshape(n, n) & ~np.eye(n, dtype=bool)
    return np.array([edge.sum(1), edge.sum(0), (edge & edge.T).sum(1), (edge & (group[:, None] != group[None])).sum(1)])


def _block_of(x, same):
    block = blocks.Block.__new__(blocks.Block)
    n = x.shape[1]
    block.x, block.names, block.same = x, np.array([f"n{i:03}" for i in range(n)]), same
    block.left, block.right = (np.arange(n), np.arange(n)) if same else (np.arange(0, n, 3), np.setdiff1d(np.arange(n), np.arange(0, n, 3)))
    block.labels = np.array([("=x", "=y", "")[i % 3] if i % 2 else "=x" for i in range(n)], dtype=object)
    return block


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("alike", [0.0, 0.999999])
def test_counts_of_a_block_by_its_sides(monkeypatch, same, alike):
    """Sides of 16 entities; with nearly collinear series single precision leaves most pairs open and double precision judges."""
    rng = np.random.default_rng(3)
    x = alike * rng.normal(size=(52, 1)) + (1 - alike) * rng.normal(size=(52, 75))
    x = _odd_columns(rng, x) if not alike else x
    block, cut, judged = _block_of(x, same), 1.6448536269514722, []
    monkeypatch.setattr(network, "SIDE", 16)
    whole = network._Window._judged
    monkeypatch.setattr(network._Window, "_judged", lambda self, *a: judged.append(a[3].dtype) or whole(self, *a))
    got = network._counts(block, 0, 52, cut, False, True)
    group = block.groups
    want = _brute_degrees(x, cut, group)
    if not same:  # pairs within a side are not of this block
        for side in (block.left, block.right):
            want[:, side] -= _brute_degrees(x[:, side], cut, group[side])
    assert (got == want).all() and got[0].sum() > 50
    assert (judged.count(np.float64) > judged.count(np.float32) / 2) == bool(alike)


def test_single_precision_leaves_few_pairs_open_and_errs_in_none():
    x = np.random.default_rng(8).normal(size=(52, 1500))
    window = network._Window(_block_of(x, True), 0, 52, 1.6448536269514722, False)
    left, right, open_ = np.arange(700), np.arange(700, 1500), []
    unlike = window._unlike
    window._unlike = lambda pairs, *sides: open_.append(np.count_nonzero(pairs)) or unlike(pairs, *sides)
    rough = window._judged(left, right, False, *window.rough, network.FLAT, window.rough_close, network.OPEN)
    assert 0 < sum(open_) < 0.0005 * rough[0].size
    exact = window._judged(left, right, False, window.past, window.rest, network.VAGUE ** 2, network.CLOSE, 1.0)
    assert all((a == b).all() for a, b in zip(rough, exact)) and rough[0].sum() > 10_000


def test_sums_of_pairs_travel_packed(spark, monkeypatch):
    """Buckets of several tiles: a task sends a few arrays and no row an entity and window; gaps, nulls and a late series."""
    t, n, bw, group = 25, 120, 15, np.arange(120) % 3
    x = _odd_columns(None, np.random.default_rng(4).normal(size=(t, n)))
    x[:19, 11], x[10:13, 12] = np.nan, np.nan
    rows = [(f"n{j:03}", i + 1, None if np.isnan(x[i, j]) else float(x[i, j])) for j in range(n) for i in range(t) if j not in (11, 12) or not np.isnan(x[i, j])]
    returns = spark.createDataFrame(rows, "entity string, idx long, r double")
    groups = spark.createDataFrame([(f"n{j:03}", f"g{group[j]}") for j in range(n)], "entity string, short_name string")
    monkeypatch.setattr(blocks, "TILE", 10)
    monkeypatch.setattr(network, "WIDE", 50)
    monkeypatch.setattr(network, "RUN", 8)
    whole, sent = blocks.pair_blocks, []
    monkeypatch.setattr(blocks, "pair_blocks", lambda *a, **b: sent.append(whole(*a, **b)) or sent[-1])
    degrees = network.causal_degrees(returns, bw, 0.2, False, groups)
    got = {(r.idx, r.entity): (r.deg_out, r.deg_in, r.mutual, r.cross_out) for r in degrees.collect()}
    want, k = {}, transforms.head_rows(bw)
    for w in range(1, t + 1):
        found = _brute_degrees(x[max(0, w - bw):max(w, k)], 0.8416212335729143, group)
        want |= {(w, f"n{j:03}"): tuple(int(v) for v in found[:, j]) for j in range(n) if found[:, j].any()}
    assert got == want and len(want) > 2000
    assert degrees.dtypes == [("idx", "bigint"), ("entity", "string"), ("deg_out", "bigint"), ("deg_in", "bigint"), ("mutual", "bigint"), ("cross_out", "bigint")]
    assert sent[0].count() < 400


def test_sums_of_numbers_that_are_none(spark, monkeypatch):
    """A sum leaves out what is not a number, is null where nothing is left, and has no row where every part is zero."""
    returns = spark.createDataFrame([(f"e{j}", i, 1.0) for j in range(6) for i in range(1, 9)], "entity string, idx long, r double")

    def kernel(block, w, lo, hi):
        other = len(block.names) if block.same else 10 * len(block.names)
        total = np.where(block.names == "e1", np.nan, np.where(block.names == "e2", 0.0, 0.5))
        total = np.where((block.names == "e3") & (not block.same), np.nan, total)
        return [np.where(block.names == "e4", -70_000, 0) + 0 * other, total * (w > 2)]

    got = {(r.idx, r.entity): (r.a, r.b) for r in blocks.pair_sums(returns, "r", 6, kernel, {"a": "long", "b": "double"}, block=2).collect()}
    assert {e for w, e in got if w > 2} == {"e0", "e1", "e3", "e4", "e5"} and all(got[w, "e1"] == (0, None) for w in range(3, 9))
    assert all(got[w, "e4"][0] % 70_000 == 0 and got[w, "e4"][0] < 0 and got[w, "e0"][1] > 0 for w in range(3, 9))


def test_lean_tables_leave_no_shuffles_behind(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffles():
        return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}

    before, key = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    out = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), lean=True)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(key) == was
    assert {tuple(r) for r in out.collect()} == {(k, len(range(k, 1000, 7))) for k in range(7)}


def test_shapiro_ranks_once_and_panels_are_dealt_by_their_dense_rows(spark, monkeypatch):
    from riskpanel.operators import describe
    from riskpanel.sources import market
    small = "/root/testdata/sf0.001"
    one = market.Market(spark, small)
    out = describe.shapiro_test(one.returns("supplier"), "r")
    assert _plan(out).count("row_number") <= _plan(describe.shapiro_francia(one.returns("supplier"), "r")).count("row_number")
    monkeypatch.setattr(market, "TASK_ROWS", 200)
    many = market.Market(spark, small)
    assert "REPARTITION_BY_NUM" in _plan(many.panel("supplier")) and "REPARTITION_BY_NUM" not in _plan(one.panel("supplier"))
    rows = many.panel("supplier").count()
    assert many._parts("supplier", "week", 7) >= rows // 200 and rows == one.panel("supplier").count()
    assert sorted(describe.shapiro_test(many.returns("supplier"), "r").collect()) == sorted(out.collect())
