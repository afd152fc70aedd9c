"""Operators SQL cannot follow, against direct loops on a small panel, and their invariants."""

import inspect
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.functions import scalar as S
from riskpanel.operators import bubbles, component, compare, crosssection, default, entropy, liquidity, network, quantilogram, regime
from riskpanel.operators import spillover, tail, transforms
from riskpanel.operators.series import halton
from riskpanel.plans import load

BW = 30
K = transforms.head_rows(BW)


def windows(matrix):
    x = matrix.to_numpy()
    for w in range(1, len(x) + 1):
        yield w, x[max(0, w - BW):max(w, K)]


def keyed(rows, value, *keys):
    return {tuple(r[k] for k in keys): r[value] for r in rows}


# ---------------------------------------------------------------- functions

def test_normal_functions(spark):
    nd = NormalDist()
    xs = [-9.0, -5.0, -1.5, -0.2, 0.0, 0.7, 3.0, 7.5]
    ps = [1e-12, 0.001, 0.07, 0.5, 0.8, 0.999]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(S.norm_cdf(F.col("x"))).collect()
    assert np.allclose([r[0] for r in got], [nd.cdf(x) for x in xs], atol=1e-14)
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(S.norm_inv(F.col("p"))).collect()
    assert np.allclose([r[0] for r in got], [nd.inv_cdf(p) for p in ps], rtol=1e-13)


def test_tail_approximations(spark):
    row = spark.range(1).select(S.chi2_sf(F.lit(31.41), F.lit(20.0)), S.t_sf(F.lit(2.086), F.lit(20.0)),
                                S.f_inv(F.lit(0.95), F.lit(3.0), F.lit(60.0))).first()
    assert abs(row[0] - 0.05) < 0.002 and abs(row[1] - 0.025) < 0.001 and abs(row[2] - 2.758) < 0.03


def test_halton_is_deterministic():
    h = halton(100, [0.0, 1.0], [1.0, 3.0])
    assert (h == halton(100, [0.0, 1.0], [1.0, 3.0])).all() and h[:, 1].min() >= 1.0 and abs(h.mean(0) - [0.5, 2.0]).max() < 0.05


# ---------------------------------------------------------------- rolling sections and pairs

def test_rolling_cov(returns, matrix):
    got = keyed(component.rolling_cov(returns, BW).collect(), "cov", "idx", "src", "dst")
    names = list(matrix.columns)
    assert len(got) == len(matrix) * 15
    for w, x in windows(matrix):
        c = np.cov(x, rowvar=False)
        for i, a in enumerate(names):
            for j in range(i, 5):
                assert abs(got[w, a, names[j]] - c[i, j]) < 1e-12


def test_blocks_of_two_agree_with_one_block(returns):
    from riskpanel.operators.blocks import pair_blocks

    def kernel(b):
        return [b.edges(w, b.i, b.j, slice(None), v=(b.x[lo:hi, b.i] * b.x[lo:hi, b.j]).sum(0)) for w, lo, hi in b.windows]

    schema = "idx long, src string, dst string, v double"
    flat = lambda df: {(r.idx, *sorted((r.src, r.dst))): round(r.v, 12) for r in df.collect()}
    whole, split = (flat(pair_blocks(returns, "r", BW, kernel, schema, block=n, chunk=c)) for n, c in ((64, 200), (2, 30)))
    assert whole == split and len(whole) == 120 * 10


def test_component_metrics(returns, matrix):
    got = {r.idx: r for r in component.component_metrics(returns, BW, 0.2).collect()}
    for w, x in windows(matrix):
        c = np.cov(x, rowvar=False)
        e = np.sort(np.linalg.eigvalsh(c))[::-1]
        v = x[-1] - x[:-1].mean(0)
        ti = v @ np.linalg.inv(c) @ v
        assert abs(got[w].ar - e[0] / e.sum()) < 1e-9
        assert abs(got[w].ti - ti) < 1e-6 * abs(ti) and abs(got[w].cs - ti / (v * v / np.diag(c)).sum()) < 1e-6


def test_window_pca(returns, matrix):
    rows = component.window_pca(returns, BW).filter("idx = 60").collect()
    x = matrix.to_numpy()[30:60]
    values, vectors = np.linalg.eigh(np.corrcoef(x, rowvar=False))
    load = {(r.component, r.entity): r.loading for r in rows}
    for c in (1, 2, 3):
        v = vectors[:, -c] * np.sign(vectors[np.abs(vectors[:, -c]).argmax(), -c])
        assert np.allclose([load[c, n] for n in matrix.columns], v, atol=1e-9)
    assert abs({r.component: r.explained for r in rows}[1] - values[-1] / 5 * 100) < 1e-9


def test_pca_wide_and_biplot(market):
    from riskpanel.plans.describe import _MEASURES, measures
    cols = list(_MEASURES)
    wide = measures(market)
    load, explained, scores = component.pca_wide(wide, cols, ["idx"])
    x = wide.orderBy("idx").select(*cols).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = scores.orderBy("idx").toPandas()[[f"pc{i}" for i in range(1, 6)]].to_numpy()
    assert np.allclose(got, z @ load, atol=1e-8) and abs(explained.sum() - 100) < 1e-9
    biplot = component.pca_biplot(load, cols, scores, ["idx"]).toPandas()[["pc1", "pc2", "pc3"]].to_numpy()
    assert abs(np.abs(biplot).max() - np.sqrt((load[:, :3] ** 2).sum(1).max())) < 1e-9


def direct_edge(out, inn, robust):
    y, x = out[1:], np.column_stack([out[:-1], inn[:-1]])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    if not robust:
        return b[1] / math.sqrt(e @ e / (len(out) - 3) * np.linalg.inv(x.T @ x)[1, 1])
    m = len(y)
    h = e[:, None] * x
    q, o = x.T @ x / m, h.T @ h / m
    lags = int(math.floor(0.1 * m + 0.5))
    for i in range(1, lags):
        g = h[:-i].T @ h[i:] / (m - i)
        o = o + (lags - i) / lags * (g + g.T)
    c = np.linalg.inv(q) @ o @ np.linalg.inv(q)
    return b[1] / math.sqrt(c[1, 1] / m)


@pytest.mark.parametrize("robust", [False, True])
def test_causal_edges(returns, matrix, robust):
    got = {(r.idx, r.src, r.dst) for r in network.causal_edges(returns, BW, 0.05, robust).collect()}
    names, want = list(matrix.columns), set()
    for w, x in windows(matrix):
        for i in range(5):
            for j in range(5):
                if i != j and 1 - NormalDist().cdf(direct_edge(x[:, j], x[:, i], robust)) < 0.05:
                    want.add((w, names[i], names[j]))
    assert got == want


def test_planted_lag_gives_an_edge(returns, matrix):
    from pyspark.sql import Window
    w = Window.partitionBy("entity").orderBy("idx")
    copy = returns.filter("entity = 'Brand#4'").withColumn("r", F.coalesce(F.lag("r").over(w), F.lit(0.0))).withColumn("entity", F.lit("copy"))
    both = returns.filter("entity <> 'Brand#5'").unionByName(copy)
    hits = network.causal_edges(both, BW).filter("src = 'Brand#4' and dst = 'copy' and idx >= 30").count()
    assert hits == 91


# ---------------------------------------------------------------- graphs

EDGES = [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("4", "5"), ("1", "5"), ("5", "2")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([(7, a, b) for a, b in EDGES], "idx long, src string, dst string")


def brute_paths():
    out = {}
    for s in "12345":
        level, dist, count = {s}, {s: 0}, {s: 1}
        while level:
            nxt = {}
            for a, b in EDGES:
                if a in level and b not in dist:
                    nxt[b] = nxt.get(b, 0) + count[a]
            for b in nxt:
                dist[b], count[b] = dist[next(a for a, c in EDGES if c == b and a in level)] + 1, nxt[b]
            level = set(nxt)
        out[s] = dist, count
    return out


def test_closeness_and_betweenness(graph):
    paths = network.shortest_paths(graph)
    brute = brute_paths()
    close = keyed(network.closeness(paths, 5).collect(), "closeness", "entity")
    for s, (dist, _) in brute.items():
        assert abs(close[(s,)] - 4 / sum(dist.values())) < 1e-12
    want = dict.fromkeys("12345", 0.0)
    for s, (ds, cs) in brute.items():
        for t in ds:
            for v in ds:
                if v not in (s, t) and s != t:
                    dv, cv = brute[v]
                    if t in dv and ds[v] + dv[t] == ds[t]:
                        want[v] += cs[v] * cv[t] / cs[t]
    got = keyed(network.betweenness(graph, paths, 5).collect(), "betweenness", "entity")
    for v, x in want.items():
        assert abs(got.get((v,), 0.0) - x * 2 / 12) < 1e-12


def random_edges(rnd, nodes, count):
    return sorted({(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(count)})


def test_batches_of_sources_equal_all_sources(spark):
    rnd = random.Random(9)
    rows = [(g, a, b) for g in (1, 2, 3) for a, b in random_edges(rnd, 14, 30 * g)]
    graph = spark.createDataFrame(rows, "idx long, src string, dst string")
    paths = network.shortest_paths(graph)
    for name, whole, batched in (("closeness", network.closeness(paths, 14), network.batched_closeness(graph, 14, 3)),
                                 ("betweenness", network.betweenness(graph, paths, 14), network.batched_betweenness(graph, 14, 3))):
        want, got = keyed(whole.collect(), name, "idx", "entity"), keyed(batched.collect(), name, "idx", "entity")
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)
    assert network.batched_betweenness(graph.limit(0), 14).count() == 0


def test_triangles(spark):
    rnd = random.Random(10)
    rows = [(g, a, b) for g in (1, 2) for a, b in random_edges(rnd, 12, 70 * g)]
    got = {(r["idx"], r["entity"]): (r["links"], r["two_way"]) for r in network.triangles(spark.createDataFrame(rows + rows[:5], network.EDGE)).collect()}
    for g in (1, 2):
        own = {(a, b) for i, a, b in rows if i == g and a != b}
        for node in {x for e in own for x in e}:
            out = [b for a, b in own if a == node]
            among = [(j, k) for j in out for k in out if (j, k) in own]
            assert got.get((g, node), (0, 0)) == (len(among), sum((k, j) in own for j, k in among))


@pytest.mark.parametrize("local", [0, 200_000])
def test_krylov_cycles(spark, monkeypatch, local):
    """A dense graph, a ring, a path without a cycle, a cycle behind a long path, and an undirected star; joins and tasks."""
    from riskpanel.operators import krylov
    monkeypatch.setattr(krylov, "LOCAL_EDGES", local)
    rnd = random.Random(11)
    path = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(13)]
    graphs = [random_edges(rnd, 40, 400), [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)], path, path + [("p13", "p12"), ("p05", "p01")],
              [e for i in range(6) for e in (("hub", f"s{i}"), (f"s{i}", "hub"))]]
    rows = [(g, a, b) for g, own in enumerate(graphs) for a, b in own]
    edges = spark.createDataFrame(rows + rows[:9], network.EDGE)
    vectors = {(r["idx"], r["node"]): r["value"] for r in krylov.dominant_vectors(edges).collect()}
    solved = {(r["idx"], r["node"]): r["value"] for r in krylov.resolvents(edges, 0.1).collect()}
    for g, own in enumerate(graphs):
        names = sorted({x for e in own for x in e})
        a = np.zeros((len(names), len(names)))
        for x, y in own:
            a[names.index(x), names.index(y)] = 1
        power = a + np.eye(len(names))
        for _ in range(0 if g == 2 else 40):
            power = power @ power
            power /= power.sum()
        want = power.sum(1) if g != 2 else np.eye(len(names))[0]  # the only walk of full length starts at p00
        assert np.allclose([vectors[g, n] for n in names], want, atol=1e-7), g
        assert np.allclose([solved[g, n] for n in names], np.linalg.solve(np.eye(len(names)) - 0.1 * a, np.ones(len(names))), atol=1e-9), g
    assert krylov.dominant_vectors(edges.limit(0)).count() == 0 and krylov.resolvents(edges.limit(0), 0.1).count() == 0


def test_spectral_centralities(spark, graph):
    a = np.zeros((6, 6))
    for i, j in EDGES:
        a[int(i) - 1, int(j) - 1] = 1
    values, vectors = np.linalg.eig(a[:5, :5])
    v = np.abs(vectors[:, values.real.argmax()])
    k = np.linalg.solve(np.eye(6) - 0.1 * a, np.ones(6))
    idx = graph.first()["idx"]
    nodes = spark.createDataFrame([(i, n) for i in (idx, idx + 1) for n in "123456"], "idx long, entity string")
    e = network.complete(network.eigenvector_centrality(graph), nodes, ["eigenvector"])
    z = network.katz_centrality(graph, nodes)
    here = keyed(e.filter(e.idx == idx).collect(), "eigenvector", "entity"), keyed(z.filter(z.idx == idx).collect(), "katz", "entity")
    assert np.allclose([here[0][(n,)] for n in "123456"], [*(v / v.sum()), 0.0], atol=1e-6)
    assert np.allclose([here[1][(n,)] for n in "123456"], k / np.linalg.norm(k), atol=1e-9)
    assert {r["eigenvector"] for r in e.filter(e.idx == idx + 1).collect()} == {0.0}
    assert all(abs(r["katz"] - 6 ** -0.5) < 1e-12 for r in z.filter(z.idx == idx + 1).collect())


def test_every_node_has_a_row(market):
    from riskpanel.plans import load
    want = market.returns().count()
    for name in ("degrees", "closeness", "betweenness", "eigenvector", "katz", "clustering"):
        assert load()[f"connectedness_{name}"].build(market).count() == want, name


# ---------------------------------------------------------------- entropy

def test_posterior_has_the_marginals_and_is_a_tilt(returns):
    member = entropy.members(returns.select(F.lit("p").alias("portfolio"), "idx", "entity"))
    pod = entropy.pods(returns, BW)
    prior = entropy.orthant_prior(returns, member, pod, BW, 5)
    post = entropy.min_xent_posterior(prior, member, pod, 5)
    p = post.filter("idx = 100").orderBy("state").toPandas()["p"].to_numpy()
    q = prior.filter("idx = 100").orderBy("state").toPandas()["p"].to_numpy()
    want = pod.filter("idx = 100").orderBy("entity").toPandas()["pod"].to_numpy()
    bits = (np.arange(32)[:, None] >> np.arange(5)) & 1
    assert abs(q.sum() - 1) < 1e-12 and abs(p.sum() - 1) < 1e-12 and np.allclose(p @ bits, want, atol=1e-9)
    design = np.column_stack([np.ones(32), bits])
    tilt = np.log(p / q)
    assert np.allclose(design @ np.linalg.lstsq(design, tilt, rcond=None)[0], tilt, atol=1e-6)
    joint = entropy.joint_indicators(post, member, pod, 5).filter("idx = 100").first()
    assert abs(joint.jpod - p[31]) < 1e-12 and joint.jpod <= want.min() and 1 <= joint.fsi <= 5


# ---------------------------------------------------------------- series models

@pytest.fixture(scope="module")
def pair(returns, market):
    return returns.join(market.index().select("idx", "r_m"), "idx").cache()


def test_fits_beat_their_start_values(pair):
    d = crosssection.demean(pair, ["r"])
    x = d.filter("entity = 'Brand#1'").orderBy("idx").toPandas()["r0"].to_numpy()
    best = crosssection.gjr_fit(d, "r0", 200).filter("entity = 'Brand#1'").first()
    start = crosssection._gjr_loss(x, np.array([crosssection.GJR_START]))[0]
    again = crosssection._gjr_loss(x, np.array([[best.a, best.g, best.b]]))[0]
    assert best.loss <= start and abs(best.loss - again) < 1e-9 and best.a + best.g / 2 + best.b < 1


def test_gjr_fold_matches_the_loss_recursion(pair):
    d = crosssection.demean(pair, ["r"])
    x = d.filter("entity = 'Brand#1'").orderBy("idx").toPandas()["r0"].to_numpy()
    h = crosssection.gjr_variance(d, "r0", "h").filter("entity = 'Brand#1'").orderBy("idx").toPandas()["h"].to_numpy()
    direct = 0.5 * (np.log(h) + x * x / h).sum() + 0.5 * len(x) * math.log(2 * math.pi)
    assert abs(direct - crosssection._gjr_loss(x, np.array([crosssection.GJR_START]))[0]) < 1e-9


def test_quantile_regression_is_near_the_check_loss_minimum(pair):
    d = crosssection.demean(pair, ["r", "r_m"])
    row = crosssection.quantile_regression(d, "r_m0", ["r0"], 0.05).filter("entity = 'Brand#2'").first()
    p = d.filter("entity = 'Brand#2'").toPandas()
    loss = lambda b0, b1: (lambda e: (np.where(e < 0, 0.95, 0.05) * np.abs(e)).sum())(p.r_m0 - b0 - b1 * p.r0)
    here = loss(row.b0, row.b1)
    assert all(here <= loss(row.b0 + i, row.b1 + j) * 1.02 for i in (-0.02, 0, 0.02) for j in (-0.02, 0, 0.02))


def test_caviar_fit_reduces_the_quantile_loss(pair):
    best = crosssection.caviar_fit(pair, "r", 0.05, 500).filter("entity = 'Brand#1'").first()
    x = pair.filter("entity = 'Brand#1'").orderBy("idx").toPandas()["r"].to_numpy()
    q = np.sort(x)
    pos = len(x) * 0.05 + 0.5
    q = q[int(pos) - 1] + (pos - int(pos)) * (q[int(pos)] - q[int(pos) - 1])
    total = 0.0
    for t, r in enumerate(x):
        q = q if t == 0 else best.b1 + best.b2 * abs(x[t - 1]) + best.b3 * q
        total += (0.05 - (r < q)) * (r - q)
    assert abs(total - best.loss) < 1e-9


def test_kmv_is_a_fixed_point(returns):
    rows = returns.select("entity", "idx", (F.col("cap") / 1e5 + 1).alias("cap"), F.lit(3.0).alias("db"), F.lit(0.02).alias("rf"))
    p = rows.join(default.kmv_assets(rows), ["entity", "idx"]).filter("entity = 'Brand#3'").orderBy("idx").toPandas()
    nd = NormalDist()
    s = math.sqrt(252) * np.diff(np.log(p.va)).std(ddof=1)
    for r in p.itertuples():
        d1 = (math.log(r.va / 3) + 0.02 + s * s / 2) / s
        assert abs(r.cap + r.va * (1 - nd.cdf(d1)) + 3 * math.exp(-0.02) * nd.cdf(d1 - s) - r.va) < 1e-6


@pytest.mark.parametrize("k", [2, 3, 4])
def test_regimes(returns, k):
    params = regime.regime_fit(returns, k, count=150)
    row = params.filter("entity = 'Brand#1'").first()
    p = np.array([[row[f"p{i}{j}"] for j in range(1, k + 1)] for i in range(1, k + 1)])
    assert np.allclose(p.sum(1), 1) and (p[np.array(regime.TRANSITIONS[k]) == 0] == 0).all()
    got = regime.smoothed_probabilities(returns, params, k).filter("entity = 'Brand#1'").orderBy("idx").toPandas()
    assert np.allclose(got[[f"s{i}" for i in range(1, k + 1)]].sum(1), 1, atol=1e-9)
    x = returns.filter("entity = 'Brand#1'").orderBy("idx").toPandas()["r"].to_numpy()
    g, loss = np.full(k, 1 / k), 0.0
    for t, v in enumerate(x):
        w = (p.T @ g) * [math.exp(-0.5 * (v - row[f"m{i}"]) ** 2 / row[f"c{i}"]) / math.sqrt(2 * math.pi * row[f"c{i}"]) for i in range(1, k + 1)]
        g = w / w.sum()
        loss -= math.log(w.sum()) if t else 0.0
        assert np.allclose(got.loc[t, [f"f{i}" for i in range(1, k + 1)]].to_numpy(float), g, atol=1e-9)
    assert abs(loss - row.loss) < 1e-8


def test_mem_fit_likelihood(returns):
    x = liquidity.amihud_input(returns, 1e6)
    best = liquidity.mem_fit(x, "amihud", count=100).filter("entity = 'Brand#1'").first()
    v = x.filter("entity = 'Brand#1'").orderBy("idx").toPandas()["amihud"].to_numpy()
    mu, total = v.mean(), 0.0
    k = 1 / best.gamma
    lam = math.exp(math.lgamma(k) - math.lgamma(2 * k))
    for t in range(len(v)):
        mu = mu if t == 0 else 1 - best.a - best.b + best.a * v[t - 1] + best.b * mu
        total -= math.log(best.gamma) - 2 * math.lgamma(k) + math.lgamma(2 * k) - (v[t] / mu / lam) ** best.gamma - math.log(mu)
    assert abs(total - best.loss) < 1e-6


def test_adf_lags(returns):
    y = returns.filter("entity = 'Brand#1'").orderBy("idx").toPandas()["price"].to_numpy()
    row = bubbles.adf_stat_lags(returns, "price", 4, "BIC").filter("entity = 'Brand#1'").first()
    dy = np.diff(y)
    n = len(dy) - 4
    best = None
    for k in range(5):
        z = np.column_stack([y[4:-1], np.ones(n), *[dy[4 - j:len(dy) - j] for j in range(1, k + 1)]])
        b = np.linalg.lstsq(z, dy[4:], rcond=None)[0]
        e = dy[4:] - z @ b
        ic = math.log(2 * math.pi) + e @ e / n + math.log(n) * z.shape[1] / n
        stat = b[0] / math.sqrt(e @ e / (n - 2) * np.linalg.inv(z.T @ z)[0, 0])
        best = (ic, stat, k) if best is None or ic < best[0] else best
    assert row.lag == best[2] and abs(row.stat - best[1]) < 1e-5


def test_bsadf_with_lags_matches_direct(returns):
    one = returns.filter("entity = 'Brand#1' and idx <= 60")
    y = one.orderBy("idx").toPandas()["price"].to_numpy()
    w = bubbles.minimum_window(60)
    got = keyed(bubbles.bsadf(one, "price", 1, "FIX").collect(), "bsadf", "idx")
    for i in (w + 3, 45, 60):
        stats = []
        for j in range(i - w + 1):
            s = y[j:i]
            d = np.diff(s)
            z = np.column_stack([s[1:-1], np.ones(len(d) - 1), d[:-1]])
            b = np.linalg.lstsq(z, d[1:], rcond=None)[0]
            e = d[1:] - z @ b
            stats.append(b[0] / math.sqrt(e @ e / (len(d) - 1 - 2) * np.linalg.inv(z.T @ z)[0, 0]))
        assert abs(got[(i,)] - max(stats)) < 1e-5


def test_bsadf_with_ten_lags_matches_direct(spark):
    """Lags chosen by AIC on one sample; the shortest windows have 5 rows, too few for more than 2 lags, and some are flat."""
    y, most = np.cumsum(np.random.default_rng(8).normal(size=80)), 10
    y[40:58] = y[40]
    one = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(y)], "entity string, idx long, price double")
    w = bubbles.minimum_window(len(y))
    assert w == 16
    got = keyed(bubbles.bsadf(one, "price", most, "AIC").collect(), "bsadf", "idx")
    assert len(got) == 80 - w + 1
    for i in (w, w + 1, 39, 80):
        stats = []
        for j in range(i - w + 1):
            d, level, tries = np.diff(y[j:i]), y[j:i][most:-1], []
            m = len(level)
            for k in range(min(most, m - 3) + 1):
                z = np.column_stack([level, np.ones(m), *[d[most - p:len(d) - p] for p in range(1, k + 1)]])
                b = np.linalg.lstsq(z, d[most:], rcond=None)[0]
                e = d[most:] - z @ b
                tries.append((math.log(2 * math.pi) + e @ e / m + 2 * (k + 2) / m, b[0] / math.sqrt(e @ e / (m - 2) * np.linalg.inv(z.T @ z)[0, 0])))
            stats.append(min(tries)[1])
        assert abs(got[(i,)] - max(stats)) < 1e-5


def test_self_normalised_interval_over_sixty_lags(pair):
    """A lag as long as the first sample of 12 rows has a quantilogram and, as in the reference, no half-width."""
    rows = quantilogram.ci_self_normalised(pair, 0.1, 60).collect()
    entities = {r.entity for r in rows}
    assert len(rows) == len(entities) * 60 * 2
    assert all((r.half_width is None) == (r.lag >= 12) and r.cq is not None for r in rows)
    x = pair.filter("entity = 'Brand#2'").orderBy("idx").toPandas()[["r", "r_m"]].to_numpy()
    at = {(r.direction, r.lag): r for r in rows if r.entity == "Brand#2"}
    for name, order in (("from_market", [0, 1]), ("to_market", [1, 0])):
        for k in (4, 11, 12, 60):
            path = []
            for i in range(12, 121):
                h = (x[:i, order] <= np.quantile(x[:i, order], 0.1, axis=0)) - 0.1
                u, v = h[k:, 0], h[:max(i - k, 0), 1]
                path.append(u @ v / math.sqrt((u @ u) * (v @ v)) if len(u) else math.nan)
            path = np.array(path)
            assert abs(at[name, k].cq - path[-1]) < 1e-9
            if k < 12:
                assert abs(at[name, k].half_width - math.sqrt(48.55132 * (((path - path[-1]) * np.arange(12, 121)) ** 2).sum() / 120 ** 3)) < 1e-9


def test_registered_over_the_whole_job(market, monkeypatch):
    """The queries ask for what the operators' siblings and the reference use."""
    seen = {}

    def spy(module, name):
        whole = inspect.signature(getattr(module, name))

        def call(*args, **kwargs):
            bound = whole.bind(*args, **kwargs)
            bound.apply_defaults()
            seen[name] = bound.arguments
            raise InterruptedError

        monkeypatch.setattr(module, name, call)

    spy(bubbles, "bsadf")
    spy(quantilogram, "ci_self_normalised")
    spy(crosssection, "caviar_fit")
    for query in ("bsadf_lags", "quantilogram_self_normalised_lags", "caviar_fitted_path"):
        with pytest.raises(InterruptedError):
            load()[query].build(market)
    assert seen["bsadf"]["lag_max"] == 10 and seen["ci_self_normalised"]["lags"] == 60 and seen["caviar_fit"]["count"] == 10_000


def test_partial_quantilogram_without_controls_is_the_plain_one(pair):
    plain = quantilogram.cross_quantilogram(quantilogram.paired_hits(pair.drop("r_m"), pair.filter("entity = 'Brand#1'").select("idx", "r_m"), 0.1), 3)
    part = quantilogram.partial_cross_quantilogram(pair, [], 0.1, 3)
    a, b = (keyed(d.collect(), "from_market", "entity", "lag") for d in (plain, part))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_catfin_has_a_row_for_every_date(returns):
    rp = transforms.equal_weight_portfolio(returns)
    p = component.catfin(rp, 52, 0.05).toPandas().set_index("idx").sort_index()
    cols = ["var_np", "var_gpd", "var_gev"]
    whole = p[cols].notna().all(axis=1)
    assert list(p.index) == list(range(1, 121)) and 0 < (~whole).sum() < 60 and (p.catfin.notna() == whole).all()
    assert p.var_np.notna().all()
    x = p.loc[whole, cols].to_numpy()
    first = np.linalg.eigh(np.cov(x.T))[1][:, -1]
    first = first * np.sign(first[np.abs(first).argmax()])
    assert np.allclose(p.catfin[whole], (x - x.mean(0)) @ first, atol=1e-9)


# ---------------------------------------------------------------- joint risk, spillovers, tails

def test_joint_var_is_a_root(returns):
    x = returns.withColumn("loss", -F.col("r"))
    margins, dep = default.mgev_margins(x, "loss", BW).cache(), default.mgev_dependence(x, "loss", BW).cache()
    got = keyed(default.joint_var(margins, dep, 0.90).filter("idx = 90").collect(), "jvar", "level")
    d = dep.filter("idx = 90").first().d
    m = margins.filter("idx = 90").toPandas()
    for (q,), v in got.items():
        if v > 0:
            u = 1 + m.xi * (v - m.mu) / m.sigma
            s = np.where(u > 0, np.abs(u) ** (-1 / m.xi), np.where(m.xi > 0, np.inf, 0.0)).sum()
            assert abs(s + math.log(q) / d) < 1e-6
    assert 1 / 5 <= d <= 1


def test_factor_loadings_reproduce_the_correlation_roughly(returns, matrix):
    p = default.factor_loadings(returns, BW, 2).filter("idx = 80").toPandas().pivot(index="entity", columns="factor", values="loading")
    b = p.loc[list(matrix.columns)].to_numpy()
    rho = np.corrcoef(matrix.to_numpy()[50:80], rowvar=False)
    d, v = np.linalg.eigh(rho - np.diag(1 - (b * b).sum(1)))
    again = v[:, ::-1][:, :2] * np.sqrt(d[::-1][:2])
    assert np.abs(np.abs(again) - np.abs(b)).max() < 0.15


def test_variance_decomposition(returns, matrix):
    p = spillover.variance_decomposition(returns, BW, lags=1, h=3).filter("idx = 100").toPandas()
    v = p.pivot(index="src", columns="dst", values="value").loc[list(matrix.columns), list(matrix.columns)].to_numpy()
    x = matrix.to_numpy()[70:100]
    z = np.column_stack([np.ones(29), x[:-1]])
    b = np.linalg.lstsq(z, x[1:], rcond=None)[0]
    e = x[1:] - z @ b
    c, a = e.T @ e / 29, b[1:].T
    total = sum((np.linalg.matrix_power(a, s) @ c / np.sqrt(np.diag(c))) ** 2 for s in range(3))
    assert np.allclose(v, total / total.sum(1, keepdims=True), atol=1e-9) and np.allclose(v.sum(1), 1)


def test_short_windows_of_a_decomposition_have_null_rows(spark, returns):
    """Five series and two lags need 18 rows: the first windows have none of that and still give every pair."""
    p = spillover.variance_decomposition(returns, BW, lags=2, h=3).cache()
    rows = p.toPandas()
    assert (rows.groupby("idx").size() == 25).all() and sorted(rows.idx.unique()) == list(range(1, 121))
    defined = rows.groupby("idx").value.count()
    assert (defined.loc[:17] == 0).all() and (defined.loc[18:] == 25).all()
    assert p.filter("isnan(value)").count() == 0
    gone = {r.idx: r for r in spillover.spillover_index(p).collect()}
    assert len(gone) == 120 and gone[17].si is None and 0 < gone[18].si < 1
    each = spillover.spillovers(p).toPandas()
    assert len(each) == 600 and each[each.idx <= 17][["sf", "st", "sn"]].isna().all().all() and each[each.idx > 17].notna().all().all()


def test_decomposition_of_too_many_series_raises(spark):
    rnd = np.random.default_rng(3)
    panel = lambda n: spark.createDataFrame([(f"s{k:02d}", t, float(rnd.normal())) for k in range(n) for t in range(1, 57)], "entity string, idx long, r double")
    assert spillover.most_series(52, 2) == 16
    with pytest.raises(ValueError, match="17 series"):
        spillover.variance_decomposition(panel(17), 52)
    at = spillover.variance_decomposition(panel(16), 52).filter("idx = 56")
    assert at.filter("value is not null").count() == 256


def test_series_with_gaps_in_a_decomposition_have_null_rows(returns):
    less = returns.filter("not (entity = 'Brand#5' and idx = 90)")
    rows = spillover.variance_decomposition(less, BW, lags=1, h=3).filter("idx = 100").toPandas()
    assert len(rows) == 25 and rows.value.count() == 16 and rows[(rows.src == "Brand#5") | (rows.dst == "Brand#5")].value.isna().all()


def test_filled_decomposition_rows_sum_to_one(returns):
    vd = spillover.variance_decomposition(returns, BW, lags=1, h=3, step=10)
    filled = spillover.fill_decomposition(vd, returns.select("idx"))
    sums = filled.groupBy("idx", "src").agg(F.sum("value").alias("s")).toPandas()
    assert len(sums) == 600 and np.allclose(sums.s, 1)


def test_tail_dependence_of_comonotone_and_independent_pairs(spark):
    h = halton(200, [0.0, 0.0], [1.0, 1.0])
    rows = [(n, i + 1, float(v)) for i in range(200) for n, v in (("a", h[i, 0]), ("b", 2 * h[i, 0]), ("c", h[i, 1]))]
    df = spark.createDataFrame(rows, "entity string, idx long, r double")
    got = {(r.src, r.dst): r for r in tail.chi_pairs(df, 200, 0.1, 0.5).filter("idx = 200").collect()}
    assert abs(got["a", "b"].chi_bar - 0.82) < 0.01 and abs(got["a", "b"].chi - 0.95) < 0.01 and got["a", "c"].chi == 0


# ---------------------------------------------------------------- comparison

@pytest.fixture(scope="module")
def wide(market):
    from riskpanel.plans.describe import _MEASURES, measures
    return compare.standardise(measures(market), list(_MEASURES)).cache(), list(_MEASURES)


def ols_sse(y, z):
    e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    return float(e @ e)


def test_granger(wide):
    df, cols = wide
    row = compare.granger_ftest(compare.pair_rows(df, cols[:2]), 0.05, 4, "BIC").first()
    p = df.orderBy("idx").toPandas()
    x, y = p[cols[0]].to_numpy(), p[cols[1]].to_numpy()
    t = len(x)
    k = t - 4
    lag = lambda v, m: [v[4 - j:t - j] for j in range(1, m + 1)]
    r = [ols_sse(x[4:], np.column_stack([np.ones(k), *lag(x, m)])) for m in range(1, 5)]
    lr = int(np.argmin([k * math.log(s / k) + math.log(k) * (m + 1) for m, s in enumerate(r, 1)])) + 1
    u = [ols_sse(x[4:], np.column_stack([np.ones(k), *lag(x, lr), *lag(y, m)])) for m in range(1, 5)]
    lu = int(np.argmin([k * math.log(s / k) + math.log(k) * (m + lr + 1) for m, s in enumerate(u, 1)])) + 1
    stat = max((r[lr - 1] - u[lu - 1]) / lu, 0) / (u[lu - 1] / (k - lr + lu + 1))
    assert (row.lag_r, row.lag_u) == (lr, lu) and abs(row.stat - stat) < 1e-9


def test_logit_gradient_is_zero_at_the_optimum(wide, market):
    df, cols = wide
    from riskpanel.sources import panels
    dummy = panels.crisis_ranges(df.select("date"), market.crises()).select("date", F.col("any_crisis").alias("crisis"))
    both = df.join(dummy, "date")
    r2 = keyed(compare.logit_mcfadden(both, cols, "crisis").collect(), "r2", "label")
    pps = keyed(compare.predictive_power(both, cols, "crisis").collect(), "pps", "label")
    p = both.toPandas()
    x, y = np.column_stack([np.ones(len(p)), p[cols[0]]]), p.crisis.to_numpy(float)
    b = np.zeros(2)
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]), x.T @ (y - q))
    q, m = 1 / (1 + np.exp(-x @ b)), y.mean()
    ll, ll0 = (y * np.log(q) + (1 - y) * np.log(1 - q)).sum(), len(y) * (m * math.log(m) + (1 - m) * math.log(1 - m))
    assert abs(r2[(cols[0],)] - (1 - ll / ll0)) < 1e-9 and all(0 <= v <= 1 for v in pps.values())


def test_predictive_power_of_a_step(spark):
    rows = [(i, float(i % 40), float(i % 40 > 15), float((i * 7919) % 101)) for i in range(400)]
    wide = spark.createDataFrame(rows, "idx long, step double, crisis double, noise double")
    got = keyed(compare.predictive_power(wide, ["step", "noise"], "crisis").collect(), "pps", "label")
    assert got[("step",)] > 0.95 and got[("noise",)] < 0.3


def test_fixed_points_that_do_not_settle_are_null(spark):
    rnd = np.random.default_rng(4)
    rows = [("a", i, float(c), 50.0, 0.02) for i, c in enumerate(100 * np.exp(np.cumsum(rnd.normal(0, 0.02, 60))))]
    df = spark.createDataFrame(rows, "entity string, idx long, cap double, db double, rf double")
    done, cut = (default.kmv_assets(df, rounds=n).collect() for n in (10_000, 1))
    assert len(done) == len(cut) == 60 and all(r.va > 100 for r in done)
    assert all(v is None for r in cut for v in (r.va, r.va_s, r.va_g, r.va_k))
    base = rnd.normal(size=(80, 1))
    panel = [(f"e{j}", i, float(v)) for i, line in enumerate(base + rnd.normal(size=(80, 5)) * 0.3, 1) for j, v in enumerate(line)]
    returns = spark.createDataFrame(panel, "entity string, idx long, r double")
    settled, stopped = (default.factor_loadings(returns, 60, 1, rounds=n).collect() for n in (100, 1))
    assert len(settled) == len(stopped) and all(r.loading is not None for r in settled) and all(r.loading is None for r in stopped)


def test_logit_of_odd_labels(spark):
    """One class only, classes that x separates, x without spread, nulls, and a far outlier that makes plain steps overshoot."""
    rnd = np.random.default_rng(5)
    rows = [(i, float(i % 2), float(i % 2), 1.0, None if i % 3 else float(i % 7), 1e4 if i == 0 else float(rnd.normal())) for i in range(200)]
    wide = spark.createDataFrame(rows, "idx long, crisis double, same double, flat double, gaps double, far double")
    cols = ["same", "flat", "gaps", "far"]
    got = keyed(compare.logit_mcfadden(wide, cols, "crisis").collect(), "r2", "label")
    assert got[("same",)] > 0.999999 and abs(got[("flat",)]) < 1e-9 and 0 <= got[("gaps",)] < 0.1 and 0 <= got[("far",)] < 1
    none = keyed(compare.logit_mcfadden(wide.withColumn("crisis", F.lit(0.0)), cols, "crisis").collect(), "r2", "label")
    assert list(none.values()) == [None] * 4
    assert compare.logit_mcfadden(wide.limit(0), cols, "crisis").count() == 0


def brute_tree(bins, y, depth, least):
    """Predictions of a greedy regression tree by trying each cut on the rows themselves."""
    out = np.full(len(y), y.mean())
    best, cut = 1e-12, None
    for c in sorted(set(bins))[:-1]:
        low = bins <= c
        if depth and min(low.sum(), (~low).sum()) >= least:
            gain = ((y - y.mean()) ** 2).sum() - ((y[low] - y[low].mean()) ** 2).sum() - ((y[~low] - y[~low].mean()) ** 2).sum()
            if gain > best + 1e-9:
                best, cut = gain, c
    if cut is not None:
        for side in (bins <= cut, bins > cut):
            out[side] = brute_tree(bins[side], y[side], depth - 1, least)
    return out


def test_tree_from_sums_by_brute_force():
    rnd = np.random.default_rng(6)
    for depth in (1, 3, 8):
        bins = rnd.integers(0, 40, 500)
        y = np.sin(bins / 6.0) + rnd.normal(size=500)
        n, s = np.bincount(bins, minlength=40).astype(float), np.bincount(bins, weights=y, minlength=40)
        assert np.allclose(compare.tree_leaves(n, s, depth, 5)[bins], brute_tree(bins, y, depth, 5))


def test_predictive_power_reads_sums_only(spark):
    rows = [(i, float(i % 97), float(i % 2)) for i in range(3000)]
    wide = spark.createDataFrame(rows, "idx long, a double, crisis double").withColumn("fold", F.col("idx") % 4)
    sums = compare.bin_sums(compare._stacked(wide, ["a"], "crisis", "fold"), 16)
    assert sums.count() <= 4 * 16 and sums.agg(F.sum("n"), F.sum("s")).first()[:] == (3000, 1500.0)
    assert compare.predictive_power(wide.limit(0), ["a"], "crisis").count() == 0


def test_price_discovery_shares(wide):
    df, cols = wide
    for kind in ("GG", "H"):
        rows = compare.price_discovery(compare.pair_rows(df, cols), kind, 5).collect()
        assert len(rows) == 10 and all(0 <= r.m1 <= 1 and abs(r.m1 + r.m2 - 1) < 1e-12 for r in rows)


def test_tournament_and_overall(spark):
    v = spark.createDataFrame([("a", 0.1), ("b", 0.1 + 1e-16), ("c", 0.5), ("d", 0.3)], "label string, v double")
    s = keyed(compare.tournament(v, "v").collect(), "score", "label")
    assert s[("c",)] == 100.0 and s[("a",)] == s[("b",)] == 0.0 and abs(s[("d",)] - 60.0) < 1e-9
    o = keyed(compare.overall_score([(compare.tournament(v, "v"), 1.0), (compare.tournament(v, "v"), 3.0)]).collect(), "score", "label")
    assert o == s


# ---------------------------------------------------------------- sources and transforms

def test_wide_csv_source_and_sink(spark, tmp_path):
    from riskpanel.sources import panels, results
    (tmp_path / "w.csv").write_text("Date,A,B\n2020-01-01,1.5,\n2020-01-02,2.5,NaN\n")
    long = panels.read_wide(spark, str(tmp_path / "w.csv"), "csv", schema="Date date, A double, B double", header=True)
    assert sorted((str(r.date), r.entity, r.value) for r in long.filter("value is not null").collect()) == [("2020-01-01", "A", 1.5), ("2020-01-02", "A", 2.5)]
    ind = results.indicators(long.groupBy("date").agg(F.sum("value").alias("total")), "S1", "Demo", ["total"])
    results.write_indicators(ind, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).filter("category = 'Demo'")
    assert back.count() == 2 and "category=Demo" in os_listing(tmp_path / "out")


def os_listing(path):
    return [p.name for p in path.iterdir()]


def test_schema_differences(spark):
    from riskpanel.operators.quality import schema_differences
    from pyspark.sql.types import StructType
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert schema_differences(df, StructType.fromDDL("a bigint, c double")) == ["extra b string", "missing c double", "type a int not bigint"]


def test_ramp(spark):
    ramp = spark.createDataFrame([("e", i, float(i)) for i in range(1, 31)], "entity string, idx long, x double")
    s = keyed(transforms.smooth(ramp, "x", 21).collect(), "smoothed", "idx")
    assert all(abs(s[(i,)] - i) < 1e-12 for i in range(1, 31))
    e = keyed(transforms.ewma(ramp, "x", 9).collect(), "ewma", "idx")
    assert e[(1,)] == 1.0 and abs(e[(2,)] - 1.2) < 1e-12
    assert transforms.explode_windows(ramp, "x", 10).groupBy("idx").count().filter("idx = 30").first()["count"] == 10
    with pytest.raises(ValueError):
        transforms.select_series(ramp, ["y"])


def test_forward_roll_blocks(spark):
    import datetime
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(130)]
    df = spark.createDataFrame([("e", d, i + 1, float(i)) for i, d in enumerate(days)], "entity string, date date, idx long, x double")
    three = transforms.forward_roll(df, "x", 3).select("rolled").distinct().count()
    assert three == 2 and transforms.forward_roll(df, "x", 0).filter("rolled = x").count() == 130
    assert transforms.forward_roll(df, "x", 1).select("rolled").distinct().count() == 5


# ---------------------------------------------------------------- distance correlation

def test_distance_correlation_equals_all_distances(spark):
    rng = np.random.default_rng(3)
    cases = {"line": (np.arange(40.0), 2 * np.arange(40.0)), "ties": (rng.integers(0, 4, 301) * 1.0, rng.integers(0, 3, 301) * 1.0),
             "free": (rng.normal(size=257), rng.normal(size=257)), "curve": (x := rng.normal(size=200), x * x + 100), "one": (np.ones(1), np.ones(1)),
             "flat": (np.ones(30), rng.normal(size=30))}
    rows = [(name, "y", i, float(a), float(b)) for name, (x, y) in cases.items() for i, (a, b) in enumerate(zip(x, y))]
    got = keyed(compare.distance_correlation(spark.createDataFrame(rows, "left string, right string, idx int, x double, y double")).collect(), "dcor", "left")
    for name, (x, y) in cases.items():
        a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
        a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
        size = np.sqrt(np.sqrt((a * a).mean()) * np.sqrt((b * b).mean()))
        assert abs(got[(name,)] - (np.sqrt(max((a * b).mean(), 0)) / size if size > 0 else 0.0)) < 1e-7, name


def test_distance_correlation_of_long_series():
    x = np.sort(np.random.default_rng(4).normal(size=100_000))
    y = np.random.default_rng(5).normal(size=100_000)
    part = np.abs(np.subtract.outer(x[:300], x[:300])), np.abs(np.subtract.outer(y[:300], y[:300]))
    assert abs(2 * (2 * compare._concordant(x[:300], y[:300]) - (300 * (x[:300] * y[:300]).sum() - x[:300].sum() * y[:300].sum())) - (part[0] * part[1]).sum()) < 1e-6
    assert np.isfinite(compare._concordant(x, y))
