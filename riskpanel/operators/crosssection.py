"""Cross-sectional risk measures of entities against the market index.

Recursions with given parameters run as JVM folds over each packed series; parameter fits scan candidates.
Rows carry entity, idx, r (entity return) and r_m (index return).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.order import quantile_hf5, quantile_hf5_array
from riskpanel.functions.scalar import norm_cdf, norm_pdf
from riskpanel.operators.ranks import positions
from riskpanel.operators.series import candidate_scan, halton, per_series
from riskpanel.operators.transforms import fold_series
from riskpanel.session import cut_lineage

# Start values of the volatility recursions (arch, asymmetry, garch) and of the correlation (a, b).
GJR_START = (0.05, 0.10, 0.75)
DCC_START = (0.01, 0.97)


def demean(df: DataFrame, cols: list[str]) -> DataFrame:
    w = Window.partitionBy("entity")
    return df.withColumns({f"{c}0": F.col(c) - F.avg(c).over(w) for c in cols})


def gjr_variance(df: DataFrame, value: str, name: str, params: DataFrame | tuple = GJR_START) -> DataFrame:
    """Conditional variance h = (1 - a - g/2 - b) s2 + a e^2 + g e^2 1(e < 0) + b h_prev of a demeaned series.

    The recursion starts from the population deviation s as the return before the first row, with h = s^2;
    s2 is the sample variance including that row. `params` is (a, g, b) or a frame (entity, a, g, b).
    """
    w = Window.partitionBy("entity")
    s = F.stddev_pop(value).over(w)
    n = F.count(value).over(w)
    total, squares = F.sum(value).over(w) + s, F.sum(F.col(value) * F.col(value)).over(w) + s * s
    s2 = (squares - total * total / (n + 1)) / n
    base = df.withColumns({"_s": s, "_s2": s2})
    if isinstance(params, tuple):
        base = base.withColumns({k: F.lit(float(v)) for k, v in zip(("a", "g", "b"), params)})
    else:
        base = base.join(params.select("entity", "a", "g", "b"), "entity")
    start = lambda rows: F.struct(rows[0]["_s"].alias("e"), (rows[0]["_s"] * rows[0]["_s"]).alias("h"),
                                  F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        e2 = acc["e"] * acc["e"]
        h = ((1.0 - x["a"] - 0.5 * x["g"] - x["b"]) * x["_s2"] + x["a"] * e2
             + x["g"] * F.when(acc["e"] < 0, e2).otherwise(0.0) + x["b"] * acc["h"])
        return F.struct(x[value].alias("e"), h.alias("h"), F.concat(acc["out"], F.array(h)).alias("out"))

    return fold_series(base, [value, "_s", "_s2", "a", "g", "b"], start, step, name)


def _gjr_loss(x: np.ndarray, cand: np.ndarray) -> np.ndarray:
    a, g, b = cand.T
    s = x.std()
    s2 = np.append(x, s).var(ddof=1)
    omega = (1 - a - 0.5 * g - b) * s2
    h, e = np.full(len(cand), s * s), s
    loss = np.zeros(len(cand))
    for v in x:
        h = omega + (a + g * (e < 0)) * e * e + b * h
        loss += np.log(h) + v * v / h
        e = v
    return 0.5 * (loss + len(x) * math.log(2 * math.pi))


def _box(centre, lo, hi, shrink=0.15):
    if centre is None:
        return lo, hi
    width = [(h - l) * shrink for l, h in zip(lo, hi)]
    return [max(l, c - w) for l, c, w in zip(lo, centre, width)], [min(h, c + w) for h, c, w in zip(hi, centre, width)]


def gjr_fit(df: DataFrame, value: str, count: int = 500) -> DataFrame:
    """(entity, a, g, b, loss): candidate with the least Gaussian likelihood loss under a + g/2 + b < 1."""

    def propose(rows, centre):
        c = halton(count, *_box(centre, [1e-6, 1e-6, 1e-6], [0.4, 0.5, 0.999]))
        c = np.vstack([GJR_START, c])
        return c[c[:, 0] + 0.5 * c[:, 1] + c[:, 2] < 1 - 2e-6]

    return candidate_scan(df, [value], ["a", "g", "b"], propose, lambda rows, c: _gjr_loss(rows[value].to_numpy(float), c))


def dcc_corr(df: DataFrame, params: DataFrame | tuple = DCC_START) -> DataFrame:
    """Dynamic correlation of standardised residuals (em, ef): Q = (1 - a - b) Qbar + a e e' + b Q_prev.

    Starts from Q = Qbar and residuals of one. Returns (entity, idx, rho).
    """
    w = Window.partitionBy("entity")
    base = df.withColumns({"_11": F.var_samp("em").over(w), "_12": F.covar_samp("em", "ef").over(w), "_22": F.var_samp("ef").over(w)})
    if isinstance(params, tuple):
        base = base.withColumns({"a": F.lit(float(params[0])), "b": F.lit(float(params[1]))})
    else:
        base = base.join(params.select("entity", "a", "b"), "entity")
    start = lambda rows: F.struct(F.lit(1.0).alias("m"), F.lit(1.0).alias("f"), rows[0]["_11"].alias("q11"), rows[0]["_12"].alias("q12"),
                                  rows[0]["_22"].alias("q22"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        o = 1.0 - x["a"] - x["b"]
        q11 = o * x["_11"] + x["a"] * acc["m"] * acc["m"] + x["b"] * acc["q11"]
        q12 = o * x["_12"] + x["a"] * acc["m"] * acc["f"] + x["b"] * acc["q12"]
        q22 = o * x["_22"] + x["a"] * acc["f"] * acc["f"] + x["b"] * acc["q22"]
        return F.struct(x["em"].alias("m"), x["ef"].alias("f"), q11.alias("q11"), q12.alias("q12"), q22.alias("q22"),
                        F.concat(acc["out"], F.array(q12 / F.sqrt(q11 * q22))).alias("out"))

    return fold_series(base, ["em", "ef", "_11", "_12", "_22", "a", "b"], start, step, "rho")


def dcc_fit(df: DataFrame, count: int = 300) -> DataFrame:
    """(entity, a, b, loss) by the correlation likelihood under a + b < 1; residuals before the sample are zero."""

    def propose(rows, centre):
        c = np.vstack([DCC_START, halton(count, *_box(centre, [1e-6, 1e-6], [0.3, 0.999]))])
        return c[c.sum(1) < 1 - 2e-6]

    def loss(rows, cand):
        e = rows[["em", "ef"]].to_numpy(float)
        bar = np.cov(e, rowvar=False)
        a, b = cand.T
        q = [np.full(len(cand), bar[i, j]) for i, j in ((0, 0), (0, 1), (1, 1))]
        base = [(1 - a - b) * bar[i, j] for i, j in ((0, 0), (0, 1), (1, 1))]
        m = f = 0.0
        total = np.zeros(len(cand))
        for x, y in e:
            q = [o + a * v + b * p for o, v, p in zip(base, (m * m, m * f, f * f), q)]
            rho = q[1] / np.sqrt(q[0] * q[2])
            d = 1 - rho * rho
            total += np.log(d) + (x * x - 2 * rho * x * y + y * y) / d
            m, f = x, y
        return 0.5 * total

    return candidate_scan(df, ["em", "ef"], ["a", "b"], propose, loss)


def dynamic_moments(df: DataFrame, fitted: bool = False) -> DataFrame:
    """Add rm0, r0 (demeaned), sm, sf (volatilities) and rho, with given or scanned parameters.

    The stages branch and meet again, so each is written once instead of recomputed from the raw tables.
    """
    base = cut_lineage(demean(df, ["r", "r_m"]))
    keys = ["entity", "idx"]
    hm = gjr_variance(base, "r_m0", "hm", gjr_fit(base, "r_m0") if fitted else GJR_START)
    hf = gjr_variance(base, "r0", "hf", gjr_fit(base, "r0") if fitted else GJR_START)
    out = base.join(hm, keys).join(hf, keys).withColumns({"sm": F.sqrt("hm"), "sf": F.sqrt("hf")}).drop("hm", "hf")
    e = cut_lineage(out).withColumns({"em": F.col("r_m0") / F.col("sm"), "ef": F.col("r0") / F.col("sf")})
    rho = dcc_corr(e, dcc_fit(e) if fitted else DCC_START)
    return cut_lineage(e.join(rho, keys).drop("em", "ef"))


def add_beta(df: DataFrame) -> DataFrame:
    return df.withColumn("beta", F.col("rho") * F.col("sf") / F.col("sm"))


def add_var_es(df: DataFrame, a: float = 0.05) -> DataFrame:
    """Value at risk and expected shortfall from the quantile of standardised returns, as positive losses."""
    c = df.groupBy("entity").agg(F.array_sort(F.collect_list(F.col("r0") / F.col("sf"))).alias("z")).select(
        "entity", quantile_hf5_array(F.col("z"), a).alias("c"))
    out = df.join(c, "entity")
    es = F.col("sf") * -(norm_pdf(F.col("c")) / a)
    return out.withColumns({"var": -F.least(F.col("sf") * F.col("c"), F.lit(0.0)), "es": -F.least(es, F.lit(0.0))}).drop("c")


def quantile_regression(df: DataFrame, y: str, x: list[str], a: float) -> DataFrame:
    """(entity, b0, b1, ...): iteratively reweighted least squares with check-loss weights.

    Residuals are floored at 1e-6 in size; stops when no coefficient moves by more than 1e-6, or after 1000 rounds.
    """
    names = ["b0", *[f"b{i + 1}" for i in range(len(x))]]

    def fn(entity, rows):
        target = rows[y].to_numpy(float)
        m = np.column_stack([np.ones(len(rows)), rows[x].to_numpy(float)])
        weighted, b, moved, i = m, np.ones(m.shape[1]), 1.0, 0
        while moved > 1e-6 and i < 1000:
            last, b = b, np.linalg.solve(weighted.T @ m, weighted.T @ target)
            e = target - m @ b
            e = np.where(np.abs(e) < 1e-6, 1e-6, e)
            weighted = m / np.abs(np.where(e < 0, a, 1 - a) * e)[:, None]
            moved, i = np.abs(b - last).max(), i + 1
        return {k: [v] for k, v in zip(names, b)}

    return per_series(df, [y, *x], fn, ", ".join(f"{n} double" for n in names))


def add_covar(df: DataFrame, a: float = 0.05, states: list[str] | None = None) -> DataFrame:
    """CoVaR and its delta: market quantile given the entity's VaR, less the one given its median.

    With state variables the regression and the forecast use their values one row earlier.
    """
    states = states or []
    lagged = [f"_{s}" for s in states]
    w = Window.partitionBy("entity")
    base = df.withColumns({f"_{s}": F.lag(s).over(w.orderBy("idx")) for s in states})
    rows = base.filter("idx > 1") if states else base
    b = quantile_regression(rows, "r_m0", ["r0", *lagged], a)
    med = df.groupBy("entity").agg(F.percentile("r0", F.lit(0.5)).alias("_med"))
    out = base.join(b, "entity").join(med, "entity")
    covar = F.col("b0") - F.col("b1") * F.col("var")
    for i, s in enumerate(lagged):
        covar = covar + F.col(f"b{i + 2}") * F.col(s)
    out = out.withColumn("covar", covar)
    if states:
        second = F.max(F.when(F.col("idx") == 2, F.col("covar"))).over(w)
        out = out.withColumn("covar", F.coalesce("covar", second))
    delta = F.col("b1") * (-F.col("var") - F.col("_med"))
    return out.withColumns({"covar": -F.least("covar", F.lit(0.0)), "dcovar": -F.least(delta, F.lit(0.0))}).drop(
        "_med", *lagged, *[f"b{i}" for i in range(len(states) + 2)])


def add_mes(df: DataFrame, a: float = 0.05, d: float = 0.4) -> DataFrame:
    """Marginal expected shortfall with kernel-smoothed tail weights, and its long-run version.

    The weights are the same vector for every date, so the two tail means are one pair of numbers per entity.
    """
    x = df.withColumns({"_u": F.col("r_m0") / F.col("sm"), "_z": F.sqrt(1.0 - F.col("rho") * F.col("rho"))})
    x = x.withColumn("_x", (F.col("r0") / F.col("sf") - F.col("rho") * F.col("_u")) / F.col("_z"))
    s = x.groupBy("entity").agg(
        quantile_hf5("r_m0", a).alias("_c"), F.stddev_samp("_u").alias("_sd"), quantile_hf5("_u", 0.75).alias("_q3"),
        quantile_hf5("_u", 0.25).alias("_q1"), F.count("_u").alias("_t"))
    width = F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.349) * F.pow(4.0 / (3.0 * F.col("_t")), F.lit(0.2))
    x = x.join(s.select("entity", "_c", width.alias("_h")), "entity")
    x = x.withColumn("_f", norm_cdf((F.col("_c") / F.col("sm") - F.col("_u")) / F.col("_h")))
    w = Window.partitionBy("entity")
    k1 = F.sum(F.col("_u") * F.col("_f")).over(w) / F.sum("_f").over(w)
    k2 = F.sum(F.col("_x") * F.col("_f")).over(w) / F.sum("_f").over(w)
    mes = F.col("sf") * F.col("rho") * k1 + F.col("sf") * F.col("_z") * k2
    out = x.withColumn("mes", -F.least(mes, F.lit(0.0))) if "beta" in x.columns else add_beta(x).withColumn("mes", -F.least(mes, F.lit(0.0)))
    return out.withColumn("lrmes", 1.0 - F.exp(math.log(1.0 - d) * F.col("beta"))).drop("_u", "_z", "_x", "_c", "_h", "_f")


def add_ses(df: DataFrame, car: float = 0.08, lb: str = "lb", cp: str = "cap") -> DataFrame:
    w = Window.partitionBy("entity").orderBy("idx")

    def growth(c):
        prev = F.lag(c).over(w)
        return F.coalesce((F.col(c) - prev) / prev, F.when(F.col("idx") == 1, 0.0))

    gross = car * F.col(lb) * (1.0 + growth(lb)) - (1.0 - car) * F.col(cp) * (1.0 + growth(cp))
    return df.withColumn("ses", F.when(gross < 0, 0.0).otherwise(gross))


def add_srisk(df: DataFrame, car: float = 0.08, lb: str = "lbr", cp: str = "cap") -> DataFrame:
    gross = car * F.col(lb) - (1.0 - car) * (1.0 - F.col("lrmes")) * F.col(cp)
    return df.withColumn("srisk", F.when(gross < 0, 0.0).otherwise(gross))


# ---------------------------------------------------------------- conditional autoregressive value at risk

def caviar_start(df: DataFrame, value: str, a: float, name: str) -> DataFrame:
    """First quantile: order statistic round(100 a) of the first 100 rows, or the whole-series quantile when short."""
    s = df.groupBy("entity").agg(
        F.count(value).alias("t"), F.array_sort(F.collect_list(F.when(F.col("idx") <= 100, F.col(value)))).alias("head"),
        F.array_sort(F.collect_list(value)).alias("all"))
    order = max(int(math.floor(100 * a + 0.5)), 1)
    return s.select("entity", F.when(F.col("t") >= 200, F.element_at("head", order)).otherwise(quantile_hf5_array(F.col("all"), a)).alias(name))


def caviar_path(df: DataFrame, params: DataFrame | tuple, a: float = 0.05) -> DataFrame:
    """Quantiles (q_m, q_f) of index and entity from a bivariate recursion on absolute returns.

    params: ten numbers, column-major 2 x 5 (intercepts, loadings on |r_m|, |r|, on lagged q_m, q_f), as a tuple
    or a frame (entity, p1..p10).
    """
    q = caviar_start(df, "r_m", a, "_qm").join(caviar_start(df, "r", a, "_qf"), "entity")
    base = df.join(q, "entity")
    names = [f"p{i}" for i in range(1, 11)]
    if isinstance(params, tuple):
        base = base.withColumns({n: F.lit(float(v)) for n, v in zip(names, params)})
    else:
        base = base.join(params.select("entity", *names), "entity")
    none = F.lit(None).cast("double")
    zero = F.struct(none.alias("m"), none.alias("f"), none.alias("qm"), none.alias("qf"),
                    F.array().cast("array<struct<q_m:double,q_f:double>>").alias("out"))

    def step(acc, x):
        q = [F.coalesce(x[f"p{i}"] + x[f"p{i + 2}"] * F.abs(acc["m"]) + x[f"p{i + 4}"] * F.abs(acc["f"])
                        + x[f"p{i + 6}"] * acc["qm"] + x[f"p{i + 8}"] * acc["qf"], x[s]) for i, s in ((1, "_qm"), (2, "_qf"))]
        return F.struct(x["r_m"].alias("m"), x["r"].alias("f"), q[0].alias("qm"), q[1].alias("qf"),
                        F.concat(acc["out"], F.array(F.struct(q[0].alias("q_m"), q[1].alias("q_f")))).alias("out"))

    return fold_series(base, ["r", "r_m", "_qm", "_qf", *names], zero, step, "q", kind="struct<q_m:double,q_f:double>").select("entity", "idx", "q.q_m", "q.q_f")


def caviar_fit(df: DataFrame, value: str, a: float = 0.05, count: int = 10000) -> DataFrame:
    """(entity, b1, b2, b3, loss) of q = b1 + b2 |r_prev| + b3 q_prev: least quantile loss among `count` candidates
    of the unit cube, then once more around the winner."""
    start = caviar_start(df, value, a, "_q")

    def propose(rows, centre):
        if centre is None:
            return halton(count, [0.0] * 3, [1.0] * 3)
        return halton(count // 10, [v - 0.1 for v in centre], [v + 0.1 for v in centre])

    def loss(rows, cand):
        r, q = rows[value].to_numpy(float), np.full(len(cand), rows["_q"].iloc[0])
        total = ((a - (r[0] < q)) * (r[0] - q)).astype(float)
        for t in range(1, len(r)):
            q = cand[:, 0] + cand[:, 1] * abs(r[t - 1]) + cand[:, 2] * q
            total += (a - (r[t] < q)) * (r[t] - q)
        return total

    return candidate_scan(df.join(start, "entity"), [value, "_q"], ["b1", "b2", "b3"], propose, loss)


def caviar_params(market: DataFrame, firm: DataFrame) -> DataFrame:
    """Bivariate start parameters from the two univariate fits: diagonal loadings, no cross effects."""
    m = market.select("entity", *[F.col(f"b{i}").alias(f"m{i}") for i in (1, 2, 3)])
    f = firm.select("entity", *[F.col(f"b{i}").alias(f"f{i}") for i in (1, 2, 3)])
    zero = F.lit(0.0)
    cols = ["m1", "f1", "m2", zero, zero, "f2", "m3", zero, zero, "f3"]
    return m.join(f, "entity").select("entity", *[(F.col(c) if isinstance(c, str) else c).alias(f"p{i}") for i, c in enumerate(cols, 1)])


def caviar_irf(df: DataFrame, params: tuple, steps: int = 200) -> DataFrame:
    """Response of the entity quantile to a market shock, and of the market to an entity shock, of size two."""
    p = [float(v) for v in params]
    c = df.groupBy("entity").agg(F.var_samp("r_m").alias("v"), F.covar_samp("r_m", "r").alias("c"), F.var_samp("r").alias("w"))
    l11 = F.sqrt("v")
    l21 = F.col("c") / l11
    l22 = F.sqrt(F.col("w") - l21 * l21)
    shocks = {"fm": (F.abs(2 * l11), F.abs(2 * l21)), "mf": (F.lit(0.0), F.abs(2 * l22))}

    def path(m, f, pick):
        first = [F.lit(p[2 + k]) * m + F.lit(p[4 + k]) * f for k in (0, 1)]
        zero = F.struct(first[0].alias("m"), first[1].alias("f"), F.array(first[pick]).alias("out"))

        def step(acc, _):
            nxt = [F.lit(p[6 + k]) * acc["m"] + F.lit(p[8 + k]) * acc["f"] for k in (0, 1)]
            return F.struct(nxt[0].alias("m"), nxt[1].alias("f"), F.concat(acc["out"], F.array(nxt[pick])).alias("out"))

        return F.aggregate(F.sequence(F.lit(2), F.lit(steps)), zero, step)["out"]

    rows = c.select("entity", F.arrays_zip(path(*shocks["fm"], 1).alias("ir_fm"), path(*shocks["mf"], 0).alias("ir_mf")).alias("z"))
    return rows.select("entity", F.posexplode("z").alias("step", "e")).select("entity", (F.col("step") + 1).alias("step"), "e.ir_fm", "e.ir_mf")


# ---------------------------------------------------------------- rank agreement between measures

def sort_positions(df: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, idx, entity, pos, id): place of each entity in the ascending order of each measure, and its number.

    A date is cut into ranges of values like the whole table, so its entities need not fit one task. The number of an entity
    on a date is the same for all measures and counted once.
    """
    numbered = positions(df.select("idx", "entity", *measures), [F.asc("entity")], "id", by=("idx",))
    long = numbered.unpivot(["entity", "idx", "id"], measures, "measure", "value")
    return positions(long, [F.col("value").asc_nulls_last(), F.asc("entity")], "pos", by=("measure", "idx")).drop("value")


def _coefficient(total: Column, squares: Column, n: Column) -> Column:
    return 12.0 * (squares - total * total / n) / (4.0 * (F.pow(n, F.lit(3.0)) - n))


def kendall_concordance(df: DataFrame, measures: list[str], true_ranks: bool = False) -> DataFrame:
    """Average Kendall W between two measures over dates: (left, right, rc).

    By default the two sort permutations are compared: the numbers of the entities standing at the same place
    are added. With `true_ranks` the places of the same entity are added. One group-by on (date, place) or
    (date, entity) lines the measures up; entities are never paired with each other.
    """
    pos = sort_positions(df, measures)
    k = len(measures)
    aggs = {m: F.max(F.when(F.col("measure") == m, F.col("pos" if true_ranks else "id"))).alias(m) for m in measures}
    wide = pos.groupBy("idx", "id" if true_ranks else "pos").agg(*aggs.values())
    pairs = [(measures[i], measures[j]) for i in range(k) for j in range(i + 1, k)]
    per_date = wide.groupBy("idx").agg(*[F.struct(
        F.lit(a).alias("left"), F.lit(b).alias("right"),
        F.sum((F.col(a) + F.col(b)).cast("double")).alias("t"), F.sum(F.pow((F.col(a) + F.col(b)).cast("double"), 2.0)).alias("q"),
        F.count(F.lit(1)).cast("double").alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = per_date.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    return rows.groupBy("left", "right").agg(F.avg(_coefficient(F.col("t"), F.col("q"), F.col("n"))).alias("rc"))


def rank_stability(df: DataFrame, measures: list[str]) -> DataFrame:
    """Average Kendall W between consecutive dates of one measure: (measure, rs)."""
    pos = sort_positions(df, measures)
    w = Window.partitionBy("measure", "pos").orderBy("idx")
    both = pos.withColumn("sum", (F.col("id") + F.lag("id").over(w)).cast("double")).filter("sum is not null")
    per_date = both.groupBy("measure", "idx").agg(_coefficient(
        F.sum("sum"), F.sum(F.col("sum") * F.col("sum")), F.count("sum").cast("double")).alias("w"))
    return per_date.groupBy("measure").agg(F.avg("w").alias("rs"))
