"""Component measures: absorption, turbulence, correlation surprise, principal components, CATFIN."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.scalar import half_up
from riskpanel.operators.blocks import Block, pair_blocks, section_blocks
from riskpanel.operators.transforms import explode_windows, head_rows
from riskpanel.session import cut_lineage


def rolling_cov(returns: DataFrame, bw: int) -> DataFrame:
    """Covariance of every unordered pair of entities and every window (src < dst by name, plus the diagonal)."""

    def kernel(block: Block):
        out = []
        diagonal = np.unique(np.concatenate([block.i, block.j])) if len(block.i) else np.arange(len(block.names))
        for w, lo, hi in block.windows:
            x = block.x[lo:hi]
            d = x - x.mean(0)
            parts = [(block.i, block.j, (d[:, block.i] * d[:, block.j]).sum(0) / (len(x) - 1))]
            if block.same:
                parts.append((diagonal, diagonal, (d[:, diagonal] ** 2).sum(0) / (len(x) - 1)))
            for i, j, cov in parts:
                swap = block.names[i] > block.names[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                out.append(block.edges(w, a, b, ~np.isnan(cov), cov=cov))
        return out

    return pair_blocks(returns, "r", bw, kernel, "idx long, src string, dst string, cov double")


def _spectrum(d: np.ndarray) -> np.ndarray:
    """Eigenvalues of d'd in descending order, through the smaller of the two Gram matrices."""
    gram = d.T @ d if d.shape[1] <= d.shape[0] else d @ d.T
    return np.clip(np.linalg.eigvalsh(gram)[::-1], 0.0, None)


def component_metrics(returns: DataFrame, bw: int, f: float = 0.2) -> DataFrame:
    """Absorption ratio, turbulence index and correlation surprise per window.

    Series with gaps or without variance in the window are left out. Turbulence needs more rows than
    series, as the covariance must be invertible; otherwise it is missing.
    """

    def kernel(block: Block):
        out = []
        for w, lo, hi in block.windows:
            x = block.x[lo:hi]
            x = x[:, ~np.isnan(x).any(0)]
            x = x[:, x.var(0) > 0]
            t, n = x.shape
            if t < 5 or n < 2:
                continue
            d = x - x.mean(0)
            eig = _spectrum(d)
            fc = max(half_up(n * f), 1)
            ar = eig[:fc].sum() / (d * d).sum()
            ti = cs = None
            v = x[-1] - x[:-1].mean(0)
            if t > n:
                ti = float(v @ np.linalg.solve(d.T @ d / (t - 1), v))
                cs = ti / float((v * v / (d * d).sum(0) * (t - 1)).sum())
            out.append(pd.DataFrame({"idx": [w], "ar": [ar], "cs": [cs], "ti": [ti]}).astype(
                {"ar": float, "cs": float, "ti": float}))
        return out

    return section_blocks(returns, "r", bw, kernel, "idx long, ar double, cs double, ti double")


def surprise_denominator(returns: DataFrame, bw: int) -> DataFrame:
    """Sum over entities of squared deviation of the newest row over the variance, by window frames only."""
    order = Window.partitionBy("entity").orderBy("idx")
    frame, past = order.rowsBetween(1 - bw, 0), order.rowsBetween(1 - bw, -1)
    v = F.col("r") - F.avg("r").over(past)
    term = returns.withColumn("term", v * v / F.var_samp("r").over(frame)).filter(F.col("idx") >= bw)
    return term.groupBy("idx").agg(F.sum("term").alias("denominator"))


def window_pca(returns: DataFrame, bw: int, k: int = 3) -> DataFrame:
    """First k loadings per window of the standardised returns, largest absolute loading made positive."""

    def kernel(block: Block):
        out = []
        for w, lo, hi in block.windows:
            x = block.x[lo:hi]
            ok = ~np.isnan(x).any(0)
            ok[ok] = x[:, ok].std(0) > 0
            if ok.sum() < 2:
                continue
            z = (x[:, ok] - x[:, ok].mean(0)) / x[:, ok].std(0, ddof=1)
            _, s, vt = np.linalg.svd(z, full_matrices=False)
            share = s * s / (s * s).sum() * 100.0
            for c in range(min(k, len(s))):
                load = vt[c] * np.sign(vt[c][np.argmax(np.abs(vt[c]))])
                out.append(pd.DataFrame({"idx": w, "component": c + 1, "entity": block.names[ok], "loading": load,
                                         "explained": share[c]}))
        return out

    return section_blocks(returns, "r", bw, kernel,
                          "idx long, component int, entity string, loading double, explained double")


def explained_sums(pca: DataFrame) -> DataFrame:
    """Cumulative explained share of the first components per window."""
    w = Window.partitionBy("idx").orderBy("component")
    return pca.select("idx", "component", "explained").distinct().withColumn("explained_sum", F.sum("explained").over(w))


def gram_matrix(wide: DataFrame, cols: list[str], parts: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Row count, column sums and the Gram matrix of a wide frame: one partial matrix per task, summed by Spark.

    Only len(cols)^2 numbers reach the driver.
    """
    k = len(cols)

    def partial(batches):
        n, s, g = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            x = b[cols].to_numpy(dtype=float)
            x = x[~np.isnan(x).any(1)]
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pd.DataFrame({"pos": np.arange(k * k + k + 1), "v": np.concatenate([[n], s, g.ravel()])})

    total = wide.select(*cols).mapInPandas(partial, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
    v = np.zeros(k * k + k + 1)
    for row in total.collect():
        v[row["pos"]] = row["v"]
    return v[1:k + 1], v[k + 1:].reshape(k, k), int(v[0])


def pca_wide(wide: DataFrame, cols: list[str], keys: list[str], normalize: bool = True):
    """Whole-sample PCA of a few columns: (loadings, explained %, frame with scores pc1..pck).

    Rows stay in Spark; the driver only sees the k x k covariance. Signs make the largest loading positive.
    """
    s, g, n = gram_matrix(wide, cols)
    mean = s / n
    cov = (g - n * np.outer(mean, mean)) / (n - 1)
    sd = np.sqrt(np.diag(cov)) if normalize else np.ones(len(cols))
    cov = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(cols))])
    scores = []
    for c in range(len(cols)):
        expr = F.lit(0.0)
        for r, name in enumerate(cols):
            expr = expr + (F.col(name) - float(mean[r])) * float(vectors[r, c] / sd[r])
        scores.append(expr.alias(f"pc{c + 1}"))
    return vectors, values / values.sum() * 100.0, wide.select(*keys, *scores)


def pca_biplot(loadings: np.ndarray, cols: list[str], scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the first three components rescaled to the longest loading vector, next to their loadings."""
    three = loadings[:, :3]
    longest = float(np.sqrt((three ** 2).sum(1).max()))
    names = [f"pc{c + 1}" for c in range(three.shape[1])]
    top = scores.agg(F.max(F.greatest(*[F.abs(c) for c in names])).alias("m")).scalar()
    out = scores.withColumn("m", top)
    return out.select(*keys, *[(longest * F.col(c) / F.col("m")).alias(c) for c in names])


# ---------------------------------------------------------------- value at risk of the portfolio

def var_nonparametric(rp: DataFrame, bw: int, a: float, lam: float = 0.98) -> DataFrame:
    """Age-weighted historical quantile: smallest return whose cumulated weight reaches `a`; at most 0."""
    win = explode_windows(rp, "rp", bw, ())
    w = Window.partitionBy("idx")
    weight = (1.0 - lam) / (1.0 - F.pow(F.lit(lam), F.col("t"))) * F.pow(F.lit(lam), F.col("t") - F.col("pos"))
    cum = win.withColumn("w", weight).withColumn("cum", F.sum("w").over(w.orderBy("rp", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    hit = cum.filter(F.col("cum") >= a - 1e-12)
    return hit.groupBy("idx").agg(F.least(F.min("rp"), F.lit(0.0)).alias("var_np"))


def var_gpd(rp: DataFrame, bw: int, a: float, u: float = 0.05) -> DataFrame:
    """Peaks over threshold with k = round(1 / u) exceedances; the tail is fitted by probability-weighted moments.

    Threshold: the (t - k)-th smallest loss. Shape xi = 2 - a0 / (a0 - 2 a1), scale 2 a0 a1 / (a0 - 2 a1).
    """
    k = half_up(1.0 / u)
    w = Window.partitionBy("idx")
    loss = explode_windows(rp, "rp", bw, ()).withColumn("loss", -F.col("rp"))
    loss = loss.withColumn("rank", F.row_number().over(w.orderBy("loss", "pos")))
    loss = loss.withColumn("threshold", F.max(F.when(F.col("rank") == F.col("t") - k, F.col("loss"))).over(w))
    y = F.col("loss") - F.col("threshold")
    exc = loss.filter(y > 0).withColumn("y", y)
    exc = exc.withColumns({"i": F.row_number().over(w.orderBy("y", "pos")), "m": F.count(F.lit(1)).over(w)})
    plot = 1.0 - (F.col("i") - 0.35) / F.col("m")
    fit = exc.groupBy("idx").agg(F.first("threshold").alias("threshold"), F.first("t").alias("t"),
                                 F.avg("y").alias("a0"), F.avg(F.col("y") * plot).alias("a1"))
    xi = 2.0 - F.col("a0") / (F.col("a0") - 2.0 * F.col("a1"))
    beta = 2.0 * F.col("a0") * F.col("a1") / (F.col("a0") - 2.0 * F.col("a1"))
    fit = fit.withColumns({"xi": xi, "beta": beta})
    tail = F.col("threshold") + F.col("beta") / F.col("xi") * (F.pow(F.col("t") / F.lit(float(k)) * a, -F.col("xi")) - 1.0)
    return fit.select("idx", F.least(-tail, F.lit(0.0)).alias("var_gpd"))


def extremal_index(rp: DataFrame, bw: int) -> DataFrame:
    """Inverse mean of -k log(share of the window at or below the maximum of k consecutive rows)."""
    rows = _blocked(rp, bw)
    order = Window.partitionBy("idx").orderBy("pos")
    frame = F.collect_list("rp").over(order.rowsBetween(0, head_rows(bw) - 1))
    rows = rows.withColumn("top", F.array_max(F.slice(frame, F.lit(1), F.col("k"))))
    whole = Window.partitionBy("idx")
    # A maximum is a value of the window, so its share is its rank with ties counted in.
    below = F.cume_dist().over(whole.orderBy("rp"))
    shares = rows.withColumn("share", below)
    value = shares.groupBy("idx", "rp").agg(F.max("share").alias("share")).withColumnRenamed("rp", "top")
    starts = rows.filter(F.col("pos") <= F.col("t") - F.col("k") + 1).select("idx", "top", "k")
    return starts.join(value, ["idx", "top"]).groupBy("idx").agg(
        (1.0 / F.avg(-F.col("k") * F.ln("share"))).alias("theta"))


def _blocked(rp: DataFrame, bw: int) -> DataFrame:
    """Windows with the block count k = max(round(t^(1/1.81)), 5) of their own length."""
    k = F.greatest(F.floor(F.pow(F.col("t").cast("double"), F.lit(1 / 1.81)) + 0.5), F.lit(5)).cast("int")
    return explode_windows(rp, "rp", bw, ()).withColumn("k", k)


def var_gev(rp: DataFrame, bw: int, a: float) -> DataFrame:
    """Quantile of the block-maxima distribution, fitted by L-moments and adjusted by the extremal index.

    k blocks of floor(t / k) rows, the last takes the remainder. Shape from Hosking's approximation.
    """
    rows = _blocked(rp, bw)
    size = F.floor(F.col("t") / F.col("k"))
    block = F.least(F.floor((F.col("pos") - 1) / size), F.col("k") - 1)
    top = rows.groupBy("idx", "t", "k", block.alias("block")).agg(F.max("rp").alias("x"))
    j = F.row_number().over(Window.partitionBy("idx").orderBy("x", "block")) - 1.0
    k = F.col("k")
    b = top.withColumn("j", j).groupBy("idx", "t", "k").agg(
        F.avg("x").alias("b0"), F.avg(F.col("x") * F.col("j") / (k - 1.0)).alias("b1"),
        F.avg(F.col("x") * F.col("j") * (F.col("j") - 1.0) / ((k - 1.0) * (k - 2.0))).alias("b2"))
    l2 = 2.0 * F.col("b1") - F.col("b0")
    t3 = (6.0 * F.col("b2") - 6.0 * F.col("b1") + F.col("b0")) / l2
    c = 2.0 / (3.0 + t3) - 0.6309297535714574
    fit = b.withColumn("h", 7.8590 * c + 2.9554 * c * c).withColumn("g", _gamma(1.0 + F.col("h")))
    sigma = l2 * F.col("h") / ((1.0 - F.pow(F.lit(2.0), -F.col("h"))) * F.col("g"))
    fit = fit.withColumn("sigma", sigma)
    fit = fit.withColumn("mu", F.col("b0") - F.col("sigma") * (1.0 - F.col("g")) / F.col("h")).withColumn("xi", -F.col("h"))
    fit = fit.join(extremal_index(rp, bw), "idx")
    reach = -(F.col("t") / k) * F.col("theta") * F.ln(F.lit(1.0 - a))
    value = -(F.col("mu") - F.col("sigma") / F.col("xi") * (1.0 - F.pow(reach, -F.col("xi"))))
    return fit.select("idx", F.least(value, F.lit(0.0)).alias("var_gev"))


# Lanczos coefficients for g = 7 and nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _gamma(x: Column) -> Column:
    """Gamma function of positive columns by the Lanczos sum."""
    z = x - 1.0
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + c / (z + float(i))
    t = z + 7.5
    return 2.5066282746310002 * F.pow(t, z + 0.5) * F.exp(-t) * s


def catfin(rp: DataFrame, bw: int, a: float, lam: float = 0.98, u: float = 0.05) -> DataFrame:
    """First principal component score of the three VaR series (as positive losses), unstandardised.

    Every date has a row. The component is fitted on dates with all three; the others have a null score.
    """
    cols = ["var_np", "var_gpd", "var_gev"]
    vars_ = rp.select("idx").distinct()
    for part in (var_nonparametric(rp, bw, a, lam), var_gpd(rp, bw, a, u), var_gev(rp, bw, a)):
        vars_ = vars_.join(part, "idx", "left")
    wide = cut_lineage(vars_.select("idx", *[F.when(~F.isnan(c), -F.col(c)).alias(c) for c in cols]))
    _, _, scores = pca_wide(wide.dropna(subset=cols), cols, ["idx"], normalize=False)
    return wide.join(scores.select("idx", F.col("pc1").alias("catfin")), "idx", "left")
