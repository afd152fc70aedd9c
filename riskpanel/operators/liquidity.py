"""Liquidity measures per entity: price impact, turnover, variance ratio, illiquidity, implicit spread."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.scalar import finite
from riskpanel.operators.series import candidate_scan, halton, per_series
from riskpanel.operators.transforms import ewma, minmax_norm, rolling


def _ratio(num: Column, den: Column) -> Column:
    q = num / F.when(den != 0, den)
    return F.when(finite(q), q).otherwise(0.0)


def _fill_head(df: DataFrame, value: str, rows: int) -> DataFrame:
    """The first rows take the mean of the rows + 1 values after them."""
    w = Window.partitionBy("entity")
    mean = F.avg(F.when(F.col("idx").between(rows + 1, 2 * rows + 1), F.col(value))).over(w)
    return df.withColumn(value, F.when(F.col("idx") <= rows, mean).otherwise(F.col(value)))


def hhlr(df: DataFrame, bwl: int = 252, bws: int = 5) -> DataFrame:
    """Hui-Heubel ratio: relative price range of bws rows over turnover, smoothed and scaled. (entity, idx, hhlr)"""
    x = rolling(df, bws, _hi=F.max("price"), _lo=F.min("price"))
    turn = _ratio(F.col("volume"), F.col("cap"))
    x = x.withColumn("hhlr", _ratio((F.col("_hi") - F.col("_lo")) / F.col("_lo"), turn))
    return minmax_norm(ewma(_fill_head(x, "hhlr", bws), "hhlr", bwl, name="hhlr"), "hhlr", "hhlr")


def turnover(df: DataFrame, bwl: int = 252) -> DataFrame:
    x = df.withColumn("tr", _ratio(F.col("volume"), F.col("cap")))
    return minmax_norm(ewma(x, "tr", bwl, name="tr"), "tr", "tr")


def variance_ratio(df: DataFrame, bwl: int = 252, bwm: int = 21) -> DataFrame:
    """Long-window variance over the scaled short-window one, smoothed. (entity, idx, vr)"""
    x = rolling(rolling(df, bwl, _long=F.var_samp("r")), bwm, _short=F.var_samp("r"))
    x = x.withColumn("vr", _ratio(F.col("_long"), bwl / bwm * F.col("_short")))
    return ewma(_fill_head(x, "vr", bwm), "vr", bwl, name="vr")


def amihud_input(df: DataFrame, magnitude: Column | float) -> DataFrame:
    """|r| / volume times a power of ten; zero or undefined rows take the series mean."""
    raw = magnitude * F.abs(F.col("r")) / F.when(F.col("volume") != 0, F.col("volume"))
    x = df.withColumn("_raw", F.when(finite(raw) & (raw != 0), raw))
    return x.withColumn("amihud", F.coalesce("_raw", F.avg("_raw").over(Window.partitionBy("entity")))).drop("_raw")


def _mem_columns(rows, value: str, controls: list[str], asymmetric: bool):
    v = rows[value].to_numpy(float)
    d = (rows["r"].to_numpy(float) < 0).astype(float) if asymmetric else np.zeros(len(v))
    z = rows[controls].to_numpy(float) if controls else np.zeros((len(v), 0))
    low = z.min(0) if len(z) else np.zeros(0)
    return v, d, z + np.where(low <= 0, low + 1e-6, 0.0)


def _mem_mean(v, d, z, cand):
    """Conditional mean rows by candidates. Columns of cand: a, g, b, then one loading per control (control j enters
    with lag j + 1). The first max(1, controls) rows hold the sample mean."""
    a, g, b, y = cand[:, 0], cand[:, 1], cand[:, 2], cand[:, 3:]
    start = max(1, z.shape[1])
    mu = np.full((len(v), len(cand)), v.mean())
    base = 1.0 - a - 0.5 * g - b - y.sum(1)
    for i in range(start, len(v)):
        mu[i] = base + (a + g * d[i - 1]) * v[i - 1] + b * mu[i - 1]
        for j in range(z.shape[1]):
            mu[i] += y[:, j] * z[i - j - 1, j]
    return mu


def _mem_names(controls):
    return ["a", "g", "b", *[f"y{j + 1}" for j in range(len(controls))]]


def mem_mean(df: DataFrame, value: str, params: DataFrame | tuple, controls: list[str] | None = None, asymmetric: bool = False) -> DataFrame:
    """Multiplicative-error conditional mean (entity, idx, mu) with given parameters."""
    controls = controls or []
    names = _mem_names(controls)
    rows = df.withColumns({n: F.lit(float(v)) for n, v in zip(names, params)}) if isinstance(params, tuple) else df.join(
        params.select("entity", *names), "entity")

    def fn(entity, pdf):
        cand = pdf[names].to_numpy(float)[:1]
        return {"idx": pdf["idx"].to_numpy(), "mu": _mem_mean(*_mem_columns(pdf, value, controls, asymmetric), cand)[:, 0]}

    return per_series(rows, list(dict.fromkeys([value, "r", *controls, *names])), fn, "idx long, mu double")


def mem_fit(df: DataFrame, value: str, controls: list[str] | None = None, asymmetric: bool = False, count: int = 600) -> DataFrame:
    """Least generalised-gamma likelihood loss over candidates with a + g/2 + b + sum(y) < 1: (entity, a, g, b, y.., gamma, loss)."""
    controls = controls or []
    k = len(controls)
    names = [*_mem_names(controls), "gamma"]
    start = [0.05, 0.10, 0.70] if asymmetric else [0.10, 0.0, 0.75]
    first = [*start, *[0.01 / max(k, 1)] * k, 0.5]
    lo = [1e-6] * (3 + k) + [0.2]
    hi = [0.5, 0.5 if asymmetric else 0.0, 0.98, *[0.05] * k, 2.0]
    if not asymmetric:
        lo[1] = 0.0

    def propose(rows, centre):
        low, high = lo, hi
        if centre is not None:
            width = [(h - l) * 0.15 for l, h in zip(lo, hi)]
            low, high = [max(l, c - w) for l, c, w in zip(lo, centre, width)], [min(h, c + w) for h, c, w in zip(hi, centre, width)]
        c = np.vstack([first, halton(count, low, high)])
        return c[c[:, 0] + 0.5 * c[:, 1] + c[:, 2] + c[:, 3:3 + k].sum(1) < 1 - 2e-6]

    def loss(rows, cand):
        v, d, z = _mem_columns(rows, value, controls, asymmetric)
        mu = _mem_mean(v, d, z, cand[:, :-1])
        gamma = cand[:, -1]
        one = np.array([math.lgamma(1 / g) for g in gamma])
        two = np.array([math.lgamma(2 / g) for g in gamma])
        ll = np.log(gamma) - 2 * one + two - (v[:, None] / mu / np.exp(one - two)) ** gamma - np.log(mu)
        return -ll.sum(0)

    return candidate_scan(df, list(dict.fromkeys([value, "r", *controls])), names, propose, loss)


def illiq(df: DataFrame, magnitude: Column | float, bw: int = 252, controls: list[str] | None = None, asymmetric: bool = False,
          params: DataFrame | tuple | None = None) -> DataFrame:
    """Scaled and smoothed conditional mean of the price impact, with or without state variables. (entity, idx, illiq)"""
    x = amihud_input(df, magnitude)
    p = mem_fit(x, "amihud", controls, asymmetric) if params is None else params
    mu = mem_mean(x, "amihud", p, controls, asymmetric)
    return minmax_norm(ewma(mu, "mu", bw, name="illiq"), "illiq", "illiq")


def roll_spread(df: DataFrame, bw: int = 252) -> DataFrame:
    """Implicit spread 2 sqrt(max(0, -cov(dp_t, dp_{t-1}))) of log prices per window, smoothed. (entity, idx, ris)"""
    w = Window.partitionBy("entity").orderBy("idx")
    p = F.ln(F.greatest(F.lit(1e-6), F.col("price")))
    x = df.withColumn("_d", p - F.lag(p).over(w))
    x = x.withColumn("_l", F.lag("_d").over(w))
    x = rolling(x, bw, _c=F.covar_samp("_d", "_l"))
    x = x.withColumn("ris", 2.0 * F.sqrt(F.greatest(F.lit(0.0), -F.coalesce("_c", F.lit(0.0)))))
    return ewma(x, "ris", bw, name="ris")


def covariate_gap(a: DataFrame, b: DataFrame, limit: float = 0.025) -> DataFrame:
    """Rows where the measure with state variables differs from the one without by more than `limit`."""
    both = a.join(b.withColumnRenamed("illiq", "illiqc"), ["entity", "idx"])
    return both.withColumn("gap", F.col("illiqc") - F.col("illiq")).filter(F.abs("gap") > limit)
