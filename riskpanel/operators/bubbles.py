"""Explosive-root bubble detection: recursive ADF statistics, critical values, episodes and their breakdown."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.operators.series import per_series


def adf_stat(df: DataFrame, value: str = "price") -> DataFrame:
    """t statistic of the lagged level in dy on (y_{-1}, 1), one row per series, from six sums."""
    w = Window.partitionBy("entity").orderBy("idx")
    d = df.withColumn("x", F.lag(value).over(w)).withColumn("d", F.col(value) - F.lag(value).over(w))
    s = d.groupBy("entity").agg(
        F.count("x").alias("m"), F.regr_sxx("d", "x").alias("sxx"), F.regr_sxy("d", "x").alias("sxd"), F.regr_syy("d", "x").alias("sdd"))
    b = F.col("sxd") / F.col("sxx")
    return s.select("entity", (b / F.sqrt((F.col("sdd") - b * F.col("sxd")) / (F.col("m") - 2) / F.col("sxx"))).alias("stat"))


def _criterion(kind: str, sse, k, d):
    fit = np.log(2 * math.pi) + sse / k
    if kind == "AIC":
        return fit + 2 * d
    if kind == "BIC":
        return fit + np.log(k) * d
    if kind == "FPE":
        return fit + np.log((k + d + 1) / (k + d - 1))
    return fit + 2 * np.log(np.log(k)) * d


def _inverse(a: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of Gram matrices, and where there is none: `short`, or a column that the others explain to 1 - 1e-10."""
    d = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0.0))
    d[d == 0] = 1.0
    scale, eye = d[:, :, None] * d[:, None, :], np.eye(a.shape[1])
    r = np.where(short[:, None, None], eye, a / scale)
    try:
        inv = np.linalg.inv(r)
    except np.linalg.LinAlgError:
        inv = np.linalg.inv(r + 1e-13 * eye)
    inflation = np.einsum("nii->ni", inv)
    return inv / scale, short | ~((inflation > 0) & (inflation < 1e10)).all(1)


def _adf_from_sums(g: np.ndarray, lags: int, full: int, m: np.ndarray, kind: str):
    """Statistics from Gram sums of (y_{-1}, 1, dy_{-1}..dy_{-full}, dy), batched over windows.

    A window with no more rows than regressors, or with dependent ones (flat prices), has no statistic at that number of lags.
    """
    best, stat, chosen = None, None, None
    for k in (range(full + 1) if kind != "FIX" else (lags,)):
        use = [0, 1, *range(2, 2 + k)]
        a, c = g[:, use][:, :, use], g[:, use, -1]
        inv, none = _inverse(a, m <= k + 2)
        b = np.einsum("nij,nj->ni", inv, c)
        sse = g[:, -1, -1] - (b * c).sum(1)
        with np.errstate(all="ignore"):
            s = np.where(none, np.nan, b[:, 0] / np.sqrt(sse / (m - 2) * inv[:, 0, 0]))
        if kind == "FIX":
            return s, np.full(len(s), k)
        with np.errstate(all="ignore"):
            ic = np.where(none, np.inf, _criterion(kind, sse, m, (k + 2) / m))
        better = np.ones(len(s), bool) if best is None else ic < best
        best = ic if best is None else np.where(better, ic, best)
        stat = s if stat is None else np.where(better, s, stat)
        chosen = np.full(len(s), k) if chosen is None else np.where(better, k, chosen)
    return stat, chosen


def _prefix(y: np.ndarray, lags: int) -> np.ndarray:
    """Running sums of outer products; row t covers observations up to level t (0-based)."""
    y = y - y.mean()
    dy = np.diff(y)
    n = len(dy)
    z = np.zeros((n, lags + 3))
    z[:, 0], z[:, 1], z[:, -1] = y[:-1], 1.0, dy
    for j in range(1, lags + 1):
        z[j:, 1 + j] = dy[:-j]
    out = np.zeros((n + 1, lags + 3, lags + 3))
    np.cumsum(z[:, :, None] * z[:, None, :], axis=0, out=out[1:])
    return out


def adf_stat_lags(df: DataFrame, value: str = "price", lag_max: int = 10, kind: str = "AIC") -> DataFrame:
    """As adf_stat with up to lag_max lagged differences, their number chosen by a criterion on one sample."""

    def fn(entity, rows):
        y = rows[value].to_numpy(float)
        p = _prefix(y, lag_max)
        m = np.array([len(y) - 1 - lag_max], float)
        stat, lag = _adf_from_sums((p[-1] - p[lag_max])[None], lag_max, lag_max, m, kind)
        return {"stat": stat, "lag": lag}

    return per_series(df, [value], fn, "stat double, lag int")


def minimum_window(t: int) -> int:
    return int(math.floor((0.01 + 1.8 / math.sqrt(t)) * t))


def _sup_stats(y: np.ndarray, w: int, lag_max: int = 0, kind: str = "FIX") -> np.ndarray:
    """Per end row i >= w the largest statistic over all starts that leave at least w rows."""
    p, t = _prefix(y, lag_max), len(y)
    out = np.full(t, np.nan)
    for i in range(w, t + 1):
        starts = np.arange(0, i - w + 1)
        g = p[i - 1] - p[np.minimum(starts + lag_max, i - 1)]
        m = (i - 1 - starts - lag_max).astype(float)
        if lag_max == 0:
            sx, n, sd = g[:, 0, 1], g[:, 1, 1], g[:, 1, 2]
            sxx, sxd, sdd = g[:, 0, 0] - sx * sx / n, g[:, 0, 2] - sx * sd / n, g[:, 2, 2] - sd * sd / n
            b = sxd / sxx
            stat = b / np.sqrt((sdd - b * sxd) / (m - 2) / sxx)
        else:
            stat, _ = _adf_from_sums(g, lag_max, lag_max, m, kind)
        out[i - 1] = np.fmax.reduce(stat)
    return out


def bsadf(df: DataFrame, value: str = "price", lag_max: int = 0, kind: str = "FIX") -> DataFrame:
    """Backward sup-ADF per row. A task holds one series and its prefix sums; the (start, end) pairs exist only as
    one vector per end."""

    def fn(entity, rows):
        y = rows[value].to_numpy(float)
        return {"idx": rows["idx"].to_numpy(), "bsadf": _sup_stats(y, minimum_window(len(y)), lag_max, kind)}

    return per_series(df, [value], fn, "idx long, bsadf double").filter("bsadf is not null and not isnan(bsadf)")


def bubble_islands(stats: DataFrame, lengths: DataFrame, mbd: int | None = None) -> DataFrame:
    """Episodes above the critical value: runs shorter than mbd rows are dropped, then runs at most 2 mbd apart
    are joined. `stats` has bsadf and cv, `lengths` the rows t per entity (mbd defaults to floor(ln t))."""
    w = Window.partitionBy("entity").orderBy("idx")
    hot = stats.filter("bsadf > cv").withColumn("run", F.col("idx") - F.row_number().over(w))
    runs = hot.groupBy("entity", "run").agg(F.min("idx").alias("s"), F.max("idx").alias("e")).join(lengths, "entity")
    least = F.lit(mbd) if mbd is not None else F.floor(F.ln("t"))
    runs = runs.withColumn("mbd", least).filter(F.col("e") - F.col("s") + 1 >= F.col("mbd"))
    w2 = Window.partitionBy("entity").orderBy("s")
    far = F.coalesce((F.col("s") - F.lag("e").over(w2) > 2 * F.col("mbd")).cast("int"), F.lit(1))
    runs = runs.withColumn("far", far).withColumn("episode", F.sum("far").over(w2))
    return runs.groupBy("entity", "episode").agg(F.min("s").alias("start_idx"), F.max("e").alias("end_idx"))


def bubble_breakdown(islands: DataFrame, df: DataFrame, value: str = "price") -> DataFrame:
    """Peak (first maximum after the start row) and durations of each episode."""
    rows = islands.join(df.select("entity", "idx", value), "entity").filter("idx > start_idx and idx <= end_idx")
    peak = rows.groupBy("entity", "episode", "start_idx", "end_idx").agg(
        F.min_by("idx", F.struct(-F.col(value), "idx")).alias("peak_idx"))
    return peak.withColumns({"duration": F.col("end_idx") - F.col("start_idx") + 1, "boom": F.col("peak_idx") - F.col("start_idx")}).withColumn(
        "burst", F.col("duration") - F.col("boom"))


def bubble_flags(df: DataFrame, breakdown: DataFrame) -> DataFrame:
    """0/1 per row: in a bubble, in its boom (start..peak), in its burst (after the peak)."""
    b = breakdown.select(F.col("entity").alias("_e"), "start_idx", "peak_idx", "end_idx")
    inside = (F.col("entity") == F.col("_e")) & F.col("idx").between(F.col("start_idx"), F.col("end_idx"))
    j = df.join(b, inside, "left").drop("_e")
    hit = F.col("start_idx").isNotNull()
    boom = hit & (F.col("idx") <= F.col("peak_idx"))
    return j.withColumns({"bub": hit.cast("int"), "bmph": boom.cast("int"), "brph": (hit & ~boom).cast("int")}).drop(
        "start_idx", "peak_idx", "end_idx")


def bubble_capitalization(flags: DataFrame) -> DataFrame:
    """Per date the capital in bubbles and its share of all capital."""
    bc = F.sum(F.col("bub") * F.col("cap"))
    return flags.groupBy("date").agg(bc.alias("bc"), (bc / F.sum("cap")).alias("bcp"))
