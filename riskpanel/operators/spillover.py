"""Spillovers from forecast-error variance decompositions of rolling vector autoregressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.operators.blocks import Block, section_blocks
from riskpanel.operators.transforms import fill_gaps, smooth


def _var_ols(x: np.ndarray, lags: int):
    """Coefficient matrices (lag, equation, variable) and residual covariance of a VAR with intercept."""
    t, n = x.shape
    z = np.hstack([np.ones((t - lags, 1)), *[x[lags - k:t - k] for k in range(1, lags + 1)]])
    y = x[lags:]
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ beta
    return beta[1:].reshape(lags, n, n).transpose(0, 2, 1), e.T @ e / len(y)


def _decompose(a: np.ndarray, c: np.ndarray, h: int, generalised: bool) -> np.ndarray:
    """Share of variable i's h-step forecast-error variance due to shocks in j; rows sum to 1."""
    n = len(c)
    ma = [np.eye(n)]
    for s in range(1, h):
        ma.append(sum(a[k] @ ma[s - 1 - k] for k in range(min(s, len(a)))))
    shock = c / np.sqrt(np.diag(c)) if generalised else np.linalg.cholesky(c)
    total = sum((m @ shock) ** 2 for m in ma)
    return total / total.sum(1, keepdims=True)


def most_series(bw: int, lags: int) -> int:
    """Most series for which a window of `bw` rows leaves a residual covariance of full rank."""
    return (bw - lags - 1) // (lags + 1)


def _last_window(returns: DataFrame, bw: int, lags: int) -> int:
    """Last date; raises if even the full window with the fewest usable series has too many of them."""
    w = Window.partitionBy("entity").orderBy("idx").rangeBetween(1 - bw, 0)
    r = F.when(~F.isnan("r"), F.col("r"))
    usable = (F.count(r).over(w) == bw) & (F.min(r).over(w) < F.max(r).over(w))
    dates = returns.select("idx", usable.cast("int").alias("usable")).groupBy("idx").agg(F.sum("usable").alias("n"))
    last, fewest = dates.agg(F.max("idx"), F.min(F.when(F.col("idx") >= bw, F.col("n")))).first()
    if fewest is not None and fewest > most_series(bw, lags):
        raise ValueError(f"every window of {bw} rows has at least {fewest} series; with {lags} lags it can hold {most_series(bw, lags)}")
    return int(last)


def variance_decomposition(returns: DataFrame, bw: int, lags: int = 2, h: int = 4, generalised: bool = True, step: int = 1) -> DataFrame:
    """(idx, src, dst, value) for every step-th window and the last: share of src's variance due to dst.

    Moving-average terms follow the textbook recursion. Every pair of series with a row in the window has a row: its value is
    null in windows too short for a residual covariance of full rank, and for series with gaps or without variance. A
    window is solved whole and takes at most `most_series(bw, lags)` series; a panel in which each full window has more raises.
    """
    last = _last_window(returns, bw, lags)

    def kernel(block: Block):
        out = []
        for w, lo, hi in block.windows:
            if (w - 1) % step and w != last:
                continue
            x = block.x[lo:hi]
            seen = ~np.isnan(x).all(0)
            x, names = x[:, seen], block.names[seen]
            ok = ~np.isnan(x).any(0)
            ok[ok] = x[:, ok].std(0) > 0
            n = int(ok.sum())
            vd = np.full((len(names), len(names)), np.nan)
            if n > 1 and len(x) - lags >= n * (lags + 1) + 1:
                vd[np.ix_(ok, ok)] = _decompose(*_var_ols(x[:, ok], lags), h, generalised)
            i, j = np.meshgrid(np.arange(len(names)), np.arange(len(names)), indexing="ij")
            out.append(pd.DataFrame({"idx": w, "src": names[i.ravel()], "dst": names[j.ravel()], "value": vd.ravel()}))
        return out

    vd = section_blocks(returns, "r", bw, kernel, "idx long, src string, dst string, value double")
    return vd.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def fill_decomposition(vd: DataFrame, dates: DataFrame) -> DataFrame:
    """Edges on every date: linear between windows with a value, nearest value at the ends, rows rescaled to 1."""
    ends = vd.groupBy("src", "dst").agg(F.min("idx").alias("lo"))
    span = dates.agg(F.struct(F.min("idx").alias("lo"), F.max("idx").alias("hi")).alias("s")).scalar()
    grid = ends.withColumn("s", span).withColumn("idx", F.explode(F.sequence(F.col("s.lo"), F.col("s.hi")))).select("src", "dst", "idx")
    filled = fill_gaps(grid.join(vd, ["src", "dst", "idx"], "left"), "value", ("src", "dst"))
    return filled.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("idx", "src")))


def _unit(c: Column) -> Column:
    """Clamped to [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def spillovers(vd: DataFrame) -> DataFrame:
    """Per date and entity: spillover received (sf), given (st) and net (sn); null where no edge of the entity has a value."""
    off = F.col("src") != F.col("dst")
    zero = F.when(F.col("value").isNotNull(), 0.0)
    rows = vd.filter(off).select("idx", F.col("src").alias("entity"), F.col("value").alias("sf"), zero.alias("st")).unionByName(
        vd.filter(off).select("idx", F.col("dst").alias("entity"), zero.alias("sf"), F.col("value").alias("st")))
    s = rows.groupBy("idx", "entity").agg(_unit(F.sum("sf")).alias("sf"), F.sum("st").alias("st"))
    return s.withColumn("sn", F.col("st") - F.col("sf"))


def spillover_index(vd: DataFrame) -> DataFrame:
    """Per date the off-diagonal share of the decomposition; null where no edge has a value."""
    zero = F.when(F.col("value").isNotNull(), 0.0)
    row = vd.groupBy("idx", "src").agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("value")).otherwise(zero)).alias("own"),
                                       F.sum(F.when(F.col("src") != F.col("dst"), F.col("value")).otherwise(zero)).alias("from_others"))
    sf = _unit(F.col("from_others"))
    return row.groupBy("idx").agg((F.sum(sf) / (F.sum("own") + F.sum(sf))).alias("si"))


def spillover_shares(spill: DataFrame, s: int = 21) -> DataFrame:
    """Smoothed received and given spillovers as shares of their date totals, and the range of smoothed net ones."""
    x = smooth(spill, "sf", s, name="sf_s")
    x = smooth(x, "st", s, name="st_s")
    x = smooth(x, "sn", s, name="sn_s")
    w = Window.partitionBy("idx")
    share = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.col(c) / F.when(F.sum(c).over(w) != 0, F.sum(c).over(w)), F.lit(0.0)))
    return x.select("idx", "entity", share("sf_s").alias("from_share"), share("st_s").alias("to_share"),
                    F.min("sn_s").over(w).alias("net_low"), F.max("sn_s").over(w).alias("net_high"))
