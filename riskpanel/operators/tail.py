"""Tail dependence of pairs and the starting penalty of tail-quantile regressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.scalar import half_up
from riskpanel.operators.blocks import Block, pair_blocks, pair_sums

Z975 = NormalDist().inv_cdf(0.975)


def expand_bandwidth(bw: int, t: int) -> int:
    """Smallest multiple (from 2) of bw that covers 30 % of t rows; bw itself when t holds no second multiple."""
    for i in range(2, math.ceil(t / bw) + 1):
        if bw * i / t >= 0.3:
            return bw * i
    return bw


def chi_pairs(returns: DataFrame, bw: int, f: float = 0.10, pt: float = 0.5, lower: bool = True) -> DataFrame:
    """(idx, src, dst, chi, chi_bar) per unordered pair and window (windows already expanded by expand_bandwidth).

    Ranks become unit Frechet variates; the Hill sum of the largest minima gives chi_bar, and chi is the level where
    chi_bar is not significantly below 1. The first bw windows are damped from pt up to 1.
    """
    def kernel(block: Block):
        out = []
        for w, lo, hi in block.windows:
            ok, chi, bar = _chi(block, w, lo, hi, bw, f, pt, lower)
            swap = block.names[block.i] > block.names[block.j]
            a, b = np.where(swap, block.j, block.i), np.where(swap, block.i, block.j)
            out.append(block.edges(w, a, b, ok, chi=chi, chi_bar=bar))
        return out

    return pair_blocks(returns, "r", bw, kernel, "idx long, src string, dst string, chi double, chi_bar double")


def _chi(block: Block, w: int, lo: int, hi: int, bw: int, f: float, pt: float, lower: bool):
    """Of every pair of a window: whether both series are whole, chi and chi_bar."""
    x = block.x[lo:hi]
    t = len(x)
    nu = max(half_up(t * f), 1)
    ok = ~np.isnan(x).any(0)
    u = pd.DataFrame(x).rank().to_numpy() / (t + 1)
    z = -1.0 / np.log(1.0 - u if lower else u)
    top = np.partition(np.minimum(z[:, block.i], z[:, block.j]), t - nu - 1, axis=0)[t - nu - 1:]
    base = top.min(0)
    eta = np.zeros(len(base)) if nu == 1 else np.log(top / base).sum(0)
    bar = 2.0 / (nu + 1) * eta - 1.0
    level = bar + Z975 * (bar + 1.0) / math.sqrt(nu + 1)
    damp = pt + (1.0 - pt) * (w - 1) / (bw - 1) if w <= bw else 1.0
    return ok[block.i] & ok[block.j], np.where(level >= 1.0, base * (nu + 1) / t, 0.0) * damp, bar * damp


def chi_sums(returns: DataFrame, bw: int, f: float = 0.10, pt: float = 0.5, lower: bool = True) -> DataFrame:
    """(idx, entity, pairs, total, positive): count, sum of chi and count of positive chi over the pairs that are counted with
    this entity; each pair is counted once, with one of its two. No pair leaves a task."""

    def kernel(block: Block, w: int, lo: int, hi: int):
        ok, chi, _ = _chi(block, w, lo, hi, bw, f, pt, lower)
        at, n = block.i[ok], len(block.names)
        return [np.bincount(at, minlength=n), np.bincount(at, chi[ok], n), np.bincount(block.i[ok & (chi > 0)], minlength=n)]

    return pair_sums(returns, "r", bw, kernel, {"pairs": "long", "total": "double", "positive": "long"})


def chi_metrics(sums: DataFrame) -> DataFrame:
    """Average chi and share of positive chi among the pairs of each date, from `chi_sums`."""
    pairs = F.sum("pairs")
    return sums.groupBy("idx").agg((F.sum("total") / pairs).alias("achi"), (F.sum("positive") / pairs).alias("adr"))


def entry_penalty(returns: DataFrame, covariates: DataFrame, bw: int, a: float = 0.05) -> DataFrame:
    """(idx, entity, penalty): where the quantile-regression penalty path of an entity on all others and on the state
    variables starts.

    With e the element floor(t a) + 1 of y, the gain of covariate x is (1 - a) sum of x - x_e over rows below y_e less a
    times the sum over rows above; the penalty is |min(gain, 0)| over covariates. Per block pair this is one matrix
    product, and only each entity's minimum leaves the task. `covariates` has (var, idx, value).
    """
    mark = "\x01"
    extra = covariates.select(F.concat(F.lit(mark), "var").alias("entity"), "idx", F.col("value").alias("r"))
    both = returns.select("entity", "idx", "r").unionByName(extra)

    def kernel(block: Block):
        out = []
        sides = [(block.left, block.right)] if block.same else [(block.left, block.right), (block.right, block.left)]
        plain = np.array([not n.startswith(mark) for n in block.names])
        for w, lo, hi in block.windows:
            x = block.x[lo:hi]
            t = len(x)
            ok = plain & ~np.isnan(x).any(0)
            filled = np.nan_to_num(x)
            for own, other in sides:
                own = own[ok[own]]
                if not len(own) or not len(other):
                    continue
                y = x[:, own]
                q = np.sort(y, axis=0)[int(math.floor(t * a))]
                at = t - 1 - np.argmax((y == q)[::-1], axis=0)
                weight = (1 - a) * (y < q) - a * (y > q)
                gain = weight.T @ filled[:, other] - weight.sum(0)[:, None] * filled[at][:, other]
                gain[own[:, None] == other[None, :]] = np.inf
                out.append(pd.DataFrame({"idx": w, "entity": block.names[own], "gain": gain.min(1)}))
        return out

    part = pair_blocks(both, "r", bw, kernel, "idx long, entity string, gain double")
    return part.groupBy("idx", "entity").agg(F.abs(F.least(F.min("gain"), F.lit(0.0))).alias("penalty"))


def frm(penalties: DataFrame) -> DataFrame:
    return penalties.groupBy("idx").agg(F.avg("penalty").alias("frm"))
