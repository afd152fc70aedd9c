"""Regime-switching probabilities of returns with 2, 3 or 4 states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.operators.series import candidate_scan, halton, per_series

# Which transitions are free (1) per number of states.
TRANSITIONS = {
    2: ((1, 1), (1, 1)),
    3: ((1, 1, 0), (1, 1, 1), (0, 1, 1)),
    4: ((1, 1, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1), (1, 0, 1, 1)),
}


def parameter_names(k: int) -> list[str]:
    return [f"c{i + 1}" for i in range(k)] + [f"m{i + 1}" for i in range(k)] + [f"p{i + 1}{j + 1}" for i in range(k) for j in range(k)]


def _split(cand: np.ndarray, k: int):
    return cand[:, :k], cand[:, k:2 * k], cand[:, 2 * k:].reshape(-1, k, k)


def _filter(x: np.ndarray, cand: np.ndarray, k: int):
    """Forward filter, vectorised over candidates: loss, predicted and filtered probabilities per row."""
    c, m, p = _split(cand, k)
    z = np.exp(-0.5 * (x[:, None, None] - m) ** 2 / c) / np.sqrt(2 * np.pi * c)
    g = np.full((len(cand), k), 1.0 / k)
    prob, kept, loss = [], [], np.zeros(len(cand))
    for t in range(len(x)):
        ahead = np.einsum("cij,ci->cj", p, g)
        w = ahead * z[t]
        f = w.sum(1)
        g = w / f[:, None]
        prob.append(np.full_like(g, 1.0 / k) if t == 0 else ahead)
        kept.append(g)
        if t:
            loss -= np.log(f)
    return loss, np.array(prob), np.array(kept)


# Fixed values of the measured model: multiples of the variance by state, the least distance of a mean from 0, and how far
# the outer means of four states lie beyond the means of the losses and of the gains.
SPREADS = {2: (1.5, 0.5), 3: (1.5, 1.0, 0.5), 4: (2.0, 1.5, 1.0, 0.5)}
LEAST_MEAN = 2e-6
BEYOND = 1.25


def start_values(x: np.ndarray, k: int):
    """Variances and means the fit is built around."""
    low = min(x[x < 0].mean() if (x < 0).any() else 0.0, -LEAST_MEAN)
    high = max(x[x > 0].mean() if (x > 0).any() else 0.0, LEAST_MEAN)
    mid = x.mean() if low < x.mean() < high else (low + high) / 2
    means = {2: [low, high], 3: [low, mid, high], 4: [-BEYOND * abs(low), high, low, BEYOND * high]}
    return x.var(ddof=1) * np.array(SPREADS[k]), np.array(means[k])


def given_parameters(df: DataFrame, value: str = "r", stay: float = 0.9) -> DataFrame:
    """Two-state parameters per series without a fit: the start variances and means, and a fixed chance to stay."""
    v, below, above = F.var_samp(value), F.avg(F.when(F.col(value) < 0, F.col(value))), F.avg(F.when(F.col(value) > 0, F.col(value)))
    rows = df.groupBy("entity").agg((1.5 * v).alias("c1"), (0.5 * v).alias("c2"), F.least(F.coalesce(below, F.lit(0.0)), F.lit(-2e-6)).alias("m1"),
                                    F.greatest(F.coalesce(above, F.lit(0.0)), F.lit(2e-6)).alias("m2"))
    return rows.withColumns({n: F.lit(stay if n in ("p11", "p22") else 1.0 - stay) for n in ("p11", "p12", "p21", "p22")})


def _candidates(x: np.ndarray, k: int, count: int, centre) -> np.ndarray:
    c0, m0 = start_values(x, k)
    mask = np.array(TRANSITIONS[k], bool)
    rows = [np.flatnonzero(r) for r in mask]
    dims = 2 * k + sum(len(r) - 1 for r in rows)
    u = halton(count, [0.0] * dims, [1.0] * dims)
    p = np.zeros((count, k, k))
    at = 2 * k
    for i, free in enumerate(rows):
        stay, others = 0.5 + 0.499 * u[:, at], [j for j in free if j != i]
        p[:, i, i] = stay
        first = u[:, at + 1] if len(others) == 2 else np.ones(count)
        p[:, i, others[0]] = (1 - stay) * first
        if len(others) == 2:
            p[:, i, others[1]] = (1 - stay) * (1 - first)
        at += len(free) - 1
    if centre is None:
        c, m = c0 * (0.2 + 1.6 * u[:, :k]), m0 * (2.0 * u[:, k:2 * k])
    else:
        cc, mc, pc = _split(centre[None, :], k)
        c, m = cc * (0.8 + 0.4 * u[:, :k]), mc * (0.8 + 0.4 * u[:, k:2 * k])
        p = 0.8 * pc + 0.2 * p
    base = np.full((k, k), 0.1) + np.eye(k) * 0.8
    base = base * mask
    start = np.concatenate([c0, m0, (base / base.sum(1, keepdims=True)).ravel()])
    cand = np.concatenate([np.concatenate([c, m, p.reshape(count, -1)], axis=1), start[None, :]])
    c, m, _ = _split(cand, k)
    if k == 2:
        ok = (c[:, 0] > c[:, 1]) & (m[:, 0] < m[:, 1])
    elif k == 3:
        ok = (np.diff(c, axis=1) < 0).all(1) & (np.diff(m, axis=1) > 0).all(1) & (m[:, 0] < 0) & (m[:, 2] > 0)
    else:
        ok = (c[:, 0] > c[:, 1]) & (c[:, 2] > c[:, 3]) & (m[:, 0] < 0) & (m[:, 1] > 0) & (m[:, 2] < 0) & (m[:, 3] > 0)
        ok &= (m[:, 0] + m[:, 1] < 0) & (m[:, 2] + m[:, 3] > 0)
    ok[-1] = True
    return cand[ok]


def regime_fit(df: DataFrame, k: int, value: str = "r", count: int = 1000) -> DataFrame:
    """Best candidate per series around the start values: (entity, c1.., m1.., p11.., loss).

    States are ordered by the constraints (high variance and low mean first); with four states the means of the two
    high-variance and the two low-variance states must on equal weights stay below and above zero.
    """
    return candidate_scan(df, [value], parameter_names(k), lambda rows, c: _candidates(rows[value].to_numpy(float), k, count, c),
                          lambda rows, c: _filter(rows[value].to_numpy(float), c, k)[0])


def smoothed_probabilities(df: DataFrame, params: DataFrame, k: int, value: str = "r") -> DataFrame:
    """(entity, idx, filtered1.., s1.., cmu, cs2, e): filtered and smoothed state probabilities, conditional mean and
    deviation, standardised residuals. A task holds one series; both passes are linear in its length."""
    names = parameter_names(k)

    def fn(entity, rows):
        x = rows[value].to_numpy(float)
        cand = rows[names].to_numpy(float)[:1]
        _, prob, kept = _filter(x, cand, k)
        prob, kept = prob[:, 0], kept[:, 0]
        c, m, p = (a[0] for a in _split(cand, k))
        s = np.empty_like(kept)
        s[-1] = kept[-1]
        for t in range(len(x) - 2, -1, -1):
            s[t] = kept[t] * (p @ np.divide(s[t + 1], prob[t + 1], out=np.zeros(k), where=prob[t + 1] > 0))
        cmu = prob @ m
        e = x - cmu
        out = {"idx": rows["idx"].to_numpy()}
        out.update({f"f{j + 1}": kept[:, j] for j in range(k)})
        out.update({f"s{j + 1}": s[:, j] for j in range(k)})
        out.update({"cmu": cmu, "cs2": prob @ np.sqrt(c), "e": (e - e.mean()) / e.std(ddof=1)})
        return out

    schema = "idx long, " + ", ".join(f"{a}{j + 1} double" for a in "fs" for j in range(k)) + ", cmu double, cs2 double, e double"
    return per_series(df.join(params.select("entity", *names), "entity"), [value, *names], fn, schema)


def durations(params: DataFrame, k: int) -> DataFrame:
    """Expected rows spent in each state."""
    return params.select("entity", *[F.round(1.0 / (1.0 - F.col(f"p{i}{i}")), 0).alias(f"duration{i}") for i in range(1, k + 1)])


def regime_indicators(smoothed: DataFrame, k: int) -> DataFrame:
    """Per date the mean (ap) and product (jp) over entities of the probability of high variance.

    With four states the first two are high. Entities without a value on a date do not enter the mean and count as
    1 in the product, which leaving them out does.
    """
    high = F.col("s1") + F.col("s2") if k == 4 else F.col("s1")
    return smoothed.groupBy("idx").agg(F.avg(high).alias("ap"), F.product(high).alias("jp"))
