"""Grouped evaluation of one whole series per task, and the shared parameter scan.

A series holds at most one row per calendar period (the panel is aggregated first), so a group is bounded by
the calendar, not by the raw data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.scalar import HART_DEN, HART_NUM, horner


def per_series(df: DataFrame, cols: list[str], fn: Callable[[str, pd.DataFrame], dict], schema: str) -> DataFrame:
    """Apply `fn(entity, rows in calendar order)` to each series; it returns the columns of `schema` but entity."""
    names = [c.split()[0] for c in schema.split(",")]

    def task(pdf):
        pdf = pdf.sort_values("idx")
        entity = pdf["entity"].iloc[0]
        out = pd.DataFrame(fn(entity, pdf))
        out["entity"] = entity
        return out[["entity", *names]]

    return df.select("entity", "idx", *cols).groupBy("entity").applyInPandas(task, f"entity string, {schema}")


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Same rational form as the column expression, on arrays."""
    a = np.minimum(np.abs(x), 37.0)
    body = np.exp(-0.5 * a * a)
    far = body / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = np.where(a < 7.07106781186547, body * horner(a, HART_NUM) / horner(a, HART_DEN), far)
    return np.where(x > 0, 1 - tail, tail)


def halton(count: int, lo: list[float], hi: list[float]) -> np.ndarray:
    """First `count` Halton points in a box, one prime base per dimension."""
    primes = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53)
    cols = []
    for base in primes[:len(lo)]:
        i, scale, v = np.arange(1, count + 1), 1.0 / base, np.zeros(count)
        while i.any():
            v += scale * (i % base)
            i, scale = i // base, scale / base
        cols.append(v)
    return np.asarray(lo) + np.stack(cols, 1) * (np.asarray(hi) - np.asarray(lo))


def _scan_task(names, propose, loss, slices, first):
    def task(key, pdf):
        pdf = pdf.sort_values("idx")
        centre = None if first else pdf[[f"c_{n}" for n in names]].iloc[0].to_numpy()
        cand = propose(pdf, centre)[int(key[1])::slices]
        if not first:
            cand = np.vstack([centre, cand])
        with np.errstate(all="ignore"):
            value = loss(pdf, cand)
        value = np.where(np.isfinite(value), value, np.inf)
        k = int(np.argmin(value))
        found = [[key[0], *cand[k], value[k]]] if np.isfinite(value[k]) else []
        return pd.DataFrame(found, columns=["entity", *names, "loss"])

    return task


def candidate_scan(df: DataFrame, cols: list[str], names: list[str], propose: Callable, loss: Callable,
                   slices: int = 4, rounds: int = 2) -> DataFrame:
    """Best parameters per series over a deterministic candidate set: (entity, names..., loss).

    `propose(rows, centre)` gives the candidates of a series (centre None on the first round, then the best so
    far, for a shrunken box); `loss(rows, candidates)` evaluates all of them at once, vectorised over candidates.
    Work is keyed by (series, slice of the candidates), so a few long series still use many tasks; the best of
    the slices is a min_by. The result is the best candidate, not a local optimum of the loss.
    """
    schema = "entity string, " + ", ".join(f"{n} double" for n in names) + ", loss double"
    best = None
    for r in range(rounds):
        rows = df.select("entity", "idx", *cols)
        if best is not None:
            rows = rows.join(best.drop("loss").withColumnsRenamed({n: f"c_{n}" for n in names}), "entity")
        rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        task = _scan_task(names, propose, loss, slices, first=best is None)
        tried = rows.groupBy("entity", "slice").applyInPandas(task, schema)
        best = tried.groupBy("entity").agg(F.min_by(F.struct(*names), "loss").alias("p"), F.min("loss").alias("loss")).select(
            "entity", *[F.col(f"p.{n}") for n in names], "loss")
    return best
