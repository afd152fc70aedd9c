"""Sums of products per key, from which every nested least-squares fit on the same rows follows.

Rows carry their regressors and targets as one array. Partial sums are taken per key and run of periods, so a key is never
held whole; what leaves a task is one square matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods of one partial sum.
RUN = 4096


def gram_sums(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(keys, part, size, sums): the matrix of summed products of `vector`, row by row, per key and run of periods."""
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf[vector].to_numpy())
        return pd.DataFrame([[*pdf.iloc[0][[*keys, "part"]], v.shape[1], (v.T @ v).ravel()]], columns=[*keys, "part", "size", "sums"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.withColumn("part", F.floor(F.col("idx") / RUN)).groupBy(*keys, "part").applyInPandas(
        task, f"{schema}, part long, size int, sums array<double>")


def from_sums(sums: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """One result row per key from its whole matrix: `work(matrix)` gives the values of `schema`."""
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["size"].iloc[0])
        whole = np.sum(np.stack(pdf["sums"].to_numpy()), axis=0).reshape(n, n)
        return pd.DataFrame([[*pdf.iloc[0][keys], *work(whole)]], columns=[*keys, *[c.split()[0] for c in schema.split(",")]])

    kinds = dict(sums.dtypes)
    return sums.groupBy(*keys).applyInPandas(task, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {schema}")


def explained(g: np.ndarray, on: list[int], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the targets `of` on the regressors `on`, and the residuals' summed products."""
    a, b = g[np.ix_(on, on)], g[np.ix_(on, of)]
    scale = 1.0 / np.sqrt(np.diag(a))
    root = np.linalg.lstsq(a * scale[:, None] * scale, b * scale[:, None], rcond=None)[0] * scale[:, None]
    return root, g[np.ix_(of, of)] - b.T @ root
