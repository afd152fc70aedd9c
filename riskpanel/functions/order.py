"""Quantiles, tied ranks and information criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_hf5_array(sorted_values: Column, p: float) -> Column:
    """Hyndman-Fan definition 5 on an ascending array: position n*p + 0.5, clamped to the ends."""
    n = F.size(sorted_values)
    pos = F.least(F.greatest(n * F.lit(p) + 0.5, F.lit(1.0)), n.cast("double"))
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, n)
    frac = pos - lo
    low, high = F.element_at(sorted_values, lo), F.element_at(sorted_values, hi)
    return F.when(n > 0, low + frac * (high - low))


def quantile_hf5(value: str, p: float) -> Column:
    """Aggregate form, exact: the group is one panel series, so it is bounded by the calendar."""
    return quantile_hf5_array(F.array_sort(F.collect_list(value)), p)


def quantile_hf5_over(value: str, p: float, frame) -> Column:
    return quantile_hf5_array(F.array_sort(F.collect_list(value).over(frame)), p)


def quantile_hf7(value, p: float) -> Column:
    """Definition 7 is what `percentile` computes."""
    return F.percentile(value, F.lit(p))


def tied_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Average rank of ties inside each group."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def criterion(kind: str, sse: Column, k: Column, d: Column) -> Column:
    """Regression criterion from k observations, d coefficients and the residual sum of squares."""
    fit = k * F.ln(sse / k)
    if kind == "AIC":
        return fit + 2.0 * d
    if kind == "BIC":
        return fit + F.ln(k) * d
    if kind == "FPE":
        return fit + F.ln((k + d + 1.0) / (k - d - 1.0))
    if kind == "HQIC":
        return fit + 2.0 * F.ln(F.ln(k)) * d
    raise ValueError(f"unknown criterion {kind}")
