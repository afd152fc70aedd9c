"""Joint default probabilities of small portfolios from marginal ones, by minimum cross entropy.

A portfolio has n <= 10 members in slots 0..n-1; a state is an n-bit number, bit = member in default. Tables are
keyed by (portfolio, idx), so all portfolios and dates are computed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.functions.scalar import norm_inv
from riskpanel.operators.transforms import age_weighted_sum, explode_windows, rolling
from riskpanel.session import cut_lineage

KEYS = ["portfolio", "idx"]


def pods(panel: DataFrame, bw: int, divisor: float = 0.4, weighted: bool = True) -> DataFrame:
    """Marginal default probability per entity and window: spread / divisor, averaged plainly or by age."""
    base = panel.select("entity", "idx", (F.col("cds") / divisor).alias("x"))
    if weighted:
        return age_weighted_sum(base, "x", bw).select("entity", "idx", F.col("weighted").alias("pod"))
    return rolling(base, bw, pod=F.avg("x")).select("entity", "idx", "pod")


def orthants(spark, n: int) -> DataFrame:
    """The 2^n states with the number of defaults in each."""
    return spark.range(2 ** n).select(F.col("id").alias("state"), F.bit_count("id").alias("defaults"))


def members(chosen: DataFrame) -> DataFrame:
    """Give the members of each (portfolio, idx) slots in name order."""
    from pyspark.sql import Window
    w = Window.partitionBy(*KEYS).orderBy("entity")
    return chosen.select(*KEYS, "entity").withColumn("slot", F.row_number().over(w) - 1)


def orthant_prior(returns: DataFrame, member: DataFrame, pod: DataFrame, bw: int, n: int) -> DataFrame:
    """Share of window rows in each state, a member being in default when its standardised return exceeds
    the normal quantile of 1 - pod; one extra observation is spread evenly over the states."""
    rows = explode_windows(returns, "r", bw)
    stats = rolling(returns.select("entity", "idx", "r"), bw, mu=F.avg("r"), sd=F.stddev_samp("r")).select("entity", "idx", "mu", "sd")
    level = pod.join(stats, ["entity", "idx"]).select(
        "entity", "idx", (F.col("mu") + F.col("sd") * norm_inv(1.0 - F.col("pod"))).alias("level"))
    used = member.join(level, ["entity", "idx"])
    hits = rows.join(used, ["entity", "idx"]).select(*KEYS, "pos", "t", F.when(
        F.col("r") > F.col("level"), F.expr("shiftleft(1L, slot)")).otherwise(F.lit(0).cast("long")).alias("bit"))
    state = hits.groupBy(*KEYS, "pos", "t").agg(F.sum("bit").alias("state"))
    seen = state.groupBy(*KEYS, "t", "state").agg(F.count(F.lit(1)).alias("c"))
    table = seen.groupBy(*KEYS, "t").agg(F.map_from_entries(F.collect_list(F.struct("state", "c"))).alias("m"))
    full = table.select(*KEYS, "t", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 ** n - 1).cast("long"))).alias("state"))
    p = (F.coalesce(F.try_element_at("m", F.col("state")), F.lit(0)) + 1.0 / 2 ** n) / (F.col("t") + 1.0)
    return full.select(*KEYS, "state", p.alias("p"))


def min_xent_posterior(prior: DataFrame, member: DataFrame, pod: DataFrame, n: int, sweeps: int = 5000, tolerance: float = 1e-13) -> DataFrame:
    """Nearest distribution to the prior, in relative entropy, whose marginals are the pods.

    Iterative proportional fitting: each sweep rescales the two halves of the table per member. A table is one
    array of 2^n numbers, so portfolios are fitted independently, many per Arrow batch, without a shuffle. A batch is done
    when no state moves by `tolerance` in a sweep; a table that still moves after `sweeps` gets nulls.
    """
    tables = prior.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("state", "p"))).alias("s"))
    marg = member.join(pod, ["entity", "idx"]).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("slot", "pod"))).alias("m"))
    both = tables.join(marg, KEYS).select(*KEYS, F.col("s.p").alias("p"), F.col("m.pod").alias("pods"))
    bits = ((np.arange(2 ** n)[:, None] >> np.arange(n)) & 1).astype(bool)

    def fit(batches: Iterator[pd.DataFrame]):
        for b in batches:
            p, target = np.stack(b["p"].to_numpy()), np.stack(b["pods"].to_numpy())
            for _ in range(sweeps):
                before = p
                for j in range(n):
                    m = p[:, bits[:, j]].sum(1)
                    up, down = target[:, j] / m, (1.0 - target[:, j]) / (1.0 - m)
                    p = p * np.where(bits[:, j], up[:, None], down[:, None])
                p = p / p.sum(1, keepdims=True)
                moved = np.abs(p - before).max(1)
                if moved.max() < tolerance:
                    break
            p[moved >= tolerance] = np.nan
            yield b[KEYS].assign(p=list(p))

    schema = T.StructType([prior.schema[k] for k in KEYS] + [T.StructField("p", T.ArrayType(T.DoubleType()))])
    fitted = both.mapInPandas(fit, schema)
    return fitted.select(*KEYS, F.posexplode("p").alias("state", "p")).withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def _has(slot) -> Column:
    return F.expr(f"(shiftright(cast(state as bigint), {slot}) & 1) = 1")


def joint_indicators(states: DataFrame, member: DataFrame, pod: DataFrame, n: int) -> DataFrame:
    """Per portfolio and date: jpod (all default), fsi (expected defaults given one), pce (a second given one)."""
    k = F.bit_count("state")
    agg = states.groupBy(*KEYS).agg(
        F.sum(F.when(k == n, F.col("p"))).alias("jpod"), F.sum(F.when(k == 0, F.col("p"))).alias("p0"),
        F.sum(F.when(k >= 2, F.col("p"))).alias("p2"), F.sum(F.when(k >= 1, F.col("p"))).alias("p1"))
    total = member.join(pod, ["entity", "idx"]).groupBy(*KEYS).agg(F.sum("pod").alias("sum_pod"))
    out = agg.join(total, KEYS)
    fsi = F.least(F.greatest(F.col("sum_pod") / (1.0 - F.col("p0")), F.lit(1.0)), F.lit(float(n)))
    return out.select(*KEYS, "jpod", fsi.alias("fsi"), (F.col("p2") / F.col("p1")).alias("pce"))


def distress_dependence(states: DataFrame, member: DataFrame, pod: DataFrame) -> DataFrame:
    """DiDe: probability that exactly src and dst default over the pod of dst; 1 on the diagonal.

    States with two defaults carry both slots, so the pair table needs no join of members with each other.
    """
    two = states.filter(F.bit_count("state") == 2)
    low = F.expr("cast(log2(cast(state & -state as double)) + 0.5 as int)")
    two = two.withColumn("a", low).withColumn("b", F.expr("cast(log2(cast(state & (state - 1) as double)) + 0.5 as int)"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    pairs = two.select(*KEYS, "p", ends.alias("e")).select(*KEYS, "p", "e.i", "e.j")
    named = member.join(pod, ["entity", "idx"]).select(*KEYS, "slot", "entity", "pod")
    src = named.select(*KEYS, F.col("slot").alias("i"), F.col("entity").alias("src"), F.col("pod").alias("pod_src"))
    dst = named.select(*KEYS, F.col("slot").alias("j"), F.col("entity").alias("dst"), F.col("pod").alias("pod_dst"))
    off = pairs.join(src, KEYS + ["i"]).join(dst, KEYS + ["j"]).select(
        *KEYS, "src", "dst", "pod_src", (F.col("p") / F.col("pod_dst")).alias("dide"))
    diag = named.select(*KEYS, F.col("entity").alias("src"), F.col("entity").alias("dst"), F.col("pod").alias("pod_src"), F.lit(1.0).alias("dide"))
    return off.unionByName(diag)


def systemic_impact(dide: DataFrame) -> DataFrame:
    """SI (row sums) and SV (column sums) of the off-diagonal DiDe times the row pod."""
    off = dide.filter("src <> dst").withColumn("v", F.col("dide") * F.col("pod_src"))
    ends = off.select(*KEYS, F.col("src").alias("entity"), F.col("v").alias("si"), F.lit(0.0).alias("sv")).unionByName(
        off.select(*KEYS, F.col("dst").alias("entity"), F.lit(0.0).alias("si"), F.col("v").alias("sv")))
    return ends.groupBy(*KEYS, "entity").agg(F.sum("si").alias("si"), F.sum("sv").alias("sv"))


def cojpods(joint: DataFrame, member: DataFrame, pod: DataFrame) -> DataFrame:
    """Probability that all default given that one member does."""
    return member.join(pod, ["entity", "idx"]).join(joint, KEYS).select(*KEYS, "entity", (F.col("jpod") / F.col("pod")).alias("cojpod"))


def average_over_portfolios(joint: DataFrame) -> DataFrame:
    return joint.groupBy("idx").agg(F.avg("jpod").alias("jpod"), F.avg("fsi").alias("fsi"), F.avg("pce").alias("pce"))


def average_dide(dide: DataFrame) -> DataFrame:
    """Mean DiDe of each pair over all portfolios and dates it appears in."""
    return dide.groupBy("src", "dst").agg(F.avg("dide").alias("dide"))


def scaled_impact(impact: DataFrame) -> DataFrame:
    """SI and SV on a common 0..1 scale over the whole sample."""
    base = cut_lineage(impact)
    ends = base.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in ("si", "sv") for n, f in (("lo", F.min), ("hi", F.max))]).alias("e"))
    out = base.withColumn("e", ends.scalar())
    for c in ("si", "sv"):
        lo, hi = F.col(f"e.lo_{c}"), F.col(f"e.hi_{c}")
        out = out.withColumn(c, (F.col(c) - lo) / F.when(hi > lo, hi - lo))
    return out.drop("e")
