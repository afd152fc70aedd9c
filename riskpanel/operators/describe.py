"""Descriptive statistics and distribution tests, one result row per series unless stated otherwise."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.order import quantile_hf5, quantile_hf5_over
from riskpanel.functions.scalar import chi2_sf, horner, norm_cdf, norm_inv, t_sf
from riskpanel.operators.ranks import positions


def corrected_skewness(value: str) -> Column:
    n = F.count(value)
    return F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2.0)


def corrected_kurtosis(value: str) -> Column:
    """Bias-corrected, not excess (3 for normal data)."""
    n = F.count(value).cast("double")
    return (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(value) + 6.0) + 3.0


def describe_returns(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("entity").agg(
        F.count(value).alias("n"), F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("std"),
        corrected_skewness(value).alias("skewness"), corrected_kurtosis(value).alias("kurtosis"))


def box_stats(df: DataFrame, value: str) -> DataFrame:
    """Quartiles and the outermost values within 1.5 interquartile ranges of them."""
    packed = df.groupBy("entity").agg(
        quantile_hf5(value, 0.25).alias("q1"), quantile_hf5(value, 0.5).alias("median"),
        quantile_hf5(value, 0.75).alias("q3"), F.collect_list(value).alias("_x"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low = F.array_min(F.filter("_x", lambda x: x >= F.col("q1") - reach))
    high = F.array_max(F.filter("_x", lambda x: x <= F.col("q3") + reach))
    return packed.withColumns({"adjacent_low": low, "adjacent_high": high}).drop("_x")


def histogram_pdf(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width density histogram between the extremes of each series."""
    w = Window.partitionBy("entity")
    width = (F.max(value).over(w) - F.min(value).over(w)) / bins
    slot = F.least(F.floor((F.col(value) - F.min(value).over(w)) / width), F.lit(bins - 1)).cast("int")
    placed = df.filter(F.col(value).isNotNull()).select(
        "entity", slot.alias("bin"), width.alias("width"), F.count(value).over(w).alias("n"))
    return placed.groupBy("entity", "bin", "width", "n").agg(F.count(F.lit(1)).alias("hits")).select(
        "entity", "bin", "hits", (F.col("hits") / (F.col("n") * F.col("width"))).alias("density"))


def kde_grid(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid reaching three bandwidths past the data.

    Bandwidth: median absolute deviation / 0.6745 times (4 / 3n)^(1/5). Every observation adds to every grid
    point, summed before the shuffle, so what moves is `points` rows per series and task.
    """
    w = Window.partitionBy("entity")
    x = df.filter(F.col(value).isNotNull()).withColumn("_med", F.percentile(value, F.lit(0.5)).over(w))
    x = x.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    x = x.withColumns({"_n": F.count(value).over(w), "_mad": F.percentile("_dev", F.lit(0.5)).over(w),
                       "_lo": F.min(value).over(w), "_hi": F.max(value).over(w)})
    x = x.withColumn("_h", F.col("_mad") / 0.6745 * F.pow(4.0 / (3.0 * F.col("_n")), F.lit(0.2)))
    x = x.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    lo, hi = F.col("_lo") - 3.0 * F.col("_h"), F.col("_hi") + 3.0 * F.col("_h")
    x = x.withColumn("at", lo + (hi - lo) * F.col("point") / (points - 1.0))
    z = (F.col("at") - F.col(value)) / F.col("_h")
    return x.groupBy("entity", "point").agg(
        F.first("at").alias("at"), (F.sum(F.exp(-0.5 * z * z)) / F.first(F.col("_n") * F.col("_h"))
                                    * 0.3989422804014327).alias("density"))


# Royston's normalising polynomials for the Shapiro tests, highest power first; the last
# coefficient of the two weight polynomials is the normal score of the row itself.
WEIGHT_LAST = (-2.7060560, 4.434685, -2.071190, -0.147981, 0.221157)
WEIGHT_SECOND = (-3.5826330, 5.682633, -1.752461, -0.293762, 0.042981)
SMALL_MEAN = (-0.0006714, 0.025054, -0.399780, 0.544000)
SMALL_SIGMA = (-0.0020322, 0.062767, -0.778570, 1.382200)
SMALL_GAMMA = (0.459, -2.273)
LARGE_MEAN = (0.0038915, -0.083751, -0.310820, -1.586100)
LARGE_SIGMA = (0.0030302, -0.082676, -0.480300)
FRANCIA_MEAN = (-1.27250, 1.05210)
FRANCIA_SIGMA = (1.03080, -0.26758)


def _scores(df: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("entity")
    ranked = df.filter(F.col(value).isNotNull()).select(
        "entity", F.col(value).alias("x"), F.row_number().over(w.orderBy(value)).alias("i"),
        F.count(value).over(w).alias("n"))
    return ranked.withColumn("m", norm_inv((F.col("i") - 0.375) / (F.col("n") + 0.25)))


def _sums(df: DataFrame, value: str) -> DataFrame:
    """One row per series: what both forms of the test read, and whether its kurtosis is above 3."""
    n, i, m, x = F.col("n"), F.col("i"), F.col("m"), F.col("x")
    edge = (i <= 2) | (i >= n - 1)
    return _scores(df, value).groupBy("entity").agg(
        F.first("n").alias("n"), F.sum(m * m).alias("mm"), (F.var_pop("x") * F.count("x")).alias("xx"), F.sum(m * x).alias("mx"),
        F.sum(F.when(~edge, m * x).otherwise(0.0)).alias("inner"), F.max("m").alias("ml"), F.max(F.when(i == n - 1, m)).alias("ms"),
        (F.max("x") - F.min("x")).alias("dl"), (F.max(F.when(i == n - 1, x)) - F.max(F.when(i == 2, x))).alias("ds"),
        (F.kurtosis("x") > 0).alias("heavy"))


def _francia() -> Column:
    k = F.col("mx") * F.col("mx") / (F.col("mm") * F.col("xx"))
    nu = F.ln("n")
    mean = FRANCIA_MEAN[0] + FRANCIA_MEAN[1] * (F.ln(nu) - nu)
    sigma = FRANCIA_SIGMA[0] + FRANCIA_SIGMA[1] * (F.ln(nu) + 2.0 / nu)
    return (F.ln(1.0 - k) - mean) / sigma


def _wilk() -> Column:
    n, mm, ml, ms = F.col("n"), F.col("mm"), F.col("ml"), F.col("ms")
    u = 1.0 / F.sqrt("n")
    norm = F.sqrt("mm")
    wl, ws = horner(u, WEIGHT_LAST) * u + ml / norm, horner(u, WEIGHT_SECOND) * u + ms / norm
    phi = (mm - 2 * ml ** 2 - 2 * ms ** 2) / (1 - 2 * wl ** 2 - 2 * ws ** 2)
    outer = (mm - 2 * ml ** 2) / (1 - 2 * wl ** 2)
    both = ws * F.col("ds") + F.col("inner") / F.sqrt(phi)
    total = wl * F.col("dl") + F.when(n > 5, both).otherwise((ms * F.col("ds") + F.col("inner")) / F.sqrt(outer))
    k = total * total / F.col("xx")
    ln = F.ln("n")
    small = (-F.ln(horner(n, SMALL_GAMMA) - F.ln(1.0 - k)) - horner(n, SMALL_MEAN)) / F.exp(horner(n, SMALL_SIGMA))
    large = (F.ln(1.0 - k) - horner(ln, LARGE_MEAN)) / F.exp(horner(ln, LARGE_SIGMA))
    return F.when(n <= 11, small).otherwise(large)


def shapiro_francia(df: DataFrame, value: str) -> DataFrame:
    out = _sums(df, value).withColumn("stat", _francia())
    return out.select("entity", "n", "stat", (1.0 - norm_cdf(F.col("stat"))).alias("p_value"))


def shapiro_wilk(df: DataFrame, value: str) -> DataFrame:
    """Series of at least 5 values; shorter ones give no row. With 5 only the outermost weights are corrected."""
    out = _sums(df, value).filter("n >= 5").withColumn("stat", _wilk())
    return out.select("entity", "n", "stat", (1.0 - norm_cdf(F.col("stat"))).alias("p_value"))


def shapiro_test(df: DataFrame, value: str, a: float = 0.05) -> DataFrame:
    """Francia form for series with kurtosis above 3, Wilk form for the others; both from one pass over the ranked values."""
    s = _sums(df, value).filter("entity is not null and (heavy or (not heavy and n >= 5))")
    out = s.withColumn("stat", F.when(F.col("heavy"), _francia()).otherwise(_wilk()))
    out = out.select("entity", "heavy", "n", "stat", (1.0 - norm_cdf(F.col("stat"))).alias("p_value"))
    return out.withColumn("rejected", F.col("p_value") <= a)


def ljung_box(df: DataFrame, value: str, lags: int = 20) -> DataFrame:
    """Portmanteau test on squared demeaned values: Q = n (n + 2) sum rho_k^2 / (n - k)."""
    w = Window.partitionBy("entity")
    e = df.withColumn("_e", F.pow(F.col(value) - F.avg(value).over(w), 2.0))
    e = e.withColumn("_d", F.col("_e") - F.avg("_e").over(w))
    order = w.orderBy("idx")
    e = e.withColumns({f"_l{k}": F.col("_d") * F.lag("_d", k).over(order) for k in range(1, lags + 1)})
    s = e.groupBy("entity").agg(F.count("_d").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("c0"),
                                *[F.sum(f"_l{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    terms = [F.pow(F.col(f"c{k}") / F.col("c0"), 2.0) / (F.col("n") - k) for k in range(1, lags + 1)]
    q = F.col("n") * (F.col("n") + 2.0) * reduce(Column.__add__, terms)
    return s.select("entity", "n", q.alias("stat"), chi2_sf(q, F.lit(float(lags))).alias("p_value"))


def arch_lm(df: DataFrame, value: str) -> DataFrame:
    """Observations times R-squared of squared demeaned values on their first lag."""
    w = Window.partitionBy("entity")
    e = df.withColumn("_e", F.pow(F.col(value) - F.avg(value).over(w), 2.0))
    e = e.withColumn("_p", F.lag("_e").over(w.orderBy("idx")))
    stat = F.regr_r2("_e", "_p") * F.regr_count("_e", "_p")
    out = e.groupBy("entity").agg(stat.alias("stat"))
    return out.withColumn("p_value", chi2_sf(F.col("stat"), F.lit(1.0)))


def corr_matrix(wide: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns with a t-test p-value: one aggregation over the rows."""
    pairs = list(combinations(cols, 2))
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(a, b).alias("r"),
                          F.count_if(both).alias("n")).alias(f"p{len(aggs)}")]
    row = wide.agg(*aggs)
    out = row.select(F.explode(F.array(*row.columns)).alias("p")).select("p.*")
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1.0 - F.col("r") * F.col("r")))
    return out.withColumn("p_value", 2.0 * t_sf(F.abs(t), (F.col("n") - 2).cast("double")))


def window_threshold(df: DataFrame, value: str, smoothed: str, bw: int, q: float = 0.75) -> DataFrame:
    """Quantile of the rows within bw of each row, and whether the smoothed series is above it."""
    frame = Window.partitionBy("entity").orderBy("idx").rowsBetween(-bw, bw)
    out = df.withColumn("threshold", quantile_hf5_over(value, q, frame))
    return out.withColumn("above", F.col(smoothed) > F.col("threshold"))


def three_sigma_filter(df: DataFrame, value: str) -> DataFrame:
    """Values further than three standard deviations from the mean go missing; the rest scales to 0.25..0.75."""
    w = Window.partitionBy("entity")
    far = F.abs(F.col(value) - F.avg(value).over(w)) > 3.0 * F.stddev_samp(value).over(w)
    out = df.withColumn("kept", F.when(~far, F.col(value)))
    lo, hi = F.min("kept").over(w), F.max("kept").over(w)
    return out.withColumn("rescaled", 0.25 + 0.5 * (F.col("kept") - lo) / F.when(hi > lo, hi - lo))


def rank_table(df: DataFrame, value: str, label: str = "entity") -> DataFrame:
    """Descending rank, ties broken by label; the input has one row per label."""
    return positions(df, [F.desc(value), F.asc(label)], "position")


def threshold_matrix(edges: DataFrame, value: str, limit: float, inclusive: bool = False) -> DataFrame:
    hit = F.col(value) >= limit if inclusive else F.col(value) > limit
    return edges.withColumn("flag", F.when(F.col("src") != F.col("dst"), hit.cast("int")))
