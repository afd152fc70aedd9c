"""Panel transforms: returns, rolling windows, smoothing, filling, scaling, portfolios."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.scalar import clip, finite, half_up


def series():
    """Window over one series in calendar order."""
    return Window.partitionBy("entity").orderBy("idx")


def whole():
    return Window.partitionBy("entity")


def log_returns(panel: DataFrame, price: str = "price") -> DataFrame:
    """Log return `r`; non-finite becomes 0, the first row goes, idx restarts at 1."""
    step = F.ln(F.col(price)) - F.ln(F.lag(price).over(series()))
    return (panel.withColumn("r", step).filter(F.col("idx") > 1)
            .withColumn("r", F.when(finite(F.col("r")), F.col("r")).otherwise(0.0))
            .withColumn("idx", F.col("idx") - 1))


def cds_to_decimal(df: DataFrame, cols: list[str], basis: float = 10000.0) -> DataFrame:
    return df.withColumns({c: F.col(c) / basis for c in cols})


def liabilities(balance: DataFrame) -> DataFrame:
    return balance.withColumn("liabilities", F.col("assets") - F.col("equity"))


def clamp_crisis_bounds(crises: DataFrame, calendar: DataFrame) -> DataFrame:
    lo, hi = calendar.select("lo").scalar(), calendar.select("hi").scalar()
    return crises.select("name", F.greatest("start_date", lo).alias("start_date"),
                         F.least("end_date", hi).alias("end_date"))


def detect_distress(df: DataFrame, tests: dict[str, Column], threshold: float = 0.05) -> DataFrame:
    """First row of the trailing run on which a test holds up to the last row.

    The run counts when it is at least round(t * threshold) long; the earliest run over all tests wins.
    `tests` maps a series name to a boolean column.
    """
    runs = df.groupBy("entity").agg(
        F.max("idx").alias("t"),
        *[F.coalesce(F.max(F.when(~hit, F.col("idx"))), F.lit(0)).alias(f"last_{k}") for k, hit in tests.items()])
    need = F.greatest(F.floor(F.col("t") * threshold + 0.5), F.lit(1))
    starts = [F.when(F.col("t") - F.col(f"last_{k}") >= need, F.col(f"last_{k}") + 1) for k in tests]
    first = F.least(*starts) if len(starts) > 1 else starts[0]
    return runs.select("entity", first.cast("bigint").alias("distress_idx"))


def mask_distress(df: DataFrame, distress: DataFrame, cols: list[str]) -> DataFrame:
    joined = df.join(distress, "entity", "left")
    gone = F.col("idx") >= F.col("distress_idx")
    return joined.withColumns({c: F.when(gone, None).otherwise(F.col(c)) for c in cols}).drop("distress_idx")


def masked_returns(returns: DataFrame, distress: DataFrame) -> DataFrame:
    """Returns with `r` missing from the row of distress on. Panels start one row before their returns, so the row is one less.

    Measures take a series with a missing return in its window as absent from that window.
    """
    return mask_distress(returns, distress.withColumn("distress_idx", F.col("distress_idx") - 1), ["r"])


def select_series(panel: DataFrame, names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in panel.columns]
    if unknown or not names:
        raise ValueError(f"unknown or missing series: {unknown}")
    return panel.select("entity", "date", "idx", *names)


def head_rows(bw: int) -> int:
    """Rows the first windows look at: the k-th window stands in for the ones before it."""
    return max(half_up(bw ** (1 / 1.81)), 5)


def rolling(df: DataFrame, bw: int, truncate: bool = False, keys: tuple = ("entity",), **aggs: Column) -> DataFrame:
    """Rolling aggregates over the last `bw` rows of each series.

    Full mode follows the head rule: windows before row k use rows 1..k. With `truncate` only full
    windows are kept. A series of at most `bw` rows has one window in either mode, at its last row, and it holds all rows.
    The head value comes from the same partitioning, so there is one shuffle.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    whole = Window.partitionBy(*keys)
    out = df.withColumns({name: agg.over(order.rowsBetween(1 - bw, 0)) for name, agg in aggs.items()})
    out = out.withColumn("_t", F.max("idx").over(whole))
    if truncate:
        return out.filter((F.col("idx") >= bw) | (F.col("idx") == F.col("_t"))).drop("_t")
    k = head_rows(bw)
    head = {n: F.when((F.col("idx") < k) & (F.col("_t") > bw), F.max(F.when(F.col("idx") == k, F.col(n))).over(whole)).otherwise(F.col(n))
            for n in aggs}
    return out.withColumns(head).filter((F.col("_t") > bw) | (F.col("idx") == F.col("_t"))).drop("_t")


def window_bounds(df: DataFrame, bw: int) -> DataFrame:
    """(idx, lo, hi) of every window of the calendar; a calendar of at most `bw` rows has one, which holds all of it."""
    k = head_rows(bw)
    last = df.agg(F.max("idx").alias("t")).scalar()
    days = df.select("idx").distinct().withColumn("t", last).filter((F.col("t") > bw) | (F.col("idx") == F.col("t")))
    return days.select("idx", F.greatest(F.col("idx") - bw + 1, F.lit(1)).alias("lo"),
                       F.when(F.col("t") <= bw, F.col("t")).otherwise(F.greatest("idx", F.lit(k))).alias("hi"))


def forward_roll(df: DataFrame, value: str, fr: int) -> DataFrame:
    """Hold the value of every fr-th month's first row until the next such month; fr = 0 keeps the data."""
    if fr == 0:
        return df.withColumn("rolled", F.col(value))
    by_month = Window.partitionBy("entity").orderBy("month")
    block = Window.partitionBy("entity", "block").orderBy("idx")
    return (df.withColumn("month", F.trunc("date", "month"))
            .withColumn("block", F.floor((F.dense_rank().over(by_month) - 1) / fr))
            .withColumn("rolled", F.first(value).over(block)).drop("month", "block"))


def fill_gaps(df: DataFrame, value: str, keys: tuple = ("entity",)) -> DataFrame:
    """Ends take the nearest value, the interior is linear in the row distance."""
    w = Window.partitionBy(*keys).orderBy("idx")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("idx"))
    out = df.withColumns({
        "_pv": F.last(value, ignorenulls=True).over(back), "_pi": F.last(at, ignorenulls=True).over(back),
        "_nv": F.first(value, ignorenulls=True).over(ahead), "_ni": F.first(at, ignorenulls=True).over(ahead)})
    mid = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("idx") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    filled = (F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_pv").isNull(), F.col("_nv"))
              .when(F.col("_nv").isNull(), F.col("_pv")).otherwise(mid))
    return out.withColumn(value, filled).drop("_pv", "_pi", "_nv", "_ni")


# Fixed value: -1 / (sqrt(2) * erfcinv(1.5)), which makes the MAD consistent for normal data.
MAD_SCALE = 1.482602218505602


def mad_outliers(df: DataFrame, value: str, w: int) -> DataFrame:
    """Replace values further than 3 scaled MADs from the moving median, then refill as gaps.

    With k = w // 2 the window of row i is rows i-k .. i-k+w, cut at the ends, and 1 .. i+k for the first
    k rows. A task holds one series, bounded by the calendar, and takes the medians of all its windows at once.
    """
    k = w // 2

    def flags(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = pdf[value].to_numpy(float)
        padded = np.concatenate([np.full(k, np.nan), x, np.full(w - k, np.nan)])
        frames = np.lib.stride_tricks.sliding_window_view(padded, w + 1).copy()
        if w % 2:
            frames[pdf["idx"].to_numpy() <= k, -1] = np.nan
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            middle = np.nanmedian(frames, axis=1)
            spread = np.nanmedian(np.abs(frames - middle[:, None]), axis=1) * MAD_SCALE
        return pd.DataFrame({"entity": pdf["entity"], "idx": pdf["idx"], "is_outlier": np.abs(x - middle) > 3.0 * spread})

    found = df.select("entity", "idx", value).groupBy("entity").applyInPandas(flags, "entity string, idx long, is_outlier boolean")
    out = df.join(found, ["entity", "idx"])
    out = out.withColumn(value, F.when(~F.col("is_outlier"), F.col(value)))
    return fill_gaps(out, value)


def smooth(df: DataFrame, value: str, s: int = 21, keys: tuple = ("entity",), name: str = "smoothed") -> DataFrame:
    """Centred moving average of odd width; the window shrinks symmetrically at the ends, missing stays missing."""
    h = ((s if s % 2 else s - 1) - 1) // 2
    w = Window.partitionBy(*keys).orderBy("idx")
    out = df.withColumns({
        "_win": F.collect_list(F.struct(F.col(value).alias("x"))).over(w.rowsBetween(-h, h)),
        "_left": F.least(F.row_number().over(w) - 1, F.lit(h)),
        "_half": F.least(F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(w), F.lit(h))})
    inner = F.slice("_win", (F.col("_left") - F.col("_half") + 1).cast("int"), (2 * F.col("_half") + 1).cast("int"))
    out = out.withColumn("_win", F.filter(inner, lambda e: e["x"].isNotNull()))
    total = F.aggregate("_win", F.lit(0.0), lambda acc, e: acc + e["x"])
    return out.withColumn(name, F.when(F.col(value).isNotNull(), total / F.size("_win"))).drop("_win", "_left", "_half")


#: Rows whose results a fold gathers before it starts a new array.
FOLD = 48


def fold_series(df: DataFrame, cols: list[str], zero, merge, name: str, keys: tuple = ("entity",),
                kind: str = "double") -> DataFrame:
    """Run a recursion along each series on the JVM.

    The series is gathered as one ordered array per key (at most one element per calendar period), folded
    with `aggregate`, and unfolded to rows again. `merge(acc, row)` returns the new state; the state must
    be a struct with an array field `out` that collects the results.
    """
    row = F.struct("idx", *cols)
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    zero_col = zero(F.col("_rows")) if callable(zero) else zero
    none = F.array().cast(f"array<{kind}>")
    # an array grows by copying, so results are gathered per run of FOLD rows and the runs joined once at the end
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / FOLD).cast("int")), lambda i: F.slice("_rows", i * FOLD + 1, F.lit(FOLD)))
    packed = packed.withColumn("_runs", runs).withColumn("_state", F.aggregate(
        "_runs", F.struct(zero_col.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("done")),
        lambda acc, run: F.struct(F.aggregate(run, acc["s"].withField("out", none), merge).alias("s"), F.concat(acc["done"], F.array(acc["s"]["out"])).alias("done"))))
    out = F.flatten(F.concat(F.col("_state.done"), F.array(F.col("_state.s.out"))))
    folded = packed.select(*keys, F.arrays_zip(F.col("_rows.idx").alias("idx"), out.alias("v")).alias("_z"))
    return folded.select(*keys, F.explode("_z").alias("_e")).select(
        *keys, F.col("_e.idx").alias("idx"), F.col("_e.v").alias(name))


def ewma(df: DataFrame, value: str, bw: int, keys: tuple = ("entity",), name: str = "ewma") -> DataFrame:
    """y1 = x1, y = a x + (1 - a) y with a = 2 / (bw + 1). Returns (keys, idx, name)."""
    a = 2.0 / (bw + 1)
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        y = F.coalesce(a * x[value] + (1 - a) * acc["y"], x[value])
        return F.struct(y.alias("y"), F.concat(acc["out"], F.array(y)).alias("out"))

    return fold_series(df, [value], zero, step, name, keys)


def minmax_norm(df: DataFrame, value: str, name: str = "scaled", keys: tuple = ("entity",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, (F.col(value) - lo) / F.when(hi > lo, hi - lo))


def zscore(df: DataFrame, value: str, cutoff: int = 1, keys: tuple = ("entity",)) -> DataFrame:
    """Population z-score of the rows from `cutoff` on; undefined scores become 0."""
    w = Window.partitionBy(*keys)
    s = F.stddev_pop(value).over(w)
    return df.filter(F.col("idx") >= cutoff).withColumn(
        "z", F.coalesce((F.col(value) - F.avg(value).over(w)) / F.when(s > 0, s), F.lit(0.0)))


def equal_weight_portfolio(df: DataFrame, value: str = "r", name: str = "rp") -> DataFrame:
    return df.groupBy("date", "idx").agg(F.avg(value).alias(name))


def cap_weighted_average(df: DataFrame, value: str, cap: str = "cap", floor: bool = True,
                         name: str = "weighted") -> DataFrame:
    """Per date sum of value * weight, weight = cap share; one aggregation, as the share's total factors out."""
    c = F.greatest(F.col(cap), F.lit(0.0)) if floor else F.col(cap)
    return df.groupBy("date", "idx").agg((F.sum(F.col(value) * c) / F.sum(cap)).alias(name))


def group_aggregate(df: DataFrame, entity_group: DataFrame) -> DataFrame:
    """Means and totals per group, with total liabilities where the rows have `lb`; entities without a group are one group with
    a null name."""
    totals = [F.sum(c).alias(c) for c in ("cap", "lb") if c in df.columns]
    return df.join(entity_group, "entity", "left").groupBy("date", "idx", "short_name").agg(
        F.avg("r").alias("r"), F.avg("cds").alias("cds"), *totals)


def mean_impute(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(whole())))


def pct_change(df: DataFrame, value: str) -> DataFrame:
    prev = F.lag(value).over(series())
    return df.withColumn("pct", F.coalesce(100.0 * (F.col(value) / prev - 1.0), F.lit(0.0)))


def adjust_liabilities(df: DataFrame, sf: float = 0.40, fr: int = 3) -> DataFrame:
    """Liabilities net of separate accounts, at spot (`lb`) and forward-rolled (`lbr`)."""
    out = df.withColumn("lb", F.col("liabilities") - (1.0 - sf) * F.col("separate_accounts"))
    return forward_roll(out, "lb", fr).withColumnRenamed("rolled", "lbr")


def step_dates(df: DataFrame, bws: int) -> DataFrame:
    """Rows 1, 1 + bws, ... and the last one."""
    last = df.agg(F.max("idx").alias("t")).scalar()
    return df.withColumn("_last", last).filter(((F.col("idx") - 1) % bws == 0) | (F.col("idx") == F.col("_last"))).drop("_last")


def age_weighted_sum(df: DataFrame, value: str, bw: int, lam: float = 0.98) -> DataFrame:
    """Window sum with weights (1 - l) / (1 - l^t) * l^age, age 0 = newest of the t <= bw rows present."""
    k = head_rows(bw)
    frame = series().rowsBetween(1 - bw, 0)
    out = df.withColumn("_pairs", F.collect_list(value).over(frame))
    size = F.size("_pairs")
    weight_norm = (1.0 - lam) / (1.0 - F.pow(F.lit(lam), size))
    total = F.aggregate("_pairs", F.lit(0.0), lambda acc, x: acc * lam + x)
    out = out.withColumn("weighted", total * weight_norm).drop("_pairs")
    head = F.max(F.when(F.col("idx") == k, F.col("weighted"))).over(whole())
    return out.withColumn("weighted", F.when(F.col("idx") < k, head).otherwise(F.col("weighted")))


def rank_topbottom(df: DataFrame, value: str, k: int = 3) -> DataFrame:
    """Per date the k largest and k smallest entities.

    Each of 16 hash slices of a date keeps its own k largest and smallest first, so no task ever sorts a
    whole cross-section; the final ranking then works on at most 32 k rows per date.
    """
    out = df
    for part in (("date", "slice"), ("date",)):
        if "slice" in part:
            out = out.withColumn("slice", F.pmod(F.xxhash64("entity"), F.lit(16)))
        top = Window.partitionBy(*part).orderBy(F.desc(value), "entity")
        low = Window.partitionBy(*part).orderBy(F.asc(value), "entity")
        out = out.withColumns({"top_rank": F.row_number().over(top), "low_rank": F.row_number().over(low)}).filter(
            (F.col("top_rank") <= k) | (F.col("low_rank") <= k))
    return out.drop("slice")


def portfolio_coverage(selected: DataFrame) -> DataFrame:
    """How often each entity was selected, scaled by the most selected one."""
    counts = selected.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("m")).scalar()
    return counts.withColumn("coverage", F.col("n") / top)


def magnitude(df: DataFrame, r: str = "r", v: str = "volume") -> DataFrame:
    """One row: the power of ten that brings |r| / v near one."""
    lr, lv = (F.floor(F.round(F.log10(F.when(F.abs(F.col(c)) > 0, F.abs(F.col(c)))), 15)) for c in (r, v))
    e = F.floor(F.abs(F.avg(lr)) + 0.5) + F.round(F.avg(lv), 0)
    return df.agg(F.pow(F.lit(10.0), e).alias("magnitude"))



def explode_windows(df: DataFrame, value: str, bw: int, keys: tuple = ("entity",)) -> DataFrame:
    """Rows of every window, for order statistics a frame cannot express: (keys, idx, pos, t, value).

    `pos` runs from 1 (oldest) to t. Each series row is copied bw times, map-side; head rule as in `rolling`.
    """
    k = head_rows(bw)
    one = F.lit(1).cast("bigint")
    rows = df.select(*keys, F.col("idx").alias("at"), value)
    inside = rows.withColumn("idx", F.explode(F.sequence(F.col("at"), F.col("at") + bw - 1)))
    early = rows.filter(F.col("at") <= k).withColumn("idx", F.explode(F.sequence(one, one * (k - 1)))).filter("at > idx")
    last = df.agg(F.max("idx").alias("m")).scalar()
    both = inside.unionByName(early).withColumn("last", last).filter("idx <= last").drop("last")
    w = Window.partitionBy(*keys, "idx")
    return both.withColumn("pos", F.row_number().over(w.orderBy("at"))).withColumn(
        "t", F.count(F.lit(1)).over(w)).drop("at")
