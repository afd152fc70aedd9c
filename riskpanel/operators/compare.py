"""Comparison of indicators: similarity, causality, crisis prediction, price discovery and the overall score.

Input is one wide row per date (idx, one column per indicator). Pairs of indicators are built as array columns of
that row, so nothing is joined; a pair's task holds one value pair per calendar period.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.scalar import f_inv
from riskpanel.operators.gram import explained, from_sums, gram_sums
from riskpanel.session import cut_lineage


def standardise(wide: DataFrame, cols: list[str], cutoff: int = 1) -> DataFrame:
    """Population z-scores of all rows from `cutoff` on: one aggregation, joined back as a scalar."""
    kept = wide.filter(F.col("idx") >= cutoff)
    stats = kept.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).alias("z")).scalar()
    out = kept.withColumn("_z", stats)
    score = lambda c: F.coalesce((F.col(c) - F.col(f"_z.{c}.m")) / F.when(F.col(f"_z.{c}.s") > 0, F.col(f"_z.{c}.s")), F.lit(0.0))
    return out.withColumns({c: score(c) for c in cols}).drop("_z")


def pair_rows(wide: DataFrame, cols: list[str]) -> DataFrame:
    """(left, right, idx, x, y) for every unordered pair, in the order of `cols`."""
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(cols, 2)]
    return wide.select("idx", F.explode(F.array(*pairs)).alias("p")).select("p.left", "p.right", "idx", "p.x", "p.y")


def _per_pair(pairs: DataFrame, fn, schema: str) -> DataFrame:
    def task(key, pdf):
        pdf = pdf.sort_values("idx")
        return pd.DataFrame([[*key, *fn(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))]],
                            columns=["left", "right", *[c.split()[0] for c in schema.split(",")]])

    return pairs.groupBy("left", "right").applyInPandas(task, f"left string, right string, {schema}")


def _row_means(x: np.ndarray) -> np.ndarray:
    """Mean distance of each value to all, from one sort."""
    n, order = len(x), np.argsort(x, kind="stable")
    s, k = x[order], np.arange(len(x))
    below = np.cumsum(s) - s
    out = np.empty(n)
    out[order] = (s * (2 * k - n + 1) + s.sum() - s - 2 * below) / n
    return out


def _concordant(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of (x_j - x_i)(y_j - y_i) over i < j with y_i < y_j, for x in ascending order.

    The levels of a binary indexed tree, each for all positions at once: at level k the right half of every run of 2^(k+1)
    positions meets the left half, in the order of y, through running sums. t log t in all.
    """
    n, total = len(x), 0.0
    by_y = np.argsort(y, kind="stable")
    for level in range(max(n - 1, 0).bit_length()):
        at = by_y[np.argsort(by_y >> (level + 1), kind="stable")]
        run, right = at >> (level + 1), (at >> level & 1).astype(bool)
        left = ~right
        starts = np.searchsorted(run, run)
        u, v = x[at], y[at]
        sums = [np.cumsum(np.r_[0.0, np.where(left, w, 0.0)]) for w in (np.ones(n), u, v, u * v)]
        count, sx, sy, sxy = (s[np.arange(n)] - s[starts] for s in sums)
        total += (u * v * count - u * sy - v * sx + sxy)[right].sum()
    return total


def distance_correlation(pairs: DataFrame) -> DataFrame:
    """Distance correlation per pair, in t log t steps for t rows: sums of distances from sorted values and running sums."""

    def fn(x, y):
        n = len(x)
        order = np.argsort(x, kind="stable")
        x, y = x[order] - x.mean(), y[order] - y.mean()
        ma, mb = _row_means(x), _row_means(y)
        aa, bb = 2.0 * n * (x * x).sum() - 2.0 * x.sum() ** 2, 2.0 * n * (y * y).sum() - 2.0 * y.sum() ** 2
        ab = 2.0 * (2.0 * _concordant(x, y) - (n * (x * y).sum() - x.sum() * y.sum()))

        def centred(s, u, v):
            return s / n ** 2 - 2.0 * (u * v).mean() + u.mean() * v.mean()

        va, vb = centred(aa, ma, ma), centred(bb, mb, mb)
        v = np.sqrt(np.sqrt(max(va, 0.0)) * np.sqrt(max(vb, 0.0)))
        return [np.sqrt(max(centred(ab, ma, mb), 0.0)) / v if v > 0 else 0.0]

    return _per_pair(pairs, fn, "dcor double")


def rms_similarity(pairs: DataFrame) -> DataFrame:
    size = F.abs("x") + F.abs("y")
    s = 1.0 - F.abs(F.col("x") - F.col("y")) / F.when(size > 0, size)
    return pairs.groupBy("left", "right").agg(F.sqrt(F.avg(s * s)).alias("rmss"))


#: Penalty of one more parameter, by criterion, as a function of the rows used.
PENALTY = {"AIC": lambda n: 2.0, "BIC": np.log, "HQIC": lambda n: 2.0 * np.log(np.log(n))}


def _history(pairs: DataFrame, behind: int, ahead: int = 0) -> DataFrame:
    """Each row with the values of both series from `behind` rows back to `ahead` rows on, newest first; whole frames only."""
    frame = Window.partitionBy("left", "right").orderBy("idx").rowsBetween(-behind, ahead)
    rows = pairs.withColumns({c: F.reverse(F.collect_list(c).over(frame)) for c in ("x", "y")})
    return rows.filter(F.size("x") == behind + ahead + 1)


def granger_ftest(pairs: DataFrame, a: float = 0.01, lag_max: int = 10, kind: str = "AIC") -> DataFrame:
    """Does y help to explain x beyond its own lags? Lags by criterion, all fits on the rows after lag_max.

    One pass gathers the products of the constant, x and its lags, and the lags of y; all fits are nested in that matrix.
    The denominator degrees of freedom are rows - lag_r + lag_u + 1, as the measure defines them.
    """
    rows = _history(pairs, lag_max).withColumn("v", F.concat(F.array(F.lit(1.0)), "x", F.slice("y", 2, lag_max)))
    own, other = list(range(2, 2 + lag_max)), list(range(2 + lag_max, 2 + 2 * lag_max))

    def fit(g):
        n = g[0, 0]

        def cost(sse, size):
            if kind == "FPE":
                return n * np.log(sse / n) + np.log((n + size + 1) / (n - size - 1))
            return n * np.log(sse / n) + PENALTY[kind](n) * size

        def shortest(fixed, more):
            left = [explained(g, fixed + more[:m], [1])[1][0, 0] for m in range(1, lag_max + 1)]
            at = int(np.argmin([cost(sse, len(fixed) + m) for m, sse in enumerate(left, 1)]))
            return at + 1, left[at]

        lag_r, alone = shortest([0], own)
        lag_u, both = shortest([0, *own[:lag_r]], other)
        df = int(n) - lag_r + lag_u + 1
        return [max(alone - both, 0.0) / lag_u / (both / df), lag_r, lag_u, df]

    out = from_sums(gram_sums(rows.select("left", "right", "idx", "v"), ["left", "right"]), ["left", "right"], fit,
                    "stat double, lag_r int, lag_u int, df int")
    cv = f_inv(F.lit(1.0 - a), F.col("lag_u").cast("double"), F.col("df").cast("double"))
    return out.withColumn("cv", cv).withColumn("rejected", F.col("stat") > F.col("cv"))


def _rescaled(points: DataFrame) -> DataFrame:
    """Scores stretched to 0..100 and rounded to 2 digits; all-zero scores stay."""
    ends = points.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"), F.max(F.abs("score")).alias("top")).alias("e")).scalar()
    out = points.withColumn("_e", ends)
    span = F.col("_e.hi") - F.col("_e.lo")
    return out.withColumn("score", F.when(F.col("_e.top") == 0, 0.0).otherwise(
        F.round((F.col("score") - F.col("_e.lo")) / F.when(span > 0, span) * 100.0, 2))).drop("_e")


def _points(pairs: DataFrame, left: Column) -> DataFrame:
    """Sum +-1 per indicator; the right one gets the opposite of the left one."""
    p = pairs.withColumn("_p", left)
    ends = p.select(F.col("left").alias("label"), F.col("_p").alias("score")).unionByName(
        p.select(F.col("right").alias("label"), (-F.col("_p")).alias("score")))
    return ends.groupBy("label").agg(F.sum("score").cast("double").alias("score"))


def gc_scores(tests: DataFrame) -> DataFrame:
    """A rejected pair takes a point from the left indicator (it is caused) and gives one to the right."""
    return _rescaled(_points(tests, -F.col("rejected").cast("int")))


def pd_scores(discovery: DataFrame) -> DataFrame:
    """The indicator with the larger share of price discovery wins the pair."""
    return _rescaled(_points(discovery, F.when(F.col("m1") > 0.5, 1).when(F.col("m2") > 0.5, -1).otherwise(0)))


def tournament(values: DataFrame, value: str) -> DataFrame:
    """Wins less losses of each label against all others, with a relative tie tolerance, rescaled.

    There is one value per indicator, so all of them travel as one small array to every row.
    """
    every = values.agg(F.collect_list(value).alias("v")).scalar()
    x = values.withColumn("_all", every)

    def tolerance(b):
        low = F.least(F.abs(F.col(value)), F.abs(b))
        return F.when(low > 0, 1e4 * F.pow(F.lit(2.0), F.floor(F.log2(low)) - 52.0)).otherwise(0.0)

    wins = F.size(F.filter("_all", lambda b: F.col(value) > b + tolerance(b)))
    losses = F.size(F.filter("_all", lambda b: b > F.col(value) + tolerance(b)))
    return _rescaled(x.select("label", (wins - losses).cast("double").alias("score")))


def _stacked(wide: DataFrame, cols: list[str], dummy: str, *more: str) -> DataFrame:
    """(label, x, y, ...): one row for each indicator of each row, without nulls; written once, since fits read it many times."""
    rows = wide.select(F.col(dummy).cast("double").alias("y"), *more, F.explode(F.array(
        *[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("x")) for c in cols])).alias("_s"))
    return cut_lineage(rows.select("_s.label", "_s.x", "y", *more).filter(F.col("x").isNotNull() & F.col("y").isNotNull()))


def logit_fits(rows: DataFrame, label: str = "label", rounds: int = 100, tol: float = 1e-10) -> DataFrame:
    """(label, level, slope, ll, empty, n): a logistic regression of y on x for each label, all in the same Newton rounds.

    A round is one aggregate: the sums of the gradient, the curvature and the likelihood of every label, summed before the
    shuffle. The coefficients, two a label, come back with the next round. A step that lowers the likelihood is halved. A
    label is done when the likelihood stands still within `tol`; one that is not done after `rounds` has null values.
    Labels with one class only have null values. x is taken in units of its own mean and deviation meanwhile.
    """
    spark = rows.sparkSession
    shape = rows.groupBy(label).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("y").alias("share"), F.count("*").alias("n")).collect()
    state = {r[label]: {"b": np.zeros(2), "step": np.zeros(2), "ll": -np.inf, "m": r["m"], "s": r["s"] or 1.0, "share": r["share"], "n": r["n"]}
             for r in shape if 0.0 < r["share"] < 1.0}
    todo = set(state)
    for _ in range(rounds):
        if not todo:
            break
        now = spark.createDataFrame([(k, float(state[k]["m"]), float(state[k]["s"]), *map(float, state[k]["b"])) for k in sorted(todo)],
                                    f"{label} string, m double, s double, b0 double, b1 double")
        z = rows.join(now, label).withColumn("z", (F.col("x") - F.col("m")) / F.col("s")).withColumn("t", F.col("b0") + F.col("b1") * F.col("z"))
        z = z.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("t")))).withColumn("w", F.col("p") * (1.0 - F.col("p")))
        # ln(1 + e^t) without overflow
        soft = F.greatest("t", F.lit(0.0)) + F.log1p(F.exp(-F.abs("t")))
        sums = z.groupBy(label).agg(F.sum(F.col("y") * F.col("t") - soft), F.sum(F.col("y") - F.col("p")), F.sum((F.col("y") - F.col("p")) * F.col("z")),
                                    F.sum("w"), F.sum(F.col("w") * F.col("z")), F.sum(F.col("w") * F.col("z") * F.col("z")))
        for key, ll, g0, g1, h00, h01, h11 in sums.collect():
            own = state[key]
            near = tol * max(1.0, abs(ll))
            if ll < own["ll"] - near:
                own["step"] = own["step"] / 2
                own["b"] = own["b"] - own["step"]
                continue
            still, own["ll"], own["best"] = abs(ll - own["ll"]) <= near, ll, own["b"]
            det = h00 * h11 - h01 * h01
            if still or not det > 1e-300:
                todo.discard(key)
                continue
            own["step"] = np.array([h11 * g0 - h01 * g1, h00 * g1 - h01 * g0]) / det
            own["b"] = own["b"] + own["step"]
    out = []
    for key, own in state.items():
        if key not in todo:
            slope = own["best"][1] / own["s"]
            m = own["share"]
            out.append((key, float(own["best"][0] - slope * own["m"]), float(slope), float(own["ll"]),
                        float(own["n"] * (m * np.log(m) + (1 - m) * np.log(1 - m))), int(own["n"])))
    fits = spark.createDataFrame(out, f"{label} string, level double, slope double, ll double, empty double, n long")
    return spark.createDataFrame([(r[label],) for r in shape], f"{label} string").join(fits, label, "left")


def logit_mcfadden(wide: DataFrame, cols: list[str], dummy: str, adjusted: bool = False) -> DataFrame:
    """(label, r2): pseudo R-squared of a logistic regression of the crisis dummy on each indicator, fitted together."""
    fits = logit_fits(_stacked(wide, cols, dummy))
    return fits.select("label", (1.0 - (F.col("ll") - (2.0 if adjusted else 0.0)) / F.col("empty")).alias("r2"))


def bin_sums(rows: DataFrame, bins: int = 128) -> DataFrame:
    """(label, fold, bin, n, s, q): rows, sum and sum of squares of y in the quantile bins of each label's x.

    Cuts are quantiles of all rows of the label, at most `bins` - 1 distinct ones; a value is in the bin of the first cut
    that is not below it. So the result has at most labels x folds x bins rows, whatever the number of rows.
    """
    at = [i / bins for i in range(1, bins)]
    cuts = rows.groupBy("label").agg(F.array_distinct(F.percentile_approx("x", F.array(*map(F.lit, at)), F.lit(100 * bins))).alias("cuts"))
    place = rows.join(cuts, "label").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    return place.groupBy("label", "fold", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))


def tree_leaves(n: np.ndarray, s: np.ndarray, depth: int = 8, least: int = 5) -> np.ndarray:
    """The prediction for each bin of a regression tree on one variable, from rows and sums of y by bin in order.

    A node is cut where the squared error falls most, if it falls, with at least `least` rows on each side.
    """
    out = np.full(len(n), s.sum() / max(n.sum(), 1))
    nodes = [(0, len(n), depth)]
    while nodes:
        lo, hi, left = nodes.pop()
        rows, total = n[lo:hi].sum(), s[lo:hi].sum()
        if rows:
            out[lo:hi] = total / rows
        if not left or hi - lo < 2:
            continue
        a, b = np.cumsum(n[lo:hi])[:-1], np.cumsum(s[lo:hi])[:-1]
        fits = (a >= least) & (rows - a >= least)
        if not fits.any():
            continue
        gain = np.where(fits, b * b / np.maximum(a, 1) + (total - b) ** 2 / np.maximum(rows - a, 1) - total * total / rows, -np.inf)
        cut = int(np.argmax(gain))
        if gain[cut] > 1e-12:
            nodes += [(lo, lo + cut + 1, left - 1), (lo + cut + 1, hi, left - 1)]
    return out


def predictive_power(wide: DataFrame, cols: list[str], dummy: str, folds: int = 4) -> DataFrame:
    """(label, pps): 1 - cross-validated loss of a regression tree over the loss of the median, floored at 0.

    Folds hash the row number. One aggregate gathers sums by (indicator, fold, quantile bin); trees and their losses
    follow from these sums, of which an indicator has at most folds x bins. The loss is the mean of the folds' losses.
    """
    rows = _stacked(wide.withColumn("fold", F.pmod(F.xxhash64("idx"), F.lit(folds))), cols, dummy, "fold")

    def losses(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["bin"].max()) + 1
        sums = np.zeros((3, folds, size))
        for i, name in enumerate(("n", "s", "q")):
            sums[i, part["fold"].to_numpy(int), part["bin"].to_numpy(int)] = part[name].to_numpy(float)
        found = []
        for fold in range(folds):
            own, rest = sums[:, fold], sums[:, np.arange(folds) != fold].sum(axis=1)
            if own[0].sum() and rest[0].sum():
                leaf = tree_leaves(rest[0], rest[1])
                found.append((own[2] - 2.0 * leaf * own[1] + leaf * leaf * own[0]).sum() / own[0].sum())
        return pd.DataFrame({"label": [part["label"].iloc[0]], "loss": [float(np.mean(found)) if found else None]})

    loss = bin_sums(rows).groupBy("label").applyInPandas(losses, "label string, loss double")
    # the median m and the mean square about it, from one aggregate
    base = rows.groupBy("label").agg(F.percentile("y", F.lit(0.5)).alias("m"), F.avg("y").alias("a"), F.avg(F.col("y") * F.col("y")).alias("q"))
    base = base.select("label", (F.col("q") - 2.0 * F.col("m") * F.col("a") + F.col("m") * F.col("m")).alias("base"))
    share = F.when((F.col("base") > 0) & (F.col("loss") <= F.col("base")), 1.0 - F.col("loss") / F.col("base")).otherwise(0.0)
    return loss.join(base, "label").select("label", share.alias("pps"))


def autoregression_lag(pairs: DataFrame, lag_max: int, kind: str) -> DataFrame:
    """(left, right, lag): order of the joint autoregression with intercept and trend that minimises the criterion."""
    rows = _history(pairs, lag_max).withColumn("v", F.concat(F.array(F.lit(1.0), F.col("idx").cast("double")), "x", "y"))
    x, y = 2, 3 + lag_max

    def fit(g):
        n = g[0, 0]
        costs = []
        for m in range(1, lag_max + 1):
            on = [0, 1, *range(x + 1, x + 1 + m), *range(y + 1, y + 1 + m)]
            spread = np.linalg.det(explained(g, on, [x, y])[1] / n)
            if kind == "FPE":
                costs.append(((n + len(on)) / (n - len(on))) ** 2 * spread)
            else:
                costs.append(np.log(spread) + PENALTY[kind](n) / n * 4 * (m + 1))
        return [int(np.argmin(costs)) + 1]

    return from_sums(gram_sums(rows.select("left", "right", "idx", "v"), ["left", "right"]), ["left", "right"], fit, "lag int")


def price_discovery(pairs: DataFrame, kind: str = "GG", lag_max: int = 10, criterion_kind: str = "AIC") -> DataFrame:
    """(m1, m2): shares of the common trend from a two-variable error-correction model.

    The order is that of `autoregression_lag`. As the measure defines it, a difference is explained by the equilibrium
    error `lag` rows on and by the lag - 1 differences after it. Differences and errors are linear in the values of
    neighbouring rows, so the products of those values are all that is gathered.
    """
    keys = ["left", "right"]
    lags = autoregression_lag(pairs, lag_max, criterion_kind)
    line = pairs.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("level"))
    frame = Window.partitionBy(*keys).orderBy("idx").rowsBetween(0, lag_max + 1)
    rows = pairs.withColumns({c: F.collect_list(c).over(frame) for c in ("x", "y")}).join(lags, keys).filter(F.size("x") >= F.col("lag") + 2).join(line, keys)
    step = lambda c: F.transform(F.sequence(F.lit(1), F.col("lag")), lambda i: F.get(F.col(c), i) - F.get(F.col(c), i - 1))
    gap = F.get("y", F.col("lag") + 1) - F.col("level") - F.col("slope") * F.get("x", F.col("lag") + 1)
    v = F.concat(F.array(F.lit(1.0), gap), step("x"), step("y"))

    def fit(g):
        lag = (len(g) - 2) // 2
        now, rest = [2, 2 + lag], [i for i in range(2, 2 + 2 * lag) if i not in (2, 2 + lag)]
        root, left = explained(g, [0, 1, *rest], now)
        pull = root[1]
        if kind == "GG":
            share = abs(pull[0]) / np.abs(pull).sum()
        else:
            sd, cross = np.sqrt(np.diag(left)), left[0, 1]
            rho = cross / sd.prod()
            first = (pull[0] * rho * sd[1] - pull[1] * sd[0]) ** 2
            share = first / (first + pull[0] ** 2 * sd[1] ** 2 * (1.0 - rho * rho))
        share = float(np.clip(share, 0.0, 1.0))
        return [share, 1.0 - share, lag]

    return from_sums(gram_sums(rows.select(*keys, "idx", v.alias("v")), keys), keys, fit, "m1 double, m2 double, lag int")


def overall_score(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of the scores of the enabled models, rounded to 2 digits."""
    total = sum(w for _, w in parts)
    rows = None
    for df, w in parts:
        one = df.select("label", (F.col("score") * (w / total)).alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("label").agg(F.round(F.sum("score"), 2).alias("score"))
