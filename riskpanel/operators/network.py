"""Causality networks: edges per window, connectedness ratios and node centralities.

A graph is an edge table (idx, src, dst); `idx` names the graph, so every function works on all dates at once.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.scalar import half_up
from riskpanel.operators.blocks import Block, pair_blocks, pair_sums
from riskpanel.operators.krylov import dominant_vectors, resolvents
from riskpanel.session import cut_lineage, passing_tables

EDGE = "idx long, src string, dst string"
#: Source nodes of a graph whose shortest paths are followed at a time.
BATCH = 256
#: Entities of a bucket where pairs are only counted, at most about, and those of them that are tested at a time.
WIDE = 16384
SIDE = 512
#: Windows of a task there, at least: its rows reach back before the first of them, so few of them would carry the most.
RUN = 96
#: Pairs whose regressions are held at a time.
PAIRS = 4096
#: Scores that are this close to their limit are settled by regression, and so are residuals and angles below the other.
CLOSE = 1e-9
VAGUE = 1e-3
#: Single precision leaves pairs open whose pasts have less than this left of a square of 1, and may leave so many of all.
FLAT = 1 / 64
OPEN = 1 / 256


def _regression(y, o, i):
    """Columns of y on (o, i) without intercept: coefficient of i, residuals, and the inverse Gram parts."""
    oo, ii, oi, oy, iy = (o * o).sum(0), (i * i).sum(0), (o * i).sum(0), (o * y).sum(0), (i * y).sum(0)
    det = oo * ii - oi * oi
    with np.errstate(all="ignore"):
        b1, b2 = (ii * oy - oi * iy) / det, (oo * iy - oi * oy) / det
    return b2, y - b1 * o - b2 * i, oo, ii, oi, det


def _row_counts(found: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.packbits(found, axis=1)).sum(axis=1, dtype=np.int64)


def _column_counts(found: np.ndarray) -> np.ndarray:
    """Eight columns at a time, as bytes of one number, over as few rows as cannot overflow a byte."""
    rows, columns = found.shape
    wide = np.ascontiguousarray(np.pad(found, ((0, 0), (0, -columns % 8)))).view(np.uint64) if columns % 8 or not found.flags.c_contiguous else found.view(np.uint64)
    return sum((wide[k:k + 255].sum(axis=0).view(np.uint8)[:columns].astype(np.int64) for k in range(0, rows, 255)), np.zeros(columns, dtype=np.int64))


def _tested(x: np.ndarray, src: np.ndarray, dst: np.ndarray, cut: float, robust: bool) -> np.ndarray:
    """Whether column src of the window helps to explain column dst, pair by pair."""
    t = len(x)
    whole = ~(np.isnan(x[:, src]).any(0) | np.isnan(x[:, dst]).any(0))
    y, o, i = x[1:, dst], x[:-1, dst], x[:-1, src]
    b, e, oo, ii, oi, det = _regression(y, o, i)
    with np.errstate(all="ignore"):
        if robust:
            ho, hi_ = e * o, e * i
            m = t - 1
            s_oo, s_ii, s_oi = (ho * ho).sum(0) / m, (hi_ * hi_).sum(0) / m, (ho * hi_).sum(0) / m
            lags = half_up(0.1 * m)
            for k in range(1, lags):
                wk = (lags - k) / lags / (m - k)
                s_oo = s_oo + 2 * wk * (ho[:-k] * ho[k:]).sum(0)
                s_ii = s_ii + 2 * wk * (hi_[:-k] * hi_[k:]).sum(0)
                s_oi = s_oi + wk * ((ho[:-k] * hi_[k:]).sum(0) + (hi_[:-k] * ho[k:]).sum(0))
            u, v = -oi * m / det, oo * m / det
            stat = b / np.sqrt((u * u * s_oo + 2 * u * v * s_oi + v * v * s_ii) / m)
        else:
            stat = b / np.sqrt((e * e).sum(0) / (t - 3) * oo / det)
    return whole & (stat > cut)


def _settled(x: np.ndarray, found: np.ndarray, at: np.ndarray, to: np.ndarray, rows: np.ndarray, cols: np.ndarray, cut: float, back: bool, robust: bool = False) -> None:
    """The open pairs (at, to) of `found` by their own regressions, some at a time."""
    for k in range(0, len(at), PAIRS):
        a, b = rows[at[k:k + PAIRS]], cols[to[k:k + PAIRS]]
        found[at[k:k + PAIRS], to[k:k + PAIRS]] = _tested(x, b, a, cut, robust) if back else _tested(x, a, b, cut, robust)


class _Window:
    """The rows of one window: which of its series help to explain which.

    With unit vectors o of a series' past and e of what its own past leaves of it, and a the product of two pasts, the test
    reads i'e > sqrt(k - k a^2), k = cut^2 / (t - 3 + cut^2): two products of matrices for all pairs. Pairs that are closer
    to the limit than rounding can tell, or nearly collinear, get regressions of their own; those of equal series, never
    an edge, do not. Numbers are of single precision first, with the limits its rounding calls for; where that leaves many
    pairs open, double precision judges them.
    """

    def __init__(self, block: Block, lo: int, hi: int, cut: float, robust: bool):
        self.block, self.x, self.cut, self.robust = block, block.x[lo:hi], cut, robust
        t = len(self.x)
        self.plain, self.short = robust or cut <= 0, t <= 3
        if self.plain or self.short:
            return
        self.k = cut * cut / (t - 3 + cut * cut)
        n, unit = self.x.shape[1], 2.0 ** -24
        self.past, self.rest, self.vague = np.empty((t - 1, n)), np.empty((t - 1, n)), np.empty(n, dtype=bool)
        for at in range(0, n, PAIRS):
            self._unit_vectors(slice(at, at + PAIRS))
        self.past *= self.k ** 0.25
        self.rest *= self.k ** -0.25
        self.rough = self.past.astype(np.float32), self.rest.astype(np.float32)
        # a product is off by t units at most, and the root of what a square of 1 leaves by that over the least of it
        self.rough_close = 1.5 * (1 + (self.k / FLAT) ** 0.5) * (t + 4) * unit

    def _unit_vectors(self, some: slice) -> None:
        x = self.x[:, some]
        fine = np.isfinite(x).all(0)
        past, now = np.where(fine, x[:-1], 0.0), np.where(fine, x[1:], 0.0)
        with np.errstate(all="ignore"):
            past = np.nan_to_num(past / np.sqrt((past * past).sum(0)), posinf=0.0, neginf=0.0)
            now = np.nan_to_num(now / np.sqrt((now * now).sum(0)), posinf=0.0, neginf=0.0)
            rest = now - past * (past * now).sum(0)
            size = np.sqrt((rest * rest).sum(0))
            vague = (size < VAGUE) & now.any(0) & past.any(0)
            rest = np.nan_to_num(rest / size, posinf=0.0, neginf=0.0)
        rest[:, ~past.any(0)] = 0.0  # without a past there is no regression
        self.past[:, some], self.rest[:, some], self.vague[some] = past, rest, vague

    def links(self, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(left, right) matrices: whether left helps to explain right, and right left; `same` where both are one."""
        x, cut = self.x, self.cut
        none = np.zeros((len(left), len(right)), dtype=bool)
        if self.plain:
            every = ~np.eye(len(left), dtype=bool) if same else ~none
            found = [none, none.copy()]
            for back in range(1 if same else 2):
                _settled(x, found[back], *np.nonzero(every), left, right, cut, bool(back), self.robust)
            return found[0], found[0].T if same else found[1]
        if self.short:
            return none, none
        found = self._judged(left, right, same, *self.rough, FLAT, self.rough_close, OPEN)
        found = found or self._judged(left, right, same, self.past, self.rest, VAGUE * VAGUE, CLOSE, 1.0)
        return found[0], found[0].T if same else found[1]

    def _judged(self, left, right, same: bool, past: np.ndarray, rest: np.ndarray, flat: float, close: float, most: float) -> list[np.ndarray] | None:
        """One matrix, or two where the sides differ; none if more than the share `most` of the pairs is open."""
        block, k = self.block, self.k
        past_a, past_b, rest_b = past[:, left], past[:, right], rest[:, right]
        limit = past_a.T @ past_b
        limit *= limit
        near = ()
        if limit.max(initial=0.0) > k * (1 - flat):
            near = self._unlike(limit > k * (1 - flat), left, right)
            np.minimum(limit, k, out=limit)
        np.subtract(k, limit, out=limit)
        np.sqrt(limit, out=limit)
        found = []
        for back in range(1 if same else 2):
            score = rest[:, left].T @ past_b if back else past_a.T @ rest_b
            score -= limit
            sure, maybe = score > close, score > -close
            open_ = self._unlike(maybe ^ sure, left, right) if np.count_nonzero(maybe) > np.count_nonzero(sure) else ()
            if sum(len(pairs[0]) for pairs in (near, open_) if pairs) > max(most * sure.size, len(left)) and most < 1:
                return None
            weak = self.vague[left][:, None] if back else self.vague[right][None]
            weak = np.nonzero(np.broadcast_to(weak, sure.shape)) if weak.any() else ()
            for pairs in (near, open_, weak):
                if pairs:
                    _settled(self.x, sure, *pairs, left, right, self.cut, bool(back))
            if same:
                np.fill_diagonal(sure, False)
            found.append(sure)
        return found

    def _unlike(self, pairs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the matrix holds, without pairs of equal series."""
        bits = np.packbits(pairs)  # few of many hold: bytes with any are found first
        some = np.flatnonzero(bits)
        byte, bit = np.nonzero(np.unpackbits(bits[some, None], axis=1))
        at, to = np.divmod(some[byte] * 8 + bit, pairs.shape[1])
        keep = self.block.alike[left[at]] != self.block.alike[right[to]]
        return at[keep], to[keep]


def _links(block: Block, lo: int, hi: int, cut: float, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a window, (left, right) matrices of a whole block."""
    return _Window(block, lo, hi, cut, robust).links(block.left, block.right, block.same)


def _counts(block: Block, lo: int, hi: int, cut: float, robust: bool, grouped: bool) -> np.ndarray:
    """Of a window, by entity: edges out, edges in, those out with a counterpart and those out into another group.

    Sides of `SIDE` entities are tested at a time, so a block of any size holds few matrices.
    """
    window, left, right = _Window(block, lo, hi, cut, robust), block.left, block.right
    out = np.zeros((4, len(block.names)), dtype=np.int32)
    for at in range(0, len(left), SIDE):
        for by in range(at if block.same else 0, len(right), SIDE):
            a, b, same = left[at:at + SIDE], right[by:by + SIDE], block.same and at == by
            to, back = window.links(a, b, same)
            both = to & back
            out[0, a] += _row_counts(to)
            out[1, a] += _row_counts(back)
            out[2, a] += _row_counts(both)
            if not same:
                out[0, b] += _column_counts(back)
                out[1, b] += _column_counts(to)
                out[2, b] += _column_counts(both)
            if grouped:
                far = block.groups[a][:, None] != block.groups[b][None]
                out[3, a] += _row_counts(to & far)
                if not same:
                    out[3, b] += _column_counts(back & far)
    return out


def causal_edges(returns: DataFrame, bw: int, sst: float = 0.05, robust: bool = False) -> DataFrame:
    """Edge src -> dst when the lag of src helps to explain dst beyond its own lag (one-sided normal test).

    Per window: dst_t on dst_{t-1}, src_{t-1}, no intercept. Series with a gap in the window have no edges.
    With `robust` the variance is the Bartlett sandwich with round(0.1 t) lags.
    """
    cut = NormalDist().inv_cdf(1.0 - sst)

    def kernel(block):
        out = []
        for w, lo, hi in block.windows:
            to, back = _links(block, lo, hi, cut, robust)
            (i, j), (m, n) = np.nonzero(to), np.nonzero(back[:, :0] if block.same else back)
            src, dst = np.concatenate([block.left[i], block.right[n]]), np.concatenate([block.right[j], block.left[m]])
            out.append(block.edges(w, src, dst, slice(None)))
        return out

    return pair_blocks(returns, "r", bw, kernel, EDGE)


def causal_degrees(returns: DataFrame, bw: int, sst: float = 0.05, robust: bool = False, entity_group: DataFrame | None = None) -> DataFrame:
    """(idx, entity, deg_out, deg_in, mutual, cross_out) of the graphs of `causal_edges`, summed inside the tasks: no edge leaves one.

    `mutual` counts the edges out of a node that have a counterpart, `cross_out` those into another group, where entities
    outside all groups form a group of their own. A node without edges has no row.
    """
    cut = NormalDist().inv_cdf(1.0 - sst)
    rows, grouped = returns.select("entity", "idx", "r"), entity_group is not None
    if grouped:
        named = entity_group.select("entity", F.concat(F.lit("="), "short_name").alias("_group"))
        rows = rows.join(named, "entity", "left").withColumn("_group", F.coalesce("_group", F.lit("")))

    def kernel(block, w, lo, hi):
        return _counts(block, lo, hi, cut, robust, grouped)

    names = dict.fromkeys(("deg_out", "deg_in", "mutual", "cross_out"), "long")
    return pair_sums(rows, "r", bw, kernel, names, block=WIDE, chunk=RUN, label="_group" if grouped else None)


def connectedness(edges: DataFrame, entities: DataFrame, dates: DataFrame, entity_group: DataFrame | None = None) -> DataFrame:
    """Per date: dci = edges / (n^2 - n), cio = edges / (n - 1), cioo = cross-group edges / n.

    Entities outside all groups form a group of their own.
    """
    e = edges
    cross = F.lit(None).cast("int")
    if entity_group is not None:
        g = entity_group.select("entity", "short_name")
        e = e.join(g.withColumnsRenamed({"entity": "src", "short_name": "g1"}), "src", "left").join(
            g.withColumnsRenamed({"entity": "dst", "short_name": "g2"}), "dst", "left")
        cross = (~F.col("g1").eqNullSafe(F.col("g2"))).cast("int")
    counts = e.groupBy("idx").agg(F.count(F.lit(1)).alias("edges"), F.sum(cross).alias("cross"))
    return _shares(counts, entities, dates, entity_group is not None)


def connectedness_sums(degrees: DataFrame, entities: DataFrame, dates: DataFrame, grouped: bool = False) -> DataFrame:
    """As `connectedness`, from `causal_degrees`; `grouped` where these were given groups."""
    cross = F.sum("cross_out") if grouped else F.lit(None).cast("long")
    counts = degrees.groupBy("idx").agg(F.sum("deg_out").alias("edges"), cross.alias("cross"))
    return _shares(counts, entities, dates, grouped)


def _shares(counts: DataFrame, entities: DataFrame, dates: DataFrame, grouped: bool) -> DataFrame:
    n = entities.select("entity").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    out = dates.join(counts, "idx", "left").withColumn("n", n)
    out = out.withColumns({"edges": F.coalesce("edges", F.lit(0)),
                           "cross": F.coalesce("cross", F.lit(0 if grouped else None).cast("int"))})
    return out.withColumns({"dci": F.col("edges") / (F.col("n") * F.col("n") - F.col("n")),
                            "cio": F.col("edges") / (F.col("n") - 1), "cioo": F.col("cross") / F.col("n")})


def _one_way(edges: DataFrame) -> DataFrame:
    """Per graph the number of edges without a counterpart; 0 marks a symmetric graph."""
    back = edges.select("idx", F.col("dst").alias("src"), F.col("src").alias("dst"))
    odd = edges.join(back, ["idx", "src", "dst"], "left_anti").groupBy("idx").agg(F.count(F.lit(1)).alias("odd"))
    return edges.select("idx").distinct().join(odd, "idx", "left").select("idx", (F.col("odd").isNull()).alias("symmetric"))


def degrees(edges: DataFrame, n: int | None = None, entities: DataFrame | None = None) -> DataFrame:
    """In, out and total degree and degree centrality of nodes with at least one edge."""
    count = F.lit(n) if n is not None else entities.select("entity").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    ends = edges.select("idx", F.col("src").alias("entity"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("s")).unionByName(
        edges.select("idx", F.col("dst").alias("entity"), F.lit(1).alias("i"), F.lit(0).alias("o"),
                     (F.col("src") == F.col("dst")).cast("int").alias("s")))
    d = ends.groupBy("idx", "entity").agg(F.sum("i").alias("deg_in"), F.sum("o").alias("deg_out"), F.sum("s").alias("_self"))
    d = d.join(_one_way(edges), "idx")
    total = F.when(F.col("symmetric"), F.col("deg_in") + F.col("_self")).otherwise(F.col("deg_in") + F.col("deg_out"))
    return d.withColumn("deg", total).withColumn("n", count).withColumn(
        "degree_centrality", F.col("deg") / (F.col("n") - 1)).drop("_self", "n")


def degree_sums(degrees: DataFrame, entities: DataFrame) -> DataFrame:
    """As `degrees`, from `causal_degrees`: a graph is symmetric where every edge has a counterpart."""
    n = entities.select("entity").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    kind = degrees.groupBy("idx").agg((F.sum("deg_out") == F.sum("mutual")).alias("symmetric"))
    d = degrees.select("idx", "entity", "deg_in", "deg_out").join(kind, "idx")
    d = d.withColumn("deg", F.when(F.col("symmetric"), F.col("deg_in")).otherwise(F.col("deg_in") + F.col("deg_out")))
    return d.withColumn("_n", n).withColumn("degree_centrality", F.col("deg") / (F.col("_n") - 1)).drop("_n")


def complete(values: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """One row for every (idx, entity) of `nodes`: a node without edges, and a date without any, has centrality 0."""
    found = values.select("idx", "entity", *cols, F.lit(True).alias("_found"))
    rows = nodes.select("idx", "entity").join(found, ["idx", "entity"], "left")
    return rows.select("idx", "entity", *[F.when(F.col("_found"), F.col(c)).otherwise(0).alias(c) for c in cols])


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(idx, src, node, depth, paths): hop distance and number of shortest paths, by frontier joins, from all nodes or from
    the (idx, src) of `sources`.

    Each level is written to the checkpoint folder, so the plan stays flat and a lost executor re-reads it.
    """
    step = cut_lineage(edges.filter("src <> dst").distinct().select(
        "idx", F.col("src").alias("node"), F.col("dst").alias("next")))
    frontier = step.select("idx", F.col("node").alias("src"), F.col("next").alias("node"), F.lit(1).alias("depth"),
                           F.lit(1.0).alias("paths"))
    if sources is not None:
        frontier = frontier.join(sources, ["idx", "src"], "left_semi")
    seen = frontier
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        grown = frontier.join(step, ["idx", "node"]).filter(F.col("next") != F.col("src")).groupBy(
            "idx", "src", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = grown.join(seen.select("idx", "src", "node"), ["idx", "src", "node"], "left_anti")
        frontier = cut_lineage(fresh.select("idx", "src", "node", F.lit(depth).alias("depth"), "paths"))
        seen = seen.unionByName(frontier)
    return seen


def closeness(paths: DataFrame, n: int) -> DataFrame:
    """(n - 1) over the sum of finite hop distances; nodes that reach nobody have no row (centrality 0)."""
    return paths.groupBy("idx", F.col("src").alias("entity")).agg(((n - 1.0) / F.sum("depth")).alias("closeness"))


def betweenness(edges: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """Dependency accumulation from the deepest level up; scaled by 2 / ((n - 1)(n - 2))."""
    step = edges.select("idx", F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    top = paths.agg(F.max("depth")).first()[0] or 1
    dep = None
    for depth in range(top, 1, -1):
        below = paths.filter(F.col("depth") == depth)
        below = below.withColumn("gain", F.lit(0.0)) if dep is None else below.join(
            dep, ["idx", "src", "node"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
        share = below.select("idx", "src", F.col("node").alias("next"), ((1.0 + F.col("gain")) / F.col("paths")).alias("w"))
        above = paths.filter(F.col("depth") == depth - 1).select("idx", "src", "node", "paths")
        up = above.join(step, ["idx", "node"]).join(share, ["idx", "src", "next"]).groupBy("idx", "src", "node").agg(
            (F.first("paths") * F.sum("w")).alias("gain"))
        dep = cut_lineage(up)
        total = dep if depth == top else total.unionByName(dep)
    if dep is None:
        total = paths.select("idx", "src", "node", F.lit(0.0).alias("gain"))
    return total.groupBy("idx", F.col("node").alias("entity")).agg(
        (F.sum("gain") * 2.0 / ((n - 1) * (n - 2))).alias("betweenness"))


def _in_batches(edges: DataFrame, value: str, batch: int, work) -> DataFrame:
    """(idx, entity, value): sums of `work(edges, paths)` over batches of about `batch` source nodes a graph.

    Only the sums of a batch outlast it: its frontiers and path counts are removed before the next one starts.
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.filter("src <> dst").select("idx", "src", "dst").distinct(), keep=True)
    sources = edges.select("idx", "src").distinct()
    most = sources.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    batches, parts = max(1, -(-most // batch)), []
    for k in range(batches):
        with passing_tables(spark):
            own = sources.filter(F.pmod(F.xxhash64("src"), F.lit(batches)) == k)
            parts.append(cut_lineage(work(edges, shortest_paths(edges, own)), keep=True))
    return reduce(DataFrame.unionByName, parts).groupBy("idx", "entity").agg(F.sum(value).alias(value))


def batched_closeness(edges: DataFrame, n: int, batch: int = BATCH) -> DataFrame:
    """`closeness`, with the paths of about `batch` sources of each graph at a time."""
    return _in_batches(edges, "closeness", batch, lambda _, paths: closeness(paths, n))


def batched_betweenness(edges: DataFrame, n: int, batch: int = BATCH) -> DataFrame:
    """`betweenness`, with the paths of about `batch` sources of each graph at a time: rows in flight are batch x nodes."""
    return _in_batches(edges, "betweenness", batch, lambda e, paths: betweenness(e, paths, n))


def eigenvector_centrality(edges: DataFrame, tolerance: float = 1e-10, cycles: int = 40) -> DataFrame:
    """Dominant eigenvector of each graph, summing to 1, by products of edges and vectors as joins.

    A graph without cycles has what power iteration on A + I tends to. Null where the residual stays above `tolerance`.
    Nodes without edges have no row.
    """
    return dominant_vectors(edges, tolerance, cycles).select("idx", F.col("node").alias("entity"), F.col("value").alias("eigenvector"))


def katz_centrality(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, tolerance: float = 1e-12) -> DataFrame:
    """(I - alpha A)^-1 1 scaled to unit length, one row for every (idx, entity) of `nodes`.

    A node without edges solves to one before scaling. A graph whose residual stays above `tolerance` gets null.
    """
    found = resolvents(edges, alpha, tolerance).withColumnRenamed("node", "entity")
    rows = nodes.select("idx", "entity").join(found.withColumn("linked", F.lit(True)), ["idx", "entity"], "left")
    rows = cut_lineage(rows.withColumn("value", F.when(F.col("linked"), F.col("value")).otherwise(1.0)).drop("linked"))
    scale = rows.groupBy("idx").agg((F.signum(F.sum("value")) * F.sqrt(F.sum(F.col("value") * F.col("value")))).alias("scale"),
                                    F.bool_or(F.col("value").isNull()).alias("open"))
    return rows.join(scale, "idx").select("idx", "entity", F.when(~F.col("open"), F.col("value") / F.col("scale")).alias("katz"))


def triangles(edges: DataFrame) -> DataFrame:
    """(idx, entity, links, two_way): for each node the edges between its out-neighbours, and those that run both ways.

    Each pair of linked nodes is one row that points to the node with more neighbours, so that at most a root of all
    pairs leaves any node; two such rows of a node meet the row that closes them. A triangle then counts for its three nodes.
    """
    ends = {"a": F.least("src", "dst"), "b": F.greatest("src", "dst"), "up": (F.col("src") < F.col("dst")).cast("int")}
    linked = edges.filter("src <> dst").withColumns(ends).groupBy("idx", "a", "b").agg(F.max("up").alias("ab"), F.max(1 - F.col("up")).alias("ba"))
    linked = cut_lineage(linked)
    degree = linked.select("idx", F.explode(F.array("a", "b")).alias("node")).groupBy("idx", "node").agg(F.count("*").alias("degree"))
    of = {c: degree.select("idx", F.col("node").alias(c), F.struct("degree", "node").alias(f"rank_{c}")) for c in ("a", "b")}
    ranked = linked.join(of["a"], ["idx", "a"]).join(of["b"], ["idx", "b"])
    turned = F.col("rank_a") > F.col("rank_b")

    def pair(here: str, if_turned: str):
        return F.when(turned, F.col(if_turned)).otherwise(F.col(here))

    points = cut_lineage(ranked.select("idx", pair("rank_a", "rank_b").alias("lo"), pair("rank_b", "rank_a").alias("hi"),
                                       pair("ab", "ba").alias("there"), pair("ba", "ab").alias("back")))
    one = points.select("idx", F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("there").alias("xy"), F.col("back").alias("yx"))
    two = points.select("idx", F.col("lo").alias("x"), F.col("hi").alias("z"), F.col("there").alias("xz"), F.col("back").alias("zx"))
    closing = points.select("idx", F.col("lo").alias("y"), F.col("hi").alias("z"), F.col("there").alias("yz"), F.col("back").alias("zy"))
    found = one.join(two, ["idx", "x"]).filter("y < z").join(closing, ["idx", "y", "z"])

    def seen(node: str, left: str, right: str, one_way: str, other_way: str):
        both = F.col(left) * F.col(right)
        return F.struct(F.col(f"{node}.node").alias("entity"), (both * (F.col(one_way) + F.col(other_way))).alias("links"),
                        (both * 2 * F.col(one_way) * F.col(other_way)).alias("two_way"))

    each = found.select("idx", F.inline(F.array(seen("x", "xy", "xz", "yz", "zy"), seen("y", "yx", "yz", "xz", "zx"), seen("z", "zx", "zy", "xy", "yx"))))
    return each.groupBy("idx", "entity").agg(F.sum("links").alias("links"), F.sum("two_way").alias("two_way"))


def clustering(edges: DataFrame) -> DataFrame:
    """Edges among a node's out-neighbours over deg (deg - 1), twice that when the whole graph is symmetric.

    Where all edges among the out-neighbours run both ways, they count once per pair.
    """
    edges = cut_lineage(edges.select("idx", "src", "dst"))
    d = degrees(edges, n=2).select("idx", "entity", "deg", "symmetric")
    got = d.join(triangles(edges), ["idx", "entity"], "left").fillna(0, ["links", "two_way"])
    links = F.when(F.col("links") == F.col("two_way"), F.col("links") / 2.0).otherwise(F.col("links").cast("double"))
    f = F.when(F.col("symmetric"), 2.0).otherwise(1.0)
    return got.select("idx", "entity", F.when(F.col("deg") > 1, f * links / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0).alias("clustering"))


def average_adjacency(edges: DataFrame, windows: int, n: int) -> DataFrame:
    """One graph (idx 0): pairs linked in at least the average share of windows."""
    share = edges.groupBy("src", "dst").agg((F.count(F.lit(1)) / windows).alias("share"))
    mean = share.agg((F.sum("share") / float(n * n)).alias("m")).scalar()
    return share.withColumn("mean", mean).filter("share >= mean").select(F.lit(0).cast("long").alias("idx"), "src", "dst", "share")


def network_weights(degree: DataFrame, windows: int) -> DataFrame:
    """Mean degree per entity over all windows, scaled to [0.25, 4]."""
    mean = degree.groupBy("entity").agg((F.sum("deg") / windows).alias("mean_degree"))
    lo, hi = (mean.agg(f("mean_degree").alias("v")).scalar() for f in (F.min, F.max))
    return mean.withColumns({"lo": lo, "hi": hi}).withColumn(
        "weight", 0.25 + 3.75 * (F.col("mean_degree") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")
