"""Eigenvectors and linear systems of graphs by joins: a vector is a table keyed by (idx, node), a product one join.

A cycle multiplies a start vector LENGTH times by the adjacency matrix, every product a join of edges with the vector and a
map-side combined sum, and writes the vectors to the shared folder. One aggregate then gives the products of these vectors
with each other for every graph; from this small matrix follow the best combination in the space that they span and what
is left to do. Graphs that are done leave the next cycle. A single graph is spread over as many tasks as its edges need.
Graphs of at most LOCAL_EDGES edges go through the same cycles in one task each, many graphs side by side.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.session import cut_lineage

#: Products of a cycle.
LENGTH = 10
#: Cycles that need not halve a residual before a graph is given up.
SLOW = 3
#: Edges of a graph that one task may hold.
LOCAL_EDGES = 200_000
#: Directions below this share of the largest, squared, are noise.
NOISE = 1e-13


def with_own(edges: DataFrame) -> DataFrame:
    """idx, src, dst, own: the edges, each once, and for each node a row to itself by which a product keeps the node's numbers."""
    edges = edges.select("idx", "src", "dst").distinct()
    nodes = edges.select("idx", F.explode(F.array("src", "dst")).alias("src")).distinct()
    return cut_lineage(edges.withColumn("own", F.lit(False)).unionByName(nodes.select("idx", "src", F.col("src").alias("dst"), F.lit(True).alias("own"))))


def multiplied(edges: DataFrame, rows: DataFrame, source: str, target: str, start: Column | None = None) -> DataFrame:
    """`rows` (idx, node, numbers) with the column `target`: the sum of `source` over the ends of a node's edges, from `start`.

    `rows` is read once, so that products in a row make a plan as long as there are products.
    """
    carried = [c for c in rows.columns if c not in ("idx", "node")]
    sent = edges.join(rows.withColumnRenamed("node", "dst"), ["idx", "dst"])
    kept = (F.when(F.col("own"), F.col(c)).otherwise(0.0).alias(c) for c in carried)
    added = F.when(F.col("own"), F.lit(0.0) if start is None else start).otherwise(F.col(source))
    sent = sent.select("idx", F.col("src").alias("node"), *kept, added.alias(target))
    return sent.groupBy("idx", "node").agg(*(F.sum(c).alias(c) for c in (*carried, target)))


def spanned(edges: DataFrame, rows: DataFrame, shift: Column | None = None) -> DataFrame:
    """`rows` with b1 to bLENGTH after their b0: b1 = A b0 + shift, then each the product of the one before."""
    for j in range(LENGTH):
        rows = multiplied(edges, rows, f"b{j}", f"b{j + 1}", shift if j == 0 else None)
    return rows


def products(rows: DataFrame) -> DataFrame:
    """For each graph: nodes n, the sums of b0 to bLENGTH, how many entries are not zero, and their products with each other by rows."""
    names = [f"b{j}" for j in range(LENGTH + 1)]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    return rows.groupBy("idx").agg(
        F.count("*").alias("n"), F.array(*(F.sum(c) for c in names)).alias("sums"), F.array(*(F.sum((F.col(c) != 0).cast("int")) for c in names)).alias("filled"),
        F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).alias("gram"))


def square(gram: np.ndarray) -> np.ndarray:
    """The symmetric matrix of the products that `products` lists."""
    out = np.zeros((LENGTH + 1, LENGTH + 1))
    out[np.triu_indices(LENGTH + 1)] = gram
    return np.where(out == 0, out.T, out)


def orthonormal(gram: np.ndarray) -> np.ndarray:
    """Combinations (columns) of vectors with these products that are orthonormal and span all of them but noise."""
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    value, vector = np.linalg.eigh(gram * scale[:, None] * scale)
    keep = value > max(value.max(), 0) * NOISE
    return scale[:, None] * vector[:, keep] / np.sqrt(value[keep])


def combined(weights: str, names: list[str]) -> Column:
    """Sum of the columns `names`, weighted by the array column `weights`."""
    return reduce(lambda a, b: a + b, (F.col(weights)[k] * F.col(c) for k, c in enumerate(names)))


def _dominant(gram: np.ndarray, theta: float) -> tuple[np.ndarray, float]:
    """Weights of b0 to b(LENGTH - 1) for the eigenvector of largest real eigenvalue in their span, and that value."""
    products_of = square(gram)
    times = np.eye(LENGTH + 1, LENGTH, -1)
    times[0, 0] = theta
    base = orthonormal(products_of[:LENGTH, :LENGTH])
    value, vector = np.linalg.eig(base.T @ (products_of[:LENGTH] @ times) @ base)
    best = int(np.argmax(value.real))
    return base @ vector[:, best].real, float(value[best].real)


def _eigen_next(total, entries, gram, theta: float, cyclic: bool, residual: float, slow: int, tolerance: float) -> tuple:
    """From the products of a cycle: weights of the next start vector (it sums to 1), theta, cyclic, residual, slow, done.

    While each product has fewer entries than the one before, walks may still die out: then the last product that is not
    zero is the answer. Equal numbers of entries prove a cycle. A start vector is done when A b0 - theta b0 is small.
    """
    weights, done, total, entries, gram = np.zeros(LENGTH + 1), False, np.asarray(total), np.asarray(entries), np.asarray(gram)
    now = float(np.sqrt(gram[LENGTH + 1] / gram[0])) if cyclic else 1.0  # b1 against b0
    slow += bool(cyclic and now > residual / 2)
    if cyclic and now <= tolerance:
        weights[0], done = 1.0, True
    elif slow > SLOW:
        weights[0], done = np.nan, True
    elif not cyclic and entries[-1] == 0:
        weights[np.flatnonzero(entries)[-1]], done = 1.0, True
    elif not cyclic and not (entries[1:] == entries[:-1]).any():
        weights[-1] = 1.0
    else:
        weights[:LENGTH], theta = _dominant(gram, theta)
        cyclic = True
    return weights / (weights @ total), theta, bool(cyclic), now, slow, done


def _solve_next(n: int, gram, alpha: float, tolerance: float) -> tuple[np.ndarray, bool]:
    """Weights y of b0 to b(LENGTH - 1) that make b0 - (I - alpha A) sum(y b) smallest, and whether b0 is small already."""
    gram = square(np.asarray(gram))
    if gram[0, 0] <= tolerance * tolerance * n:
        return np.zeros(LENGTH), True
    moved = np.eye(LENGTH + 1, LENGTH) - alpha * np.eye(LENGTH + 1, LENGTH, -1)
    reach = orthonormal(moved.T @ gram @ moved)
    return reach @ (reach.T @ (moved.T @ gram[:, 0])), False


_STATE = {"theta": 0.0, "cyclic": False, "residual": 1.0, "slow": 0}
_EIGEN = "struct<weights: array<double>, theta: double, cyclic: boolean, residual: double, slow: int, done: boolean>"


def _by_joins(edges: DataFrame, tolerance: float, cycles: int) -> DataFrame:
    edges, names = with_own(edges), [f"b{j}" for j in range(LENGTH + 1)]
    start = edges.filter("own").select("idx", F.col("src").alias("node"), F.lit(1.0).alias("b0"), *(F.lit(v).alias(c) for c, v in _STATE.items()))

    @F.pandas_udf(_EIGEN)
    def step(sums: pd.Series, filled: pd.Series, gram: pd.Series, theta: pd.Series, cyclic: pd.Series, residual: pd.Series, slow: pd.Series) -> pd.DataFrame:
        out = [_eigen_next(*row, tolerance) for row in zip(sums, filled, gram, theta, cyclic, residual, slow)]
        return pd.DataFrame(out, columns=["weights", *_STATE, "done"])

    found = []
    for _ in range(cycles):
        per_graph = start.select("idx", *_STATE).distinct()
        rows = cut_lineage(spanned(edges, start.select("idx", "node", "b0", "theta"), -F.col("theta") * F.col("b0")).drop("theta"))
        graphs = products(rows).join(per_graph, "idx")
        graphs = cut_lineage(graphs.select("idx", step("sums", "filled", "gram", *_STATE).alias("s")).select("idx", "s.*"))
        now = rows.join(graphs, "idx").select("idx", "node", combined("weights", names).alias("b0"), *_STATE, "done")
        found.append(now.filter("done").select("idx", "node", F.when(~F.isnan("b0"), F.col("b0")).alias("value")))
        start = now.filter("not done").drop("done")
        if graphs.filter("not done").isEmpty():
            break
        edges = edges.join(graphs.filter("not done").select("idx"), "idx", "left_semi")
    else:
        found.append(start.select("idx", "node", F.lit(None).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, found)


def _solved_by_joins(edges: DataFrame, alpha: float, tolerance: float, cycles: int) -> DataFrame:
    edges, names = with_own(edges), [f"b{j}" for j in range(LENGTH + 1)]
    start = edges.filter("own").select("idx", F.col("src").alias("node"), F.lit(0.0).alias("x"), F.lit(1.0).alias("b0"))

    @F.pandas_udf("struct<weights: array<double>, done: boolean>")
    def step(n: pd.Series, gram: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_solve_next(*row, alpha, tolerance) for row in zip(n, gram)], columns=["weights", "done"])

    found = []
    for _ in range(cycles):
        rows = cut_lineage(spanned(edges, start))
        graphs = cut_lineage(products(rows).select("idx", step("n", "gram").alias("s")).select("idx", "s.*"))
        now = rows.join(graphs, "idx")
        gained, sent = combined("weights", names[:-1]), combined("weights", names[1:])
        found.append(now.filter("done").select("idx", "node", F.col("x").alias("value")))
        start = now.filter("not done").select("idx", "node", (F.col("x") + gained).alias("x"), (F.col("b0") - gained + alpha * sent).alias("b0"))
        if graphs.filter("not done").isEmpty():
            break
        edges = edges.join(graphs.filter("not done").select("idx"), "idx", "left_semi")
    else:
        found.append(start.select("idx", "node", F.lit(None).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, found)


def _in_tasks(edges: DataFrame, solve) -> DataFrame:
    """`solve(multiply, n)` for each graph, where multiply(v) is A v: its values or None."""
    def task(key, rows):
        names, ends = np.unique(np.concatenate([rows["src"], rows["dst"]]).astype(str), return_inverse=True)
        src, dst = ends[:len(rows)], ends[len(rows):]
        found = solve(lambda v: np.bincount(src, v[dst], len(names)), len(names))
        return pd.DataFrame({"idx": key[0], "node": names, "value": pd.array([None] * len(names) if found is None else found, dtype="Float64")})

    return edges.groupBy("idx").applyInPandas(task, "idx long, node string, value double")


def _span(multiply, start: np.ndarray, theta: float = 0.0) -> np.ndarray:
    columns = [start, multiply(start) - theta * start]
    for _ in range(LENGTH - 1):
        columns.append(multiply(columns[-1]))
    return np.stack(columns, axis=1)


def _by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges of the graphs that a task may hold, and those of the others."""
    edges = cut_lineage(edges.select("idx", "src", "dst").distinct())
    large = cut_lineage(edges.groupBy("idx").agg(F.count("*").alias("n")).filter(F.col("n") > LOCAL_EDGES).select("idx"))
    return edges.join(large, "idx", "left_anti"), edges.join(large, "idx", "left_semi")


def dominant_vectors(edges: DataFrame, tolerance: float = 1e-10, cycles: int = 40) -> DataFrame:
    """idx, node, value: the eigenvector of the largest eigenvalue of each graph, summing to 1, for nodes with edges.

    Repeated edges count once. A graph without a cycle has the last nonzero power of A times one, which power iteration
    tends to. A graph whose residual is above `tolerance` after `cycles`, or hardly falls, has null: an eigenvalue that
    belongs to several parts which reach each other is the usual reason.
    """
    def solve(multiply, n: int):
        start, state = np.ones(n), tuple(_STATE.values())
        for _ in range(cycles):
            rows = _span(multiply, start, state[0])
            gram = (rows.T @ rows)[np.triu_indices(LENGTH + 1)]
            weights, *state, done = _eigen_next(rows.sum(axis=0), (rows != 0).sum(axis=0), gram, *state, tolerance)
            start = rows @ weights
            if done:
                return None if np.isnan(start).any() else start
        return None

    small, large = _by_size(edges)
    found = _in_tasks(small, solve)
    return found if large.isEmpty() else found.unionByName(_by_joins(large, tolerance, cycles))


def resolvents(edges: DataFrame, alpha: float, tolerance: float = 1e-12, cycles: int = 40) -> DataFrame:
    """idx, node, value: the solution x of (I - alpha A) x = 1 for nodes with edges; null where the residual stays above `tolerance`."""
    def solve(multiply, n: int):
        x, rest = np.zeros(n), np.ones(n)
        for _ in range(cycles):
            rows = _span(multiply, rest)
            weights, done = _solve_next(n, (rows.T @ rows)[np.triu_indices(LENGTH + 1)], alpha, tolerance)
            if done:
                return x
            gained = rows[:, :-1] @ weights
            x, rest = x + gained, rest - gained + alpha * (rows[:, 1:] @ weights)
        return None

    small, large = _by_size(edges)
    found = _in_tasks(small, solve)
    return found if large.isEmpty() else found.unionByName(_solved_by_joins(large, alpha, tolerance, cycles))
