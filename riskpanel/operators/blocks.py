"""Blocked evaluation of rolling pair and cross-section statistics.

Entities are hashed into buckets of about `block` members and dates are cut into runs of `chunk` windows.
One task works on one (bucket pair, run): at most (chunk + bw) rows of 2 * block entities, whatever the size
of the panel. The rows of at most `TILE` entities of a bucket are packed to one matrix a run, a tile, which travels once per
bucket, so the shuffle grows with 8 bytes a cell times n * n / block instead of n * n, and pair rows exist only as array columns
inside the task. Sums of pairs leave it packed as well, as one small number an entity and window.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.operators.transforms import head_rows

#: Entities of a bucket, about.
BLOCK = 64
#: Entities of a tile and of a row of packed sums, at most about.
TILE = 512
#: Buckets that larger ones are cut into where there are entities enough, so that pairs of them keep many tasks busy.
LEAST = 4


def _matrix(pdf: pd.DataFrame, value: str):
    """Dates, names and cells (dates by names) of the rows, and where each row is."""
    rows, row_at = np.unique(pdf["idx"].to_numpy(), return_inverse=True)
    names, col_at = np.unique(pdf["entity"].to_numpy(dtype=str), return_inverse=True)
    x = np.full((len(rows), len(names)), np.nan)
    x[row_at, col_at] = pdf[value].to_numpy(dtype=float)
    return rows, names, x, (row_at, col_at)


class Block:
    """One task's share: `x` is rows by entities, `windows` lists (idx, first row, last row + 1)."""

    def __init__(self, pdf: pd.DataFrame, value: str, bw: int, chunk: int, run: int, left: int, right: int):
        self.rows, self.names, self.x, (row_at, col_at) = _matrix(pdf, value)
        bucket = np.zeros(len(self.names), dtype=int)
        bucket[col_at] = pdf["bucket"].to_numpy()
        self._place(bucket, bw, chunk, run, left, right)

    @classmethod
    def of_tiles(cls, pdf: pd.DataFrame, bw: int, chunk: int, run: int, left: int, right: int) -> Block:
        """From the tiles of a bucket pair."""
        self = cls.__new__(cls)
        self.rows = np.unique(np.concatenate(pdf["dates"].to_list()))
        names = np.concatenate(pdf["names"].to_list()).astype(str)
        order = np.argsort(names, kind="stable")
        self.names, place = names[order], np.argsort(order)
        self.x = np.full((len(self.rows), len(names)), np.nan)
        at = 0
        for dates, members, cells in zip(pdf["dates"], pdf["names"], pdf["cells"]):
            to = np.ix_(np.searchsorted(self.rows, dates), place[at:at + len(members)])
            self.x[to] = np.frombuffer(cells).reshape(len(dates), len(members))
            at += len(members)
        if "labels" in pdf:
            self.labels = np.concatenate(pdf["labels"].to_list())[order]
        self._place(np.repeat(pdf["bucket"].to_numpy(), pdf["names"].map(len))[order], bw, chunk, run, left, right)
        return self

    def _place(self, bucket: np.ndarray, bw: int, chunk: int, run: int, left: int, right: int) -> None:
        rows = self.rows
        self.run, self.buckets = run, (left, right)
        self.left, self.right = np.flatnonzero(bucket == left), np.flatnonzero(bucket == right)
        self.same = left == right
        k = head_rows(bw)
        own = rows[(rows > run * chunk) & (rows <= (run + 1) * chunk)]
        self.windows = [(int(w), int(np.searchsorted(rows, max(1, w - bw + 1))),
                         int(np.searchsorted(rows, max(w, k), side="right"))) for w in own]

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.meshgrid(self.left, self.right, indexing="ij")
        i, j = i.ravel(), j.ravel()
        keep = i < j if self.same else slice(None)
        return i[keep], j[keep]

    @property
    def i(self) -> np.ndarray:
        """Left ends of all pairs."""
        return self._pairs[0]

    @property
    def j(self) -> np.ndarray:
        return self._pairs[1]

    @cached_property
    def alike(self) -> np.ndarray:
        """A number per column; columns with the same cells share it."""
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(blake2b(column.tobytes(), digest_size=16).digest(), len(seen)) for column in self.x.T], dtype=int)

    @cached_property
    def groups(self) -> np.ndarray:
        """A number per column; columns with the same label share it."""
        return np.unique(self.labels.astype(str), return_inverse=True)[1]

    def edges(self, w: int, i, j, keep, **columns) -> pd.DataFrame:
        out = {"idx": w, "src": self.names[i[keep]], "dst": self.names[j[keep]]}
        out.update({c: v[keep] for c, v in columns.items()})
        return pd.DataFrame(out)


def pair_blocks(df: DataFrame, value: str, bw: int, kernel: Callable[[Block], list[pd.DataFrame]], schema: str,
                block: int = BLOCK, chunk: int = 64, label: str | None = None) -> DataFrame:
    """Run `kernel` on every (bucket pair, run of windows). Unordered pairs appear once, as (block.i, block.j).

    `label` is a string column, one value an entity, that the kernel finds in block.labels. Buckets of more than `BLOCK`
    entities are meant for kernels that take most of the time: their number is known before the tasks are dealt out.
    """
    labels = [F.col(label).alias("label")] if label else []
    chunk = max(chunk, head_rows(bw))
    deal, each = 0, 1
    if block > BLOCK:
        n, last = df.agg(F.count_distinct("entity"), F.coalesce(F.max("idx"), F.lit(0))).first()
        count = max(math.ceil(n / block), min(LEAST, math.ceil(n / TILE)), 1)
        each = max(math.ceil(n / count / TILE), 1)
        # a pair of buckets is one task: among so many partitions few of them meet
        deal = max(min(4 * count * (count + 1) * math.ceil((last + bw) / chunk), 4096), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        buckets = F.lit(count)
    else:
        buckets = df.select("entity").distinct().agg(F.ceil(F.count(F.lit(1)) / block).alias("b")).scalar()
    rows = df.select("entity", "idx", value, *labels).withColumn("buckets", buckets)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("entity"), F.col("buckets") * each).cast("int"))
    rows = rows.withColumn("bucket", F.pmod("tile", "buckets").cast("int")).drop("buckets")

    def pack(key, pdf):
        dates, names, x, (row_at, col_at) = _matrix(pdf, value)
        names, idx = names.astype(object), dates[row_at]
        if label:
            of = np.empty(len(names), dtype=object)
            of[col_at] = pdf["label"].to_numpy()
        tiles = []
        for run in range((dates[0] - 1) // chunk, (dates[-1] + bw - 2) // chunk + 1):
            own = (idx > run * chunk - bw + 1) & (idx <= (run + 1) * chunk)
            at, who = np.unique(row_at[own]), np.unique(col_at[own])
            if len(at):
                tile = {"bucket": int(key[1]), "run": int(run), "dates": dates[at].astype(np.int64), "names": names[who], "cells": x[np.ix_(at, who)].tobytes()}
                tiles.append(tile | ({"labels": of[who]} if label else {}))
        return pd.DataFrame(tiles)

    tile = "bucket int, run long, dates array<long>, names array<string>, cells binary" + (", labels array<string>" if label else "")
    tiles = rows.groupBy("tile", "bucket").applyInPandas(pack, tile)
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), (buckets - 1).cast("int"))))
    tiles = tiles.withColumns({"p": F.least("bucket", "other"), "q": F.greatest("bucket", "other")}).drop("other")
    if deal:
        tiles = tiles.repartition(deal, "p", "q", "run")

    def task(key, pdf):
        p, q, run = (int(v) for v in key)
        parts = kernel(Block.of_tiles(pdf, bw, chunk, run, p, q))
        parts = [part for part in parts if len(part)]
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in schema.split(",")])

    return tiles.groupBy("p", "q", "run").applyInPandas(task, schema)


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, with that type in front."""
    if a.dtype.kind in "iu":
        a = a.astype(np.promote_types(np.min_scalar_type(a.min(initial=0)), np.min_scalar_type(a.max(initial=0))))
    return a.dtype.str.ljust(4).encode() + zlib.compress(a.tobytes(), 1)


def _unpacked(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[4:]), dtype=data[:4].decode().strip()).reshape(shape)


def pair_sums(df: DataFrame, value: str, bw: int, kernel: Callable[[Block, int, int, int], list[np.ndarray]], names: dict[str, str],
              block: int = BLOCK, chunk: int = 64, label: str | None = None) -> DataFrame:
    """(idx, entity, *names): sums over an entity's pairs, for readers that need no pair row.

    `kernel(block, idx, first row, last row + 1)` returns an array for each of `names` (name: type), one value an entity of the
    block. A task emits an array of each name for the entities of a tile, so a date travels as entities x buckets numbers of
    few bytes, not as its pairs; a second task adds up the arrays of a tile.
    """
    types = {n: np.int64 if kind == "long" else float for n, kind in names.items()}

    def tables(b: Block):
        if not b.windows:
            return []
        found = [kernel(b, w, lo, hi) for w, lo, hi in b.windows]
        values = {n: np.array([f[k] for f in found]) for k, n in enumerate(names)}  # windows by entities
        values = {n: v if v.dtype.kind in "iu" else v.astype(types[n]) for n, v in values.items()}
        del found
        idx, out = np.array([w for w, _, _ in b.windows], dtype=np.int64), []
        for bucket, side in list(zip(b.buckets, (b.left, b.right)))[:1 if b.same else 2]:
            for part in range(math.ceil(len(side) / TILE)):
                who = side[part * TILE:(part + 1) * TILE]
                out.append({"bucket": bucket, "run": b.run, "part": part, "dates": idx, "names": b.names[who].astype(object),
                            **{n: _packed(np.ascontiguousarray(v[:, who])) for n, v in values.items()}})
        return [pd.DataFrame(out)]

    def total(key, pdf):
        """The arrays of a tile: a row where any of them counts something; what is not a number is left out of a sum."""
        dates, who = np.unique(np.concatenate(pdf["dates"].to_list())), pdf["names"].iloc[0]
        sums = {n: np.zeros((len(dates), len(who)), kind) for n, kind in types.items()}
        known = {n: np.zeros((len(dates), len(who)), bool) for n, kind in types.items() if kind is float}
        seen = np.zeros((len(dates), len(who)), bool)
        for k, idx in enumerate(pdf["dates"]):
            at = np.searchsorted(dates, idx)
            part = {n: _unpacked(pdf[n].iloc[k], (len(idx), len(who))) for n in names}
            some = np.logical_or.reduce([v != 0 for v in part.values()])
            seen[at] |= some
            for n, v in part.items():
                if n in known:
                    known[n][at] |= some & ~np.isnan(v)
                    v = np.nan_to_num(v, posinf=np.inf, neginf=-np.inf)
                sums[n][at] += v
        for n, valid in known.items():
            sums[n][~valid] = np.nan
        row, col = np.nonzero(seen)
        return pd.DataFrame({"idx": dates[row], "entity": np.asarray(who, dtype=object)[col], **{n: v[row, col] for n, v in sums.items()}})

    packed = "bucket int, run long, part int, dates array<long>, names array<string>, " + ", ".join(f"{n} binary" for n in names)
    parts = pair_blocks(df, value, bw, tables, packed, block, chunk, label)
    schema = "idx long, entity string, " + ", ".join(f"{n} {kind}" for n, kind in names.items())
    return parts.groupBy("bucket", "run", "part").applyInPandas(total, schema)


def entity_blocks(df: DataFrame, value: str, bw: int, kernel: Callable[[Block], list[pd.DataFrame]], schema: str,
                  block: int = 64, chunk: int = 64) -> DataFrame:
    """Run `kernel` on every (bucket, run of windows), for statistics of single entities that need whole windows."""
    chunk = max(chunk, head_rows(bw))
    n = df.select("entity").distinct().agg(F.ceil(F.count(F.lit(1)) / block).alias("b")).scalar()
    rows = df.select("entity", "idx", value).withColumn("buckets", n)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.col("buckets")).cast("int"))
    first, last = F.floor((F.col("idx") - 1) / chunk), F.floor((F.col("idx") + bw - 2) / chunk)
    rows = rows.withColumn("run", F.explode(F.sequence(first, last)))

    def task(key, pdf):
        parts = [part for part in kernel(Block(pdf, value, bw, chunk, int(key[1]), int(key[0]), int(key[0]))) if len(part)]
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in schema.split(",")])

    return rows.groupBy("bucket", "run").applyInPandas(task, schema)


def section_blocks(df: DataFrame, value: str, bw: int, kernel: Callable[[Block], list[pd.DataFrame]], schema: str,
                   chunk: int = 64) -> DataFrame:
    """Run `kernel` on whole cross-sections, one run of windows per task, for statistics that need every
    entity at once (eigenvalues, inverses). The work per window is cubic in min(entities, bw) by nature."""
    chunk = max(chunk, head_rows(bw))
    first, last = F.floor((F.col("idx") - 1) / chunk), F.floor((F.col("idx") + bw - 2) / chunk)
    rows = df.select("entity", "idx", value, F.lit(0).alias("bucket"), F.explode(F.sequence(first, last)).alias("run"))

    def task(key, pdf):
        parts = kernel(Block(pdf, value, bw, chunk, int(key[0]), 0, 0))
        parts = [part for part in parts if len(part)]
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in schema.split(",")])

    return rows.groupBy("run").applyInPandas(task, schema)
