"""Query registry. Results are projected to declared columns and rounded the same way on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.sources.market import Market


def _names(text: str) -> list[str]:
    return [c.strip() for c in text.split(",") if c.strip()]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Market], DataFrame]
    keys: list[str]
    ints: list[str]
    nums: list[str]
    digits: int
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Market(spark, folder))
        return df.select(
            *self.keys, *[F.col(c).cast("bigint").alias(c) for c in self.ints],
            *[(F.round(F.col(c).cast("double"), self.digits) + 0.0).alias(c) for c in self.nums])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = [*self.keys, *[f"cast({c} as bigint) as {c}" for c in self.ints],
                *[f"round(cast({c} as double), {self.digits}) + 0.0 as {c}" for c in self.nums]]
        ctes, last = self.sql.rsplit("select_final", 1) if "select_final" in self.sql else ("", self.sql)
        head = f"with recursive {ctes.strip().rstrip(',')} " if ctes.strip() else ""
        return f"{head}select {', '.join(cols)} from ({last.strip()}) final_rows"


REGISTRY: dict[str, Query] = {}


def query(name: str, keys: str = "", ints: str = "", nums: str = "", sql: str | None = None, digits: int = 6):
    """Register `build(market) -> DataFrame`. `sql` holds CTEs, the word select_final, and the last select."""

    def register(build: Callable[[Market], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, _names(keys), _names(ints), _names(nums), digits, sql)
        return build

    return register
