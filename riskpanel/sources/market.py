"""Market panels derived from transaction tables.

The raw rows are collapsed by (entity, period) with map-side partial aggregation before anything is
ordered or windowed, so a key that holds a third of the raw rows still becomes one row per period.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.operators.transforms import log_returns
from riskpanel.session import cut_lineage, ship_package


#: Rows of a dense panel in one task, about: its windows sort them several times.
TASK_ROWS = 250_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def period_start(ts: Column, unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, ts))


def densify(obs: DataFrame, calendar: DataFrame, step_days: int, held: list[str], flows: list[str],
            parts: int | None = None) -> DataFrame:
    """Complete the calendar of every entity.

    Each observation covers the periods up to the next one of its entity (the first also covers those
    before it): held values are carried, flows are zero in the covered gaps. One shuffle by entity, no
    grid join. `calendar` is a one-row frame with `lo` and `hi`. The rows that travel are those before the gaps are filled,
    so their size says little about the panel's: `parts` is the number of tasks to deal the entities to.
    """
    obs = obs.repartition(parts, "entity") if parts else obs
    w = Window.partitionBy("entity").orderBy("date")
    lo, hi = calendar.select("lo").scalar(), calendar.select("hi").scalar()
    step = F.expr(f"interval {step_days} days")
    spans = (
        obs.withColumn("nxt", F.lead("date").over(w)).withColumn("prv", F.lag("date").over(w))
        .withColumn("lo", lo).withColumn("hi", hi)
        .withColumn("start", F.when(F.col("prv").isNull(), F.col("lo")).otherwise(F.col("date")))
        .withColumn("stop", F.when(F.col("nxt").isNull(), F.col("hi")).otherwise(F.date_sub("nxt", step_days)))
    )
    covered = spans.withColumn("day", F.explode(F.sequence("start", "stop", step)))
    here = F.col("day") == F.col("date")
    return covered.select(
        "entity", F.col("day").alias("date"),
        (F.datediff("day", "lo") / step_days + 1).cast("bigint").alias("idx"),
        *[F.col(c) for c in held], *[F.when(here, F.col(c)).otherwise(0.0).alias(c) for c in flows])


class Market:
    """The frames one analysis works on, read from one folder of tables.

    The raw rows are scanned once per panel: the (entity, period) aggregate is written to the checkpoint folder and
    everything else (panel, returns, index, calendar) derives from it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship_package(spark)
        self._observations: dict[tuple[str, str], DataFrame] = {}
        self._dealt: dict[tuple[str, str], int | None] = {}

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def calendar(self, unit: str = "week") -> DataFrame:
        day = period_start(F.col("l_shipdate"), unit)
        source = self.table("lineitem").select(day.alias("date"))
        for (_, made), df in self._observations.items():
            source = df if made == unit else source
        return source.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))

    def _aggregate(self, by: str, unit: str) -> DataFrame:
        """Sums per (entity, period), of the rows in their own order. Rows of a part that is not listed have a null entity:
        no series of their own, but a share in the market."""
        if (by, unit) not in self._observations:
            items = self.table("lineitem").withColumn("date", period_start(F.col("l_shipdate"), unit))
            if by == "supplier":
                items = items.withColumn("entity", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
                unit_value = F.lit(1000.0)
            else:
                key = {"brand": "p_brand", "type": "p_type"}[by]
                parts = self.table("part").select("p_partkey", F.col(key).alias("entity"), "p_retailprice")
                items = items.join(parts, items.l_partkey == parts.p_partkey, "left")
                unit_value = F.col("p_retailprice")
            self._observations[by, unit] = cut_lineage(items.groupBy("entity", "date").agg(
                F.sum("l_extendedprice").alias("volume"), F.sum("l_quantity").alias("quantity"),
                F.sum(F.col("l_quantity") * unit_value).alias("cap"), F.avg("l_discount").alias("cds"),
                F.sum("l_tax").alias("tax"), F.count("l_tax").alias("lines")), lean=True)
        return self._observations[by, unit]

    def observations(self, by: str = "brand", unit: str = "week") -> DataFrame:
        """(entity, date) price, volume, cap, cds. `by` is brand, type or supplier."""
        return self._aggregate(by, unit).filter("entity is not null").select(
            "entity", "date", (F.col("volume") / F.col("quantity")).alias("price"), "volume", "cap", "cds")

    def _parts(self, by: str, unit: str, days: int) -> int | None:
        """Tasks for the dense panel, from its entities and periods; None where one is enough, and Spark may choose."""
        if (by, unit) not in self._dealt:
            n, span = self._aggregate(by, unit).agg(F.approx_count_distinct("entity"), F.datediff(F.max("date"), F.min("date"))).first()
            parts = math.ceil(n * ((span or 0) / days + 1) / TASK_ROWS)
            self._dealt[by, unit] = max(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if parts > 1 else None
        return self._dealt[by, unit]

    def panel(self, by: str = "brand", unit: str = "week") -> DataFrame:
        """Dense panel: entity, date, idx, price, cap, cds, volume."""
        days = {"week": 7, "day": 1}[unit]
        obs = self.observations(by, unit)
        return densify(obs, self.calendar(unit), days, ["price", "cap", "cds"], ["volume"], self._parts(by, unit, days))

    def returns(self, by: str = "brand", unit: str = "week") -> DataFrame:
        return log_returns(self.panel(by, unit))

    def index(self, unit: str = "week") -> DataFrame:
        """Market index log return r_m and risk-free rate rf, idx aligned with `returns`."""
        days = {"week": 7, "day": 1}[unit]
        market = self._aggregate("brand", unit).groupBy("date").agg(
            (F.sum("volume") / F.sum("quantity")).alias("price"), (F.sum("tax") / F.sum("lines")).alias("rf"),
            F.lit(0.0).alias("none")).withColumn("entity", F.lit("INDEX"))
        dense = densify(market, self.calendar(unit), days, ["price", "rf"], ["none"]).drop("none")
        return log_returns(dense).select("date", "idx", F.col("r").alias("r_m"), "rf")

    def balance(self) -> DataFrame:
        """Quarterly balance sheet by brand."""
        items = self.table("lineitem").select(
            "l_partkey", "l_extendedprice", "l_discount", "l_returnflag",
            period_start(F.col("l_shipdate"), "quarter").alias("period"))
        parts = self.table("part").select("p_partkey", F.col("p_brand").alias("entity"))
        back = F.when(F.col("l_returnflag") == "R", 0.1 * F.col("l_extendedprice")).otherwise(0.0)
        return items.join(parts, items.l_partkey == parts.p_partkey).groupBy("entity", "period").agg(
            F.sum("l_extendedprice").alias("assets"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("equity"),
            F.sum(back).alias("separate_accounts"))

    def states(self) -> DataFrame:
        """Weekly state variables: average order value by priority, in units of 1e5."""
        orders = self.table("orders")
        return orders.groupBy(period_start(F.col("o_orderdate"), "week").alias("date"),
                              F.col("o_orderpriority").alias("var")).agg(
            (F.avg("o_totalprice") / 1e5).alias("value"))

    def groups(self) -> DataFrame:
        """Ordered entity groups (name, short name, count): the brands split in four runs."""
        rows = [("Group A", "GA", 7), ("Group B", "GB", 6), ("Group C", "GC", 8), ("Group D", "GD", 4)]
        return self.spark.createDataFrame(rows, "group_name string, short_name string, cnt int")

    def crises(self) -> DataFrame:
        rows = [("Crisis 1", "1996-03-04", "1996-09-30"), ("Crisis 2", "1998-08-03", "1999-01-29"),
                ("Crisis 3", "2000-11-06", "2001-03-26")]
        return self.spark.createDataFrame(rows, "name string, s string, e string").select(
            "name", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
