"""Places and running sums over a whole table, without a window that has no partition.

Rows are cut into ranges of the order and sorted inside each. What lies before a range is a prefix sum over one number a range,
so no task holds more than its range, however large the table or one of its groups is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import cut_lineage

#: A row's id is its range, shifted by this many bits, plus its place in the range.
PLACE_BITS = 33


def _ranged(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """The rows with `_range` and `_place` (from 0), written once, so that every reader sees the same ranges."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = cut_lineage(cut)
    return rows.withColumns({"_range": F.shiftright("_id", PLACE_BITS).cast("int"),
                             "_place": F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_id"), ranges


def _before(rows: DataFrame, ranges: int, amount: Column) -> DataFrame:
    """(_range, _before): sum of `amount` over all earlier ranges; each range adds its total to those from itself on."""
    totals = rows.groupBy("_range").agg(F.sum(amount).alias("total"))
    reach = totals.select("total", F.col("_range").alias("from"), F.explode(F.sequence("_range", F.lit(ranges - 1))).alias("_range"))
    return reach.groupBy("_range").agg(F.sum(F.when(F.col("from") < F.col("_range"), F.col("total")).otherwise(0)).alias("_before"))


def positions(df: DataFrame, order: list[Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`name` is the place, from 1, of each row in `order`, within the rows that share `by`.

    The order should be total; rows that tie take their places in no fixed order. Null keys of `by` form a group of their own.
    """
    rows, ranges = _ranged(df, [F.col(c) for c in by] + order)
    placed = rows.join(_before(rows, ranges, F.lit(1)), "_range").withColumn(name, F.col("_place") + F.col("_before") + 1)
    out = placed.select(*df.columns, name)
    if not by:
        return out
    first = out.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(name).alias("_first"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.join(first, match).select(*df.columns, (F.col(name) - F.col("_first") + 1).alias(name))


def running_sums(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """`name` is the sum of `amount` over this row and all before it in `order`; null where all of these are null."""
    rows, ranges = _ranged(df, order)
    within = F.sum(amount).over(Window.partitionBy("_range").orderBy("_place"))
    out = rows.withColumn("_within", within).join(_before(rows, ranges, F.col(amount)), "_range")
    total = F.when(F.col("_within").isNull() & (F.col("_before") == 0), None).otherwise(F.coalesce("_within", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return out.select(*df.columns, total.alias(name))
