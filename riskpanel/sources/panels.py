"""Panel sources: wide tables, period-aligned tables, groups, crises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.operators.ranks import positions, running_sums


def from_wide(wide: DataFrame, date: str = "Date", value: str = "value") -> DataFrame:
    """One row per (date, entity) from a table with one column per entity; NaN becomes missing."""
    cols = [c for c in wide.columns if c != date]
    long = wide.unpivot([date], cols, "entity", value).withColumnRenamed(date, "date")
    return long.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def read_wide(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Wide table from parquet or csv files; csv should come with a schema."""
    reader = spark.read.format(fmt).options(**options)
    return from_wide((reader.schema(schema) if schema is not None else reader).load(path))


def align_periods(daily: DataFrame, balance: DataFrame, period: str = "quarter") -> DataFrame:
    """Copy the balance row of a period to each day in it: an equi join on the period start."""
    keyed = daily.withColumn("period", F.to_date(F.date_trunc(period, F.col("date"))))
    return keyed.join(balance, ["entity", "period"], "left")


def entity_positions(entities: DataFrame) -> DataFrame:
    """Position of each entity in name order, counted over ranges of names."""
    return positions(entities.select("entity").distinct(), [F.asc("entity")], "pos")


def group_bounds(groups: DataFrame) -> DataFrame:
    """Turn ordered (name, short name, count) rows into position ranges."""
    return running_sums(groups, [F.asc("short_name")], "cnt", "hi").withColumn("lo", F.col("hi") - F.col("cnt") + 1)


def entity_groups(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Range join of positions on group bounds (one row per group: a handful). Entities beyond the last group have none."""
    pos, bounds = entity_positions(entities), group_bounds(groups)
    return pos.join(bounds, (F.col("pos") >= F.col("lo")) & (F.col("pos") <= F.col("hi")), "left").select(
        "entity", "pos", "short_name")


def crisis_events(dates: DataFrame, events: DataFrame) -> DataFrame:
    """0/1 dummy by exact date."""
    hit = events.select(F.col("date"), F.lit(1).alias("hit")).distinct()
    return dates.join(hit, "date", "left").select("date", F.coalesce("hit", F.lit(0)).alias("crisis"))


def crisis_ranges(dates: DataFrame, crises: DataFrame) -> DataFrame:
    """0/1 dummy per crisis and date by interval join; `any_crisis` is 1 inside any of them."""
    inside = F.col("date").between(F.col("start_date"), F.col("end_date"))
    hits = dates.join(crises, inside, "left").groupBy("date").agg(
        F.sort_array(F.collect_set("name")).alias("names"))
    return hits.withColumn("any_crisis", (F.size("names") > 0).cast("int"))


def crisis_dummies(dates: DataFrame, crises: DataFrame) -> DataFrame:
    """Long form: one 0/1 row per (date, crisis). The crises travel as one array value, a handful of structs."""
    listed = crises.agg(F.collect_list(F.struct("name", "start_date", "end_date")).alias("c")).scalar()
    each = dates.select("date", F.explode(listed).alias("c"))
    return each.select("date", F.col("c.name").alias("name"),
                       F.col("date").between(F.col("c.start_date"), F.col("c.end_date")).cast("int").alias("crisis"))


def trim_trailing_blank(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the block of all-missing rows at the end of each series."""
    ahead = Window.partitionBy("entity").orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    filled = F.greatest(*[F.col(c).isNotNull().cast("int") for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNotNull().cast("int")
    return df.withColumn("_left", F.max(filled).over(ahead)).filter("_left = 1").drop("_left")
