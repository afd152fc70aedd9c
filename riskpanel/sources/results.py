"""Result tables: indicators in, indicators out, the catalogue and the comparison input."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def indicators(df: DataFrame, serial: str, category: str, cols: list[str]) -> DataFrame:
    """Long indicator rows (serial, category, indicator, date, value) from one row per date."""
    long = df.unpivot(["date"], cols, "indicator", "value")
    return long.select(F.lit(serial).alias("serial"), F.lit(category).alias("category"), "indicator", "date", "value")


def write_indicators(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("category").parquet(path)


INDICATORS = "indicator string, date date, value double"
CATALOGUE = "category string, serial string, batch string, rows long, result_date date, written timestamp"


def store(df: DataFrame, root: str) -> str:
    """Write indicator rows below `root` and return the name of their batch.

    A batch is a folder of its own, split by category and serial, and counts from the moment its entries are in the
    catalogue, which are written last and read from what was written. So a job that dies leaves nothing that is read, and a
    repeated write replaces the categories and serials it holds. Of an empty table nothing is stored.
    """
    batch = uuid.uuid4().hex
    path = f"{root}/rows/batch={batch}"
    df.select("category", "serial", "indicator", "date", "value").write.partitionBy("category", "serial").parquet(path)
    rows = df.sparkSession.read.schema(f"{INDICATORS}, category string, serial string").parquet(path)
    entries = rows.groupBy("category", "serial").agg(F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("rows"),
                                                     F.max("date").alias("result_date"), F.current_timestamp().alias("written"))
    entries.coalesce(1).write.mode("append").parquet(f"{root}/catalogue")
    return batch


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """The entry that counts for each (category, serial): the one written last."""
    entries = spark.read.schema(CATALOGUE).parquet(f"{root}/catalogue")
    newest = F.max_by(F.struct("batch", "rows", "result_date"), F.struct("written", "batch"))
    return entries.groupBy("category", "serial").agg(newest.alias("e")).select("category", "serial", "e.*")


def stored(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the batches that count."""
    rows = spark.read.schema(f"{INDICATORS}, batch string, category string, serial string").parquet(f"{root}/rows")
    now = catalogue(spark, root).select("batch", F.col("category").alias("_category"), F.col("serial").alias("_serial"))
    same = (rows["batch"] == now["batch"]) & rows["category"].eqNullSafe(now["_category"]) & rows["serial"].eqNullSafe(now["_serial"])
    return rows.join(now, same, "left_semi").select("serial", "category", "indicator", "date", "value")


def drop_superseded(spark: SparkSession, root: str) -> list[str]:
    """Delete the batches that no entry counts, also those of dead jobs; not while a job is storing. Returns their names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {r.batch for r in catalogue(spark, root).select("batch").distinct().collect()}
    gone = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().removeprefix("batch=") not in kept]
    for path in gone:
        fs.delete(path, True)
    return sorted(path.getName().removeprefix("batch=") for path in gone)


def wide_view(df: DataFrame, column: str, values: list[str], value: str = "value") -> DataFrame:
    """Dates as rows, one column per entity or indicator."""
    return df.groupBy("date").pivot(column, values).agg(F.first(value))


def latest_results(catalogue: DataFrame, serial: str | None = None) -> DataFrame:
    """Newest result per category; the comparison goes last, and not at all when serials are mixed."""
    if serial is not None:
        catalogue = catalogue.filter(F.col("serial") == serial)
    newest = Window.partitionBy("category").orderBy(F.desc("result_date"), "serial")
    kept = catalogue.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn")
    serials = catalogue.agg(F.countDistinct("serial").alias("n")).scalar()
    last = (F.col("category") == "Comparison").cast("int")
    return kept.withColumn("serials", serials).filter((F.col("serials") == 1) | (last == 0)).withColumn(
        "is_last", last).drop("serials")


def comparison_input(results: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Stack chosen indicators as (date, label, value); each part is (prefix, long indicators, names)."""
    parts = [df.filter(F.col("indicator").isin(names)).select(
        "date", F.concat(F.lit(prefix + "-"), F.col("indicator")).alias("label"), "value")
        for prefix, df, names in results]
    return reduce(DataFrame.unionByName, parts)
