"""Quality rules. Each returns its violations as rows (rule, key, detail); no rows means clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskpanel.functions.scalar import half_up

FIRM_NAME = "^(?i)[A-Z][A-Z0-9]{0,11}$"


def _violation(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _cell() -> Column:
    return F.concat_ws("@", F.col("entity"), F.col("date").cast("string"))


def missing_values(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.unpivot(["entity", "date"], cols, "series", "value")
    return _violation(long.filter(F.col("value").isNull()), "missing", _cell(), F.col("series"))


def non_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.unpivot(["entity", "date"], cols, "series", "value")
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return _violation(long.filter(bad), "non_finite", _cell(), F.col("series"))


def negatives(df: DataFrame, cols: list[str], exempt: tuple = ()) -> DataFrame:
    long = df.unpivot(["entity", "date"], [c for c in cols if c not in exempt], "series", "value")
    return _violation(long.filter(F.col("value") < 0), "negative", _cell(), F.col("series"))


def duplicate_dates(df: DataFrame) -> DataFrame:
    counted = df.groupBy("entity", "date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _violation(counted, "duplicate_date", _cell(), F.col("n"))


def unsorted_dates(df: DataFrame, order: str, tie: str, span: int = 100_000) -> DataFrame:
    """Entities with rows dated before their predecessor in source order, and how many.

    The source order is cut into ranges of `span` order values, so a hot entity spreads over many tasks;
    the seam between two ranges is checked on one (first, last) row per range.
    """
    rows = df.withColumn("cut", F.floor(F.col(order) / span)).withColumn("at", F.struct(order, tie))
    inner = Window.partitionBy("entity", "cut").orderBy("at")
    late = rows.withColumn("prev", F.lag("date").over(inner)).filter(F.col("prev") > F.col("date"))
    inside = late.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    ends = rows.groupBy("entity", "cut").agg(F.min_by("date", "at").alias("first"), F.max_by("date", "at").alias("last"))
    seam = Window.partitionBy("entity").orderBy("cut")
    across = ends.withColumn("prev", F.lag("last").over(seam)).filter(F.col("prev") > F.col("first")).groupBy(
        "entity").agg(F.count(F.lit(1)).alias("n"))
    counted = inside.unionByName(across).groupBy("entity").agg(F.sum("n").alias("n"))
    return _violation(counted, "unsorted", F.col("entity"), F.col("n"))


def date_mismatch(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Dates of the table not in the calendar, and calendar dates no row has."""
    mine, theirs = df.select("date").distinct(), calendar.select("date").distinct()
    extra = _violation(mine.join(theirs, "date", "left_anti"), "date_extra", F.col("date"), F.lit(""))
    absent = _violation(theirs.join(mine, "date", "left_anti"), "date_absent", F.col("date"), F.lit(""))
    return extra.unionByName(absent)


def period_coverage(daily: DataFrame, balance: DataFrame, period: str = "quarter") -> DataFrame:
    need = daily.select("entity", F.to_date(F.date_trunc(period, F.col("date"))).alias("period")).distinct()
    gaps = need.join(balance.select("entity", "period"), ["entity", "period"], "left_anti")
    return _violation(gaps, "period_absent", F.col("entity"), F.col("period"))


def entity_mismatch(df: DataFrame, reference: DataFrame) -> DataFrame:
    mine, theirs = df.select("entity").distinct(), reference.select("entity").distinct()
    return _violation(mine.subtract(theirs), "entity_extra", F.col("entity"), F.lit("")).unionByName(
        _violation(theirs.subtract(mine), "entity_absent", F.col("entity"), F.lit("")))


def invalid_names(df: DataFrame) -> DataFrame:
    names = df.select("entity").distinct().filter(~F.col("entity").rlike(FIRM_NAME))
    return _violation(names, "invalid_name", F.col("entity"), F.lit(""))


def minimum_size(df: DataFrame, rows: int = 252, firms: int = 3) -> DataFrame:
    sizes = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    short = _violation(sizes.filter(F.col("n") < rows), "too_few_rows", F.col("entity"), F.col("n"))
    few = sizes.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < firms)
    return short.unionByName(_violation(few, "too_few_firms", F.lit(""), F.col("n")))


def group_counts(groups: DataFrame, entities: DataFrame) -> DataFrame:
    bad_count = groups.filter(F.col("cnt").isNull() | (F.col("cnt") <= 0) | (F.col("cnt") != F.floor("cnt")))
    bad_name = groups.filter(~F.col("short_name").rlike("^[A-Z]{2,}$"))
    n = entities.select("entity").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    total = groups.agg(F.sum("cnt").alias("total")).withColumn("n", n).filter("total <> n")
    return reduce(DataFrame.unionByName, [
        _violation(bad_count, "group_count", F.col("group_name"), F.col("cnt")),
        _violation(bad_name, "group_name", F.col("group_name"), F.col("short_name")),
        _violation(total, "group_total", F.col("total"), F.col("n"))])


def crisis_rules(crises: DataFrame, dates: DataFrame) -> DataFrame:
    """Reversed bounds, no overlap with the sample, long names, and a sample that is all crisis."""
    lo, hi = (dates.agg(f("date").alias("d")).scalar() for f in (F.min, F.max))
    c = crises.withColumns({"lo": lo, "hi": hi})
    inside = F.col("date").between(F.col("start_date"), F.col("end_date"))
    calm = dates.select("date").distinct().join(crises, inside, "left_anti").limit(1)
    none_calm = calm.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return reduce(DataFrame.unionByName, [
        _violation(c.filter("start_date > end_date"), "crisis_reversed", F.col("name"), F.col("start_date")),
        _violation(c.filter("end_date < lo or start_date > hi"), "crisis_outside", F.col("name"), F.col("start_date")),
        _violation(c.filter(F.length("name") > 30), "crisis_name", F.col("name"), F.length("name")),
        _violation(none_calm, "crisis_everywhere", F.lit(""), F.lit(""))])


def distress_rules(distress: DataFrame, earliest: int = 63, share: float = 0.25) -> DataFrame:
    early = distress.filter(F.col("distress_idx") < earliest)
    counts = distress.agg(F.count("distress_idx").alias("bad"), F.count(F.lit(1)).alias("n"))
    many = counts.filter(F.col("bad") > F.ceil(F.col("n") * share))
    return _violation(early, "distressed_early", F.col("entity"), F.col("distress_idx")).unionByName(
        _violation(many, "distressed_many", F.col("bad"), F.col("n")))


# The tables each family of measures needs.
CAPABILITIES = {
    "bubbles_detection": ("prices", "caps"), "component": ("returns",), "connectedness": ("returns",),
    "cross_entropy": ("returns", "cds"), "cross_quantilogram": ("returns",),
    "cross_sectional": ("returns", "caps", "liabilities"), "default": ("returns", "caps", "cds", "liabilities"),
    "liquidity": ("prices", "volumes", "caps"), "regime_switching": ("returns",), "spillover": ("returns",),
    "tail_dependence": ("returns",)}


def capabilities(spark, tables: set[str]) -> DataFrame:
    rows = [(k, all(t in tables for t in need)) for k, need in CAPABILITIES.items()]
    return spark.createDataFrame(rows, "family string, supported boolean")


def schema_differences(df: DataFrame, expected: StructType) -> list[str]:
    """Fields missing, extra or of another type, as text; known without running anything."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    return sorted([f"missing {n} {t}" for n, t in want.items() if n not in have]
                  + [f"extra {n} {t}" for n, t in have.items() if n not in want]
                  + [f"type {n} {have[n]} not {t}" for n, t in want.items() if n in have and have[n] != t])


def panel_contract(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Count, per declared column, missing cells and cells outside [lo, hi]."""
    aggs = []
    for c, (lo, hi) in ranges.items():
        out = F.lit(False)
        out = out | (F.col(c) < lo) if lo is not None else out
        out = out | (F.col(c) > hi) if hi is not None else out
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), F.count_if(out).alias(f"{c}_outside")]
    wide = df.agg(*aggs)
    return wide.unpivot([], wide.columns, "rule", "violations")


def table_contract(df: DataFrame, expected: StructType) -> DataFrame:
    """(rule, name, cells): what a table holds against a declared schema, counted over all rows in one pass.

    A declared column that is absent misses every cell. One of another type counts the cells that cannot be read as the declared
    type. One that must not be null counts its nulls. A column that is not declared counts its cells. Zeros are listed too.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f for f in expected}
    found = [("extra", c, F.count(F.col(f"`{c}`"))) for c in have if c not in want]
    for name, field in want.items():
        kind, cell = field.dataType.simpleString(), F.col(f"`{name}`")
        if name not in have:
            found.append(("missing", name, F.count(F.lit(1))))
            continue
        if have[name] != kind:
            found.append(("type", name, F.count_if(cell.isNotNull() & cell.try_cast(kind).isNull())))
        if not field.nullable:
            found.append(("null", name, F.count_if(cell.isNull())))
    listed = [F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name"), cells.alias("cells")) for rule, name, cells in found]
    if not listed:
        return df.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("name"), F.lit(0).cast("long").alias("cells"))
    return df.agg(F.array(*listed).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def missing_share(df: DataFrame, value: str, per_series: float = 0.70, overall: float = 0.25) -> DataFrame:
    """Series whose missing share is above the limit, plus the whole panel when it is."""
    gap = F.avg(F.col(value).isNull().cast("double"))
    each = df.groupBy("entity").agg(gap.alias("share")).filter(F.col("share") > per_series)
    whole = df.agg(gap.alias("share")).filter(F.col("share") > overall)
    return _violation(each, "series_missing", F.col("entity"), F.lit("")).unionByName(
        _violation(whole, "panel_missing", F.lit(""), F.lit("")))
