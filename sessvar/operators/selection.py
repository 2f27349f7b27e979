"""Exact order statistics of few groups with very many values, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Cells of a histogram; values of a range that one task sorts.
CELLS, SORTED = 4096, 100_000


def _narrowed(values: DataFrame, ranges: DataFrame, by: list[str], cells: int) -> DataFrame:
    """The cell of each range that holds its rank: the least and greatest value in it, and the rank within it."""
    inside = values.join(F.broadcast(ranges), by).filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    # monotone in the value, so a cell's values are all those between its least and its greatest
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))).otherwise(F.lit(0).cast("long"))
    counted = inside.groupBy(*by, "which", "rank", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "which").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    return placed.select(*by, "which", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high")


def medians(rows: DataFrame, by: list[str], value: str, cells: int = CELLS, most: int = SORTED) -> DataFrame:
    """(by, n, median) over the values that are not null or NaN; groups without any have no row.

    A histogram narrows both middle ranks to one cell each, again until a cell holds ``most`` values at most or one value alone; only those are sorted.
    For few groups: a row for each reaches the driver with every histogram. ``rows`` is read at least three times, and so is saved first.
    """
    kept = rows.select(*by, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    # a null key is a group as well, and joins as one
    flags = [f"null_{c}" for c in by]
    filled = {c: F.coalesce(F.col(c), F.lit("").cast(kept.schema[c].dataType) if dict(kept.dtypes)[c] == "string" else F.lit(0).cast(kept.schema[c].dataType)) for c in by}
    values = scratch.saved(kept.select(*(F.col(c).isNull().alias(f) for c, f in zip(by, flags, strict=True)), *(v.alias(c) for c, v in filled.items()), "value"), "medians")
    keys = [*by, *flags]
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    which = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank"))))
    ranges = whole.select(*keys, "n", "low", "high", which.alias("w")).select(*keys, "w.which", "w.rank", "n", "low", "high")
    spark, schema = rows.sparkSession, ranges.schema
    found = ranges.collect()
    sizes = {tuple(r[k] for k in keys): r["n"] for r in found if r["which"] == 0}
    while any(r["n"] > most and r["high"] > r["low"] for r in found):
        done = [r for r in found if not (r["n"] > most and r["high"] > r["low"])]
        found = done + _narrowed(values, spark.createDataFrame([r for r in found if r not in done], schema).drop("n"), keys, cells).select(*schema.names).collect()
    last = spark.createDataFrame(found, schema)
    inside = values.join(F.broadcast(last.filter("high > low")), keys).filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    # equal values are one row
    distinct = inside.groupBy(*keys, "which", "rank", "value").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys, "which").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sorted_ = distinct.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m"))).select(*keys, "which", "value")
    both = sorted_.unionByName(last.filter("high = low").select(*keys, "which", F.col("low").alias("value")))
    n = spark.createDataFrame([(*k, v) for k, v in sizes.items()], values.select(*keys).schema.add("n", "long")) if sizes else spark.createDataFrame([], values.select(*keys).schema.add("n", "long"))
    middle = both.groupBy(*keys).agg(F.avg("value").alias("median")).join(F.broadcast(n), keys)
    return middle.select(*(F.when(~F.col(f), F.col(c)).alias(c) for c, f in zip(by, flags, strict=True)), "n", "median")
