"""Runs of equal values along recordings of any length: ranges of a recording are numbered apart and then carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording"


def numbered_runs(rows: DataFrame, value: Column, order: list[str], span: int, name: str, opens: Column | None = None) -> DataFrame:
    """rows with name, the number of their run of equal values within the recording, from 0; a null value changes nothing.
    Where opens is true a run begins whatever the value; the first row of a range must not be such a one.

    The first column of order is a whole number; span of it make a range, numbered by a task of its own.  A range's first and
    last value and its count, one row a range, then say with which number it begins.
    """
    ranges = [KEY, "_range"]
    local = Window.partitionBy(*ranges).orderBy(*order)
    changes = lambda now, before: F.coalesce((now != before).cast("long"), F.lit(0))
    marked = rows.withColumns({"_range": F.floor(F.col(order[0]) / span), "_value": value})
    fresh = changes(F.col("_value"), F.lag("_value").over(local))
    fresh = fresh if opens is None else F.when(opens, F.lit(1).cast("long")).otherwise(fresh)
    marked = marked.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(local))
    at = F.struct(*order)
    ends = marked.groupBy(*ranges).agg(F.min_by("_value", at).alias("head"), F.max_by("_value", at).alias("tail"), F.max(name).alias("n"))
    along = Window.partitionBy(KEY).orderBy("_range")
    step = changes(F.col("head"), F.lag("tail").over(along)) + F.coalesce(F.lag("n").over(along), F.lit(0))
    carried = ends.withColumn("_step", step).select(F.col(KEY).alias("_k"), F.col("_range").alias("_r"), F.sum("_step").over(along).alias("_before"))
    on = F.col(KEY).eqNullSafe(F.col("_k")) & F.col("_range").eqNullSafe(F.col("_r"))
    return marked.join(carried, on).withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)
