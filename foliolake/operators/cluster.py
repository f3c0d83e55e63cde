"""Grouping along an axis: gaps and islands, anchored groups, running means, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs within ``keys``; ``breaks`` says, with ``lag`` in it through ``previous``, where a new one begins."""
    own = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(own) == 1
    flag = F.when(first, 1).when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)
    marked = rows.withColumn("__b", flag)
    return marked.withColumn(name, F.sum("__b").over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__b")


def previous(column: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def anchored(values: Column, tolerance: float) -> Column:
    """Groups of a sorted array: a value joins while it is within the tolerance of its group's first."""

    def step(acc: Column, x: Column) -> Column:
        new = F.abs(x - acc["head"]) > tolerance
        return F.struct(F.when(new, x).otherwise(acc["head"]).alias("head"), F.concat(acc["group"], F.array(F.element_at(acc["group"], -1) + F.when(new, 1).otherwise(0))).alias("group"))

    begin = F.struct(values[0].alias("head"), F.array(F.lit(0)).alias("group"))
    folded = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), begin, step)["group"]
    return F.when(F.size(values) > 0, folded).otherwise(F.array().cast("array<int>"))


def running_means(values: Column, tolerance: float) -> Column:
    """Levels of a sorted array: a value joins while it is within the tolerance of its level's mean so far; the means."""
    one = lambda x: F.struct(x.alias("mean"), F.lit(1).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = F.abs(x - last["mean"]) <= tolerance
        grown = F.struct(((last["mean"] * last["n"] + x) / (last["n"] + 1)).alias("mean"), (last["n"] + 1).alias("n"))
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(one(x))))

    levels = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(one(values[0])), step)
    return F.when(F.size(values) > 0, F.transform(levels, lambda s: s["mean"])).otherwise(F.array().cast("array<double>"))


def merged_intervals(rows: DataFrame, keys: list[str], low: str, high: str, gap: float) -> DataFrame:
    """(keys, low, high): intervals of a key that overlap or lie within ``gap`` made one."""
    own = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(F.col(low) - reach <= gap, 0).otherwise(1))
    marked = marked.withColumn("__k", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__k").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__k")
