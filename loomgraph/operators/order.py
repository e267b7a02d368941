"""Numbers, neighbours and runs along an order of a whole table, without a task that holds it.

Rows are dealt to ranges of the order; what a range must know of those before it (how many rows, the last row, a running sum) is a
row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _ranges(df: DataFrame, order: tuple) -> tuple[DataFrame, W]:
    """df with `_range`, stored so that later reads see the same ranges, and the window over a range."""
    placed = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return placed, W.partitionBy("_range").orderBy(*order)


def _carried(per_range: DataFrame, value: str) -> DataFrame:
    """(_range, _before): of (_range, value), the sum over the ranges before; there are as many rows as shuffle partitions."""
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(per_range.select("_range", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_before")))


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with the rows' numbers, from 1. Rows that tie in the order are numbered in any order, so it should tell all rows apart."""
    placed, own = _ranges(df, order)
    before = _carried(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")), "n")
    return placed.withColumn(name, F.row_number().over(own)).join(before, "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_before")


def with_previous(df: DataFrame, *order: Column | str, of: Column, name: str = "previous") -> DataFrame:
    """df with `of` of the row before; null for the first row (and where the row before has null)."""
    return _neighbour(df, order, of, name, before=True)


def with_next(df: DataFrame, *order: Column | str, of: Column, name: str = "next") -> DataFrame:
    """df with `of` of the row after; null for the last row (and where the row after has null)."""
    return _neighbour(df, order, of, name, before=False)


def _neighbour(df: DataFrame, order: tuple, of: Column, name: str, before: bool) -> DataFrame:
    placed, own = _ranges(df.withColumn("_of", F.struct(of.alias("v"))), order)
    placed = placed.withColumn("_at", F.row_number().over(own))
    ends = placed.groupBy("_range").agg((F.max_by if before else F.min_by)("_of", "_at").alias("_edge"))
    row = W.orderBy("_range")
    ends = F.broadcast(ends.select("_range", (F.lag if before else F.lead)("_edge").over(row).alias("_edge")))  # a row for each range
    inner = (F.lag if before else F.lead)("_of").over(own)
    return placed.withColumn(name, inner).join(ends, "_range").withColumn(name, F.coalesce(name, "_edge")["v"]).drop("_range", "_of", "_at", "_edge")


def running_sum(df: DataFrame, *order: Column | str, of: Column, name: str = "running") -> DataFrame:
    """df with the sum of `of` up to and with each row."""
    placed, own = _ranges(df.withColumn("_of", of), order)
    before = _carried(placed.groupBy("_range").agg(F.sum("_of").alias("n")), "n")
    total = F.sum("_of").over(own.rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn(name, total).join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_of", "_before")


def recent(df: DataFrame, time: str, span: int, name: str = "recent") -> DataFrame:
    """df with the number of rows whose time (a long) lies less than `span` before its own or equals it.

    Rows meet in buckets of `span`, those of the bucket before as well, so a task holds two buckets."""
    bucket = F.floor(F.col(time) / span)
    both = df.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).withColumn("_own", F.col("_bucket") == bucket)
    w = W.partitionBy("_bucket").orderBy(time).rangeBetween(-span + 1, 0)
    return both.withColumn(name, F.count(F.lit(1)).over(w)).where("_own").drop("_bucket", "_own")
