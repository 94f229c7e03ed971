"""As-of and interval joins by equi-joins and windows, so that neither is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Adds to each left row the value of the latest right row at or before its time, of equal times the largest.

    Both sides are stacked and one window carries the last right value forward, so no pairs are made.
    """
    stacked = left.withColumn("_left", F.lit(1)).unionByName(right.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(time, "_left", F.col(value).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    carried = F.last(value, ignorenulls=True).over(w)
    return stacked.withColumn(value, carried).where("_left = 1").drop("_left")


def seconds(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) / 1e6


def interval_join(left: DataFrame, right: DataFrame, by: list[str], time: str, after: float, until: float) -> DataFrame:
    """Pairs with left.time + after < right.time <= left.time + until (seconds).

    Time is cut into buckets as wide as the interval: a left row looks into the two or three buckets that its
    interval can touch, so the join is on keys and bucket, however many rows a key has.
    """
    width = max(until - after, 1.0)
    a = left.withColumn("_t", seconds(time)).drop(time)
    a = a.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_t") + after) / width), F.floor((F.col("_t") + until) / width))))
    b = right.withColumn("_u", seconds(time)).drop(time).withColumn("_b", F.floor(F.col("_u") / width))
    pairs = a.join(b, [*by, "_b"]).where((F.col("_u") > F.col("_t") + after) & (F.col("_u") <= F.col("_t") + until))
    return pairs.drop("_b", "_t", "_u")
