"""Ordered series: interpolation between known points, and positions by order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save


def interpolate(points: DataFrame, queries: DataFrame, by: str, linear: bool = True) -> DataFrame:
    """queries (by, x) with y from points (by, x, y): linear between neighbours, or the value of the point at or before.

    Queries outside the points of their group take the nearest end's value. Points and queries are dealt out by ranges of
    group and x, so a group with very many rows is split over tasks; each range of a group then gets the last point before
    it and the first one behind it, of which there is a row for each range."""
    both = points.select(by, "x", "y", F.lit(0).alias("q")).unionByName(queries.select(by, "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("q")))
    both = save(both.repartitionByRange(by, "x", "q").withColumn("range", F.spark_partition_id()))
    known = F.when(F.col("q") == 0, F.struct("x", "y"))
    ends = both.groupBy(by, "range").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    order = Window.partitionBy(by).orderBy("range")
    ends = ends.select(
        by, "range", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("under"),
        F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("over"))
    # the next point is the last one seen from the other end, so both windows grow by a row at a time
    before = Window.partitionBy(by, "range").orderBy("x", "q", "y").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by, "range").orderBy(F.desc("x"), F.desc("q"), F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    t = both.withColumns({"lo": F.last(known, ignorenulls=True).over(before), "hi": F.last(known, ignorenulls=True).over(after)}).where("q = 1")
    t = t.join(ends.toDF("owner", "of", "under", "over"), F.col(by).eqNullSafe(F.col("owner")) & (F.col("range") == F.col("of")))
    t = t.select(by, "x", F.coalesce("lo", "under").alias("lo"), F.coalesce("hi", "over").alias("hi"))
    span = F.col("hi.x") - F.col("lo.x")
    between = F.when(span > 0, F.col("lo.y") + (F.col("hi.y") - F.col("lo.y")) * (F.col("x") - F.col("lo.x")) / span).otherwise(F.col("lo.y"))
    y = F.when(F.col("lo").isNull(), F.col("hi.y")).when(F.col("hi").isNull() | F.lit(not linear), F.col("lo.y")).otherwise(between)
    return t.select(by, "x", y.alias("y"))


def independent_k(u: Column, share: float) -> Column:
    """Whether a coordinate is kept, each by itself with the chance given; u: uniform numbers in [0, 1)."""
    return u < share
