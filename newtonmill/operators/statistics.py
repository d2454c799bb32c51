"""Statistics of a column by group, as aggregates that Spark sums before the shuffle."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def basic(df: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """n, total, least and largest value and where they are; of equal values the least key counts."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"),
        F.min_by(key, F.struct(value, key)).alias("at_least"), F.max_by(key, F.struct(F.col(value), -F.col(key))).alias("at_largest"),
    )


def population(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population variance and its root; 0 for a single value."""
    return df.groupBy(by).agg(F.avg(value).alias("mx"), F.var_pop(value).alias("dx"), F.stddev_pop(value).alias("sigma"))


def association(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return df.groupBy(by).agg(F.covar_pop(x, y).alias("cov"), F.corr(x, y).alias("corr"))


def kth(df: DataFrame, by: str, value: str, key: str, k: int) -> DataFrame:
    """The row with the k-th smallest value of each group; equal values in order of key. Spark keeps k rows of a group in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(value, key))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("rank") == k)
