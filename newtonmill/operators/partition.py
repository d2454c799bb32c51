"""Samples dealt out to clients: equal contiguous shares of an ordered or shuffled table, checks and unions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import save


def row_index(df: DataFrame, *order: Column | str, name: str = "sample_id") -> DataFrame:
    """df with each row's place in the order given, from 0, without bringing all rows to one task.

    Rows are dealt out by ranges and numbered within their tasks; a task counts from where the tasks before it end. Only
    the tasks' row counts go to the driver. The places are saved to the shared scratch folder before they are counted, so a
    lost executor or a tie in the order cannot change them between count and use."""
    ranged = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.task: r["count"] for r in ranged.groupBy(task.alias("task")).count().collect()}
    before = [0]
    for k in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(k, 0))
    start = F.element_at(F.lit(before).cast("array<bigint>"), task.cast("int") + 1)
    return ranged.withColumn(name, start + place).drop("_at")


def assign_clients(df: DataFrame, clients: int, rows: int) -> DataFrame:
    """df with client_id: each client gets floor(rows / clients) rows by sample_id; rows left over belong to nobody (null)."""
    share = rows // clients
    client = F.floor(F.col("sample_id") / share).cast("int") if share else F.lit(None).cast("int")
    return df.withColumn("client_id", F.when(client < clients, client))


def shuffled_order(key: Column, seed: int) -> Column:
    """An order that depends on key and seed alone."""
    return F.xxhash64(key, F.lit(seed))


def class_balance(samples: DataFrame) -> DataFrame:
    """(client_id, n, positive, negative, positive_percent) of each client."""
    positive = F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).cast("long")
    return samples.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"), positive.alias("positive"), (F.count("*") - positive).alias("negative"), F.round(100.0 * positive / F.count("*"), 6).alias("positive_percent"))


def check_split(whole: DataFrame, parts: DataFrame, skipped: int) -> DataFrame:
    """One row: whether no id is dealt twice, all dealt ids exist, and as many as expected are left over."""
    twice = parts.groupBy("sample_id").count().where("count > 1").agg(F.count("*").alias("twice"))
    unknown = parts.join(whole, "sample_id", "left_anti").agg(F.count("*").alias("unknown"))
    left = whole.join(parts, "sample_id", "left_anti").agg(F.count("*").alias("left_over"))
    counts = twice.join(unknown, F.lit(True)).join(left, F.lit(True))  # one row each
    return counts.withColumn("ok", (F.col("twice") == 0) & (F.col("unknown") == 0) & (F.col("left_over") == skipped))


def union_padded(*parts: DataFrame, width: int) -> DataFrame:
    """All parts in one table, feature arrays padded with 0 to the widest."""
    padded = [p.withColumn("features", F.concat("features", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("features")))) for p in parts]
    out = padded[0]
    for p in padded[1:]:
        out = out.unionByName(p)
    return out
