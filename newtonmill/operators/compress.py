"""Compressors as relations over entries (client_id, pos, v) of packed upper triangles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import power_of_two_floor


def top_k(entries: DataFrame, k: int, by_sign: bool = False) -> DataFrame:
    """The k entries of each client with the greatest magnitude (or value); of equal ones the smaller position wins."""
    rank = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc(F.col("v") if by_sign else F.abs("v")), "pos"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k)


def energy(pos_is_diagonal: Column, v: Column) -> Column:
    """Share of an entry in the squared norm of the whole symmetric matrix."""
    return F.when(pos_is_diagonal, v * v).otherwise(2 * v * v)


def prefix_energy(entries: DataFrame) -> DataFrame:
    """rank, energy and the energy of all entries up to that rank, by falling magnitude; entries: client_id, pos, i, j, v."""
    order = Window.partitionBy("client_id").orderBy(F.desc(F.abs("v")), "pos")
    own = entries.withColumn("energy", energy(F.col("i") == F.col("j"), F.col("v")))
    return own.withColumns({"rank": F.row_number().over(order), "kept": F.sum("energy").over(order.rowsBetween(Window.unboundedPreceding, 0))})


def top_lek(entries: DataFrame, k: int, delta: float, slack: float = 0.1) -> DataFrame:
    """The fewest of the k greatest entries of each client whose residual is within (1 - delta) of the squared norm plus slack, k of them if none is."""
    ranked = prefix_energy(entries).withColumn("whole", F.sum("energy").over(Window.partitionBy("client_id")))
    enough = F.min(F.when(F.col("whole") - F.col("kept") <= (1 - delta + slack) * F.col("whole"), F.col("rank"))).over(Window.partitionBy("client_id"))
    return ranked.withColumn("enough", F.least(F.coalesce(enough, F.lit(k)), F.lit(k))).where("rank <= enough")


def rand_seq_k(entries: DataFrame, k: int, n: int, start: Column, scale: bool = True) -> DataFrame:
    """k consecutive positions from start on, round the end; values times n / k if scale."""
    chosen = entries.where(F.pmod(F.col("pos") - start + n, F.lit(n)) < k)
    return chosen.withColumn("v", F.col("v") * F.lit(n / k)) if scale else chosen


def rand_k(entries: DataFrame, k: int, n: int, *key: Column, scale: bool = True) -> DataFrame:
    """k positions of each client in the order of a digest of key and position; values times n / k if scale."""
    digest = F.md5(F.concat_ws(":", *(c.cast("string") for c in key), F.col("pos").cast("string")))
    chosen = entries.withColumn("rank", F.row_number().over(Window.partitionBy("client_id").orderBy(digest, "pos"))).where(F.col("rank") <= k)
    return chosen.withColumn("v", F.col("v") * F.lit(n / k)) if scale else chosen


def natural(entries: DataFrame) -> DataFrame:
    return entries.withColumn("v", power_of_two_floor(F.col("v")))


def bernoulli(entries: DataFrame, keep: Column, probability: float) -> DataFrame:
    """Entries where keep (uniform in [0, 1)) is under the probability, divided by it."""
    return entries.where(keep < probability).withColumn("v", F.col("v") / probability)


def bucket_of(entries: DataFrame, size: int, chosen: Column, buckets: int) -> DataFrame:
    """One of the contiguous buckets of positions, values times their number."""
    return entries.where(F.floor(F.col("pos") / size) == chosen).withColumn("v", F.col("v") * buckets)


def dithering(entries: DataFrame, levels: int, u: Column) -> DataFrame:
    """Random dithering: magnitudes over the client's norm, rounded at random to multiples of 1 / levels."""
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("client_id")))
    level = F.floor(F.lit(levels) * F.abs("v") / norm + u)
    return entries.withColumn("v", F.when(norm > 0, F.signum("v") * norm * level / levels).otherwise(0.0))


def rounded(v: Column, base: float) -> Column:
    """Biased rounding to the nearest power of base by magnitude; 0 stays."""
    low = F.pow(F.lit(base), F.floor(F.log(F.abs(v)) / F.log(F.lit(base))))
    near = F.when(F.abs(v) - low <= base * low - F.abs(v), low).otherwise(base * low)
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * near)


def scatter_add(corrections: DataFrame, weight: float) -> DataFrame:
    """(pos, v): weighted sum of all clients' sparse corrections, summed in each task before the shuffle."""
    return corrections.groupBy("pos").agg((F.sum("v") * weight).alias("v"))


def message_bytes(scalars: Column, indices: Column) -> tuple[Column, Column]:
    """Bytes of 8-byte scalars and of 4-byte indices."""
    return scalars * 8, indices * 4
