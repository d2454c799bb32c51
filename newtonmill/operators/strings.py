"""Maps with string keys as tables (key, ...): lookups by key and prefix."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_prefix(words: DataFrame, prefix: str) -> DataFrame:
    return words.where(F.col("key").startswith(prefix))


def put(words: DataFrame, more: DataFrame) -> DataFrame:
    """The map with the pairs (key, value) of more in it; a key that both have takes the value of more."""
    new = more.groupBy("key").agg(F.max("value").alias("value"))
    return words.join(new.select("key"), "key", "left_anti").unionByName(new)


def get(words: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key, ...) with value, null where the map lacks the key."""
    return keys.join(words.select("key", "value"), "key", "left")


def has(words: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with `found`."""
    return keys.join(words.select("key", F.lit(True).alias("found")), "key", "left").fillna(False, ["found"])


def remove(words: DataFrame, keys: DataFrame) -> DataFrame:
    """The map without the keys given; those that it lacks change nothing."""
    return words.join(keys.select("key"), "key", "left_anti")


def longest_prefix(texts: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """texts with `key`, the longest word that the column begins with; rows without one are left out, repeated rows stay.

    Each distinct text is looked up by its prefixes of the lengths that words have, so the joins are on equality."""
    lengths = [r[0] for r in words.select(F.length("key").alias("n")).distinct().collect()]
    text = F.col("text")
    prefixes = F.array_distinct(F.array(*(F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in sorted(lengths))).cast("array<string>"))
    own = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    hit = own.select("text", F.explode(F.array_compact(prefixes)).alias("key")).join(words.select("key").distinct(), "key", "left_semi")
    best = hit.groupBy("text").agg(F.max_by("key", F.length("key")).alias("found_key")).withColumnRenamed("text", "found_text")
    return texts.join(best, F.col(column) == F.col("found_text")).drop("found_text").withColumnRenamed("found_key", "key")
