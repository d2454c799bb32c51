"""Sparse text data, `label index:value ...`: reader, one-pass profile, dense form and writer."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tokens


def read_text(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """(line): the non-empty lines of text files; with places also (place), by which lines are in the order of files, and in them as they stand."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path, lineSep="\n").select(*[place.alias("place")] * places, F.regexp_replace("value", "\r", "").alias("line"))
    return lines.where(F.length(F.trim("line")) > 0)


def parse(lines: DataFrame, *keep: str, separators: str = r"\t ", pair: str = ":") -> DataFrame:
    """keep, label, features (map<int,double>) of each line; a token without the pair sign is the label. Indices stay as they are, from 0 or from 1."""
    parts = tokens(F.col("line"), separators)
    label = F.filter(parts, lambda t: ~t.contains(pair))[0].cast("double")
    entries = F.transform(F.filter(parts, lambda t: t.contains(pair)), lambda t: F.struct(F.split_part(t, F.lit(pair), F.lit(1)).cast("int").alias("i"), F.split_part(t, F.lit(pair), F.lit(2)).cast("double").alias("v")))
    return lines.select(*keep, label.alias("label"), F.map_from_entries(entries).alias("features"))


def profile(samples: DataFrame) -> DataFrame:
    """One row: samples, least and greatest feature index over all rows, least and greatest label, number of labels, pairs, and ok (exactly two labels)."""
    keys = F.map_keys("features")
    out = samples.agg(
        F.count("*").alias("samples"), F.min(F.array_min(keys)).alias("min_index"), F.max(F.array_max(keys)).alias("max_index"),
        F.min("label").alias("min_label"), F.max("label").alias("max_label"), F.count_distinct("label").alias("labels"), F.sum(F.size(keys)).alias("pairs"),
    )
    return out.withColumn("ok", F.col("labels") == 2)


def densify(samples: DataFrame, min_index: int, max_index: int, midpoint: float | None = None, intercept: bool = False) -> DataFrame:
    """features as array<double>, rebased by min_index, with 1 at the end for an intercept; labels under midpoint become -1, others 1."""
    items = lambda m: F.transform(F.sequence(F.lit(min_index), F.lit(max_index)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
    # as an array's only member the map is worked out once for a row, not once for an index
    dense = F.transform(F.array("features"), items)[0]
    dense = F.array_append(dense, F.lit(1.0)) if intercept else dense
    label = F.col("label") if midpoint is None else F.when(F.col("label") < midpoint, -1.0).otherwise(1.0)
    return samples.withColumns({"label": label, "features": dense})


def to_line(label: Column, features: Column) -> Column:
    """+1 or -1, then index:value of each item that is not 0, from index 0."""
    entries = F.filter(F.transform(features, lambda v, i: F.when(v != 0, F.concat(i.cast("string"), F.lit(":"), v.cast("string")))), lambda t: t.isNotNull())
    return F.concat_ws(" ", F.when(label < 0, "-1").otherwise("+1"), F.array_join(entries, " "))


def write_text(samples: DataFrame, path: str, by_client: bool = False) -> None:
    """Writes samples as text, a folder for each client if by_client."""
    lines = samples.select(*["client_id"] * by_client, to_line(F.col("label"), F.col("features")).alias("line"))
    (lines.write.partitionBy("client_id") if by_client else lines.write).text(path)


def read_dataset(spark: SparkSession, path: str, intercept: bool = True, remap: bool = True, places: bool = False, separators: str = r"\t ", pair: str = ":") -> DataFrame:
    """(label, features), and place if asked for: reads, profiles and densifies; fails unless there are exactly two labels."""
    samples = parse(read_text(spark, path, places), *["place"] * places, separators=separators, pair=pair)
    p = profile(samples).first()
    if not p.ok:
        raise ValueError(f"two labels are needed, found {p.labels}")
    return densify(samples, p.min_index, p.max_index, (p.min_label + p.max_label) / 2 if remap else None, intercept)


def read_fixed(spark: SparkSession, path: str, rows: int, clients: int, d: int) -> DataFrame:
    """(client_id, label, features) of the first `rows` lines of text with 1-based indices and a known width, in equal contiguous shares.

    Lines are numbered file by file; a file's lines keep their order."""
    from ..operators.partition import assign_clients

    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")).where(F.length(F.trim("line")) > 0)
    # file order is the order of the ids, so a range of them is a range of lines
    first = lines.orderBy("at").limit(rows)
    from ..operators.partition import row_index

    dealt = assign_clients(row_index(first, "at"), clients, rows)
    return densify(parse(dealt, "client_id"), 1, d).where("client_id is not null").select("client_id", "label", "features")
