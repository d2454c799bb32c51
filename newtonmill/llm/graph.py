"""Connected components of a distributed edge list, without collecting edges or any node's neighbours."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node reaches, from links (a, b).

    Alternates two star contractions, which need the least neighbour of a node alone; a node with very many
    links is summed before the shuffle, and the joins may be split by Spark. Each round is a table of its own.
    Nodes without links are absent; self-links and nulls are ignored.
    """
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
        edges = save(_small(_large(edges).distinct()).distinct())
