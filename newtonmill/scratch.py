"""Shared scratch tables, by which iterations and operators cut lineage.

Tables go to the folder in spark.checkpoint.dir, which all executors and the driver share, so a lost executor costs only
its running tasks. Where the setting is absent and Spark is local, a temporary folder takes its place.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the shared scratch folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(scratch, "local", None)
    if root is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = scratch.local = tempfile.mkdtemp(prefix="newtonmill-")
    return f"{root.rstrip('/')}/newtonmill-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """df written to the scratch folder and read again: computed once, with no lineage behind it."""
    spark, schema, path = df.sparkSession, df.schema, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files of a saved table that is no longer needed."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
