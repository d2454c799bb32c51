"""Mini-batches of a stream as rounds: each batch moves the iterate by a regularised Newton step on its own samples."""

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import solvers
from ..plans.compressors import unpacked
from ..plans.training import client_sums
from ..sources import files


class WarmStart:
    """The iterate over a stream of samples (features times label). Its history is a folder of any store that Spark
    reads, with a small file for each batch, beside the stream's own checkpoint: a batch that is replayed after a failure,
    also by another driver, finds its place and is not counted twice."""

    def __init__(self, d: int, lam: float, history: str | None = None, spark: SparkSession | None = None) -> None:
        self.d, self.lam, self.path, self.steps = d, lam, history, {}
        spark = spark or SparkSession.getActiveSession()
        if history and files.exists(spark, history):
            steps = map(json.loads, [r.value for r in spark.read.text(history).collect()])  # a line for each batch
            self.steps = {s["batch"]: s for s in steps}

    def before(self, batch: int) -> tuple[np.ndarray, int]:
        """The iterate before a batch, and the samples seen until then."""
        earlier = [b for b in self.steps if b < batch]
        s = self.steps[max(earlier)] if earlier else {"x": [0.0] * self.d, "n": 0}
        return np.array(s["x"]), s["n"]

    def take(self, df: DataFrame, batch: int) -> None:
        x, seen = self.before(batch)
        rows = client_sums(df.withColumn("client_id", F.lit(0)), x).collect()
        if rows:
            r = rows[0]
            g = np.frombuffer(r.g) / r.n + self.lam * x
            h = unpacked(np.frombuffer(r.h) / r.n, self.d) + self.lam * np.eye(self.d)
            x = x - r.n / (seen + r.n) * solvers.solve(h, g)
            seen += r.n
        self.steps[batch] = {"batch": batch, "x": x.tolist(), "n": seen}
        if self.path:
            files.write_text(df.sparkSession, f"{self.path}/{batch}.json", json.dumps(self.steps[batch]))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def windowed_loss(stream: DataFrame, x: list[float], late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, n, loss) of event-time windows of a stream with ts and features: how well an iterate does on new data."""
    m = F.aggregate(F.zip_with("features", F.array(*map(F.lit, x)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    loss = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg(loss).alias("loss")).select(F.col("w.start").alias("start"), "n", "loss")
