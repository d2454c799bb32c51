"""Synthetic data sets: every value depends on the seed and its row alone, not on how rows are dealt to tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import uniform

#: Ranges of the feature rules.
RULES = {"unit": (0.0, 1.0), "signed": (-1.0, 1.0), "wide": (-10.0, 10.0)}


def class_step(samples: int, seed: int) -> int:
    """The factor of the bijection of row numbers that deals out classes: the next odd number without a common divisor."""
    return next(k for k in range((2654435761 + 2 * seed) % samples | 1, 3 * samples + 3) if np.gcd(k, samples) == 1)


def uniform_classes(spark: SparkSession, samples: int, d: int, seed: int, classes: list[tuple[float, float]], rule: str = "signed") -> DataFrame:
    """(sample_id, label, features): uniform features, and classes (label, share) with exact counts in a seeded order; the last class takes the rest.

    The order is a bijection of the row numbers, so labels need no sort over all rows."""
    low, high = RULES[rule]
    counts = [int(samples * share) for _, share in classes[:-1]]
    bounds = np.cumsum([*counts, samples - sum(counts)]).tolist()
    step = class_step(samples, seed)
    wide = lambda x: x.cast("decimal(38,0)")  # noqa: E731  a long would overflow from some three thousand million samples on
    place = F.pmod(wide(F.col("id")) * wide(F.lit(step % samples)) + wide(F.lit(seed % samples)), wide(F.lit(samples))).cast("long")
    label = F.lit(float(classes[-1][0]))
    for (value, _), bound in reversed(list(zip(classes[:-1], bounds[:-1]))):
        label = F.when(place < bound, float(value)).otherwise(label)
    features = F.array(*(F.lit(low) + F.lit(high - low) * uniform(F.col("id"), F.lit(seed), F.lit(k)) for k in range(d)))
    return spark.range(samples).select(F.col("id").alias("sample_id"), label.alias("label"), features.alias("features"))


def federated(spark: SparkSession, clients: int, rows: int, d: int, seed: int, iid: bool = False) -> DataFrame:
    """(client_id, label, features): each client draws its own model, offset and features from normal distributions with decaying variances; labels are Bernoulli."""

    def kernel(batches):
        decay = np.arange(1, d + 1) ** -0.6
        for batch in batches:
            for c in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, c])
                model = np.random.default_rng([seed, 1 << 20]) if iid else rng
                offset = 0.0 if iid else rng.normal()
                w, b, mean = model.normal(offset, 1, d), model.normal(offset), rng.normal(0.0 if iid else rng.normal(), 1, d)
                x = mean * (not iid) + rng.normal(size=(rows, d)) * decay
                y = np.where(rng.random(rows) < 1 / (1 + np.exp(-(x @ w + b))), 1.0, -1.0)
                yield pa.RecordBatch.from_arrays([pa.array([c] * rows, pa.int32()), pa.array(y), pa.array(list(x), pa.list_(pa.float64()))], ["client_id", "label", "features"])

    return spark.range(clients).mapInArrow(kernel, "client_id int, label double, features array<double>")
