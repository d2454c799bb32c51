"""Independent solvers of the same problem, to check an optimum against."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mllib(samples: DataFrame, lam: float, tolerance: float = 1e-12, rounds: int = 300) -> np.ndarray:
    """The minimiser by Spark's own logistic regression; samples: features, already multiplied by their labels.

    Every sample also stands in with the opposite sign and class, which doubles the loss and leaves the minimiser, so
    that both classes occur."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    both = samples.select(array_to_vector("features").alias("features"), F.lit(1.0).alias("label")).union(samples.select(array_to_vector(F.transform("features", lambda v: -v)), F.lit(0.0)))
    fit = LogisticRegression(regParam=lam, standardization=False, fitIntercept=False, tol=tolerance, maxIter=rounds).fit(both)
    return fit.coefficients.toArray()


def newton(samples: DataFrame, lam: float, rounds: int = 20, tolerance: float = 1e-12) -> np.ndarray:
    """The minimiser by undamped Newton steps on the whole table's Hessian, for starts near enough to it."""
    from . import solvers
    from .compressors import unpacked
    from .training import client_sums

    d = samples.select(F.size("features").alias("d")).first().d
    x = np.zeros(d)
    for _ in range(rounds):
        r = client_sums(samples.select(F.lit(0).alias("client_id"), "features"), x).first()
        g = np.frombuffer(r.g) / r.n + lam * x
        if np.linalg.norm(g) <= tolerance:
            break
        x = x - solvers.solve(unpacked(np.frombuffer(r.h) / r.n, d), g, lam)
    return x
