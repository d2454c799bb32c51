"""Objective, gradient and Hessian of L2-regularised logistic regression as aggregates over scalar columns.

For few features (WIDEST at most) all parts are aggregates of one pass, which Spark sums before the shuffle. Wider
problems go to plans.kernels. Samples have columns a0..a(d-1), already multiplied by their label of -1 or 1.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features up to which d(d+1)/2 aggregates in one plan pay.
WIDEST = 16


def margin(d: int, x: list[float]) -> Column:
    terms = [F.col(f"a{i}") * F.lit(float(x[i])) for i in range(d)]
    return sum(terms[1:], terms[0])


def loss(m: Column) -> Column:
    """log(1 + exp(-m)) without overflow."""
    return F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))


def sigmoid(m: Column) -> Column:
    return 1 / (1 + F.exp(-m))


def pairs(d: int) -> list[tuple[int, int]]:
    """The upper triangle by columns: (i, j) with i <= j."""
    return [(i, j) for j in range(d) for i in range(j + 1)]


def value(d: int, x: list[float], lam: float) -> Column:
    return F.avg(loss(F.col("m"))) + F.lit(lam / 2 * sum(v * v for v in x))


def gradient(d: int, x: list[float], lam: float) -> list[Column]:
    return [F.avg(-(1 - F.col("s")) * F.col(f"a{i}")) + F.lit(lam * float(x[i])) for i in range(d)]


def hessian(d: int, lam: float) -> list[Column]:
    w = F.col("s") * (1 - F.col("s"))
    return [F.avg(w * F.col(f"a{i}") * F.col(f"a{j}")) + F.lit(lam if i == j else 0.0) for i, j in pairs(d)]


def with_margin(samples: DataFrame, d: int, x: list[float]) -> DataFrame:
    return samples.withColumn("m", margin(d, x)).withColumn("s", sigmoid(F.col("m")))


def evaluate(samples: DataFrame, d: int, x: list[float], lam: float, by: list[str] | None = None, second: bool = True) -> DataFrame:
    """by, n, f, g (array) and h (array, upper triangle by columns) of the samples or of each group: one pass, one exchange of sums."""
    parts = [F.count("*").alias("n"), value(d, x, lam).alias("f"), F.array(*gradient(d, x, lam)).alias("g")]
    if second:
        parts.append(F.array(*hessian(d, lam)).alias("h"))
    return with_margin(samples, d, x).groupBy(*by or []).agg(*parts)


def certificates(grad_norm: Column, mu: float) -> dict[str, Column]:
    """Bounds from the gradient's norm: the value gap, the distance, and the looser distance figure some logs carry."""
    return {"value_gap": grad_norm * grad_norm / (2 * mu), "dist_bound": grad_norm / mu, "legacy_distance_gap": 2 * grad_norm * grad_norm / mu}
