"""Matrices in long form (i, j, v): algebra by joins and sums, predicates and norms by aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position(i: Column, j: Column) -> Column:
    """Place of (i, j), i <= j, in the upper triangle by columns."""
    return (j * (j + 1) / 2).cast("long") + i


def upper_triangle(indices: DataFrame) -> DataFrame:
    """(i, j, pos) for i <= j from a table with one row for each index j."""
    return indices.select(F.explode(F.sequence(F.lit(0), F.col("j"))).alias("i"), "j").select("i", "j", position(F.col("i"), F.col("j")).alias("pos"))


def flat(i: Column, j: Column, d: int) -> Column:
    return j * d + i


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matvec(m: DataFrame, x: DataFrame, turned: bool = False) -> DataFrame:
    """(i, v) of m x, or of its transpose times x; x: (i, v)."""
    row, column = ("j", "i") if turned else ("i", "j")
    return m.join(x.select(F.col("i").alias(column), F.col("v").alias("w")), column).groupBy(F.col(row).alias("i")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def combine(a: DataFrame, b: DataFrame, times: float = 1.0) -> DataFrame:
    """a + times * b, as one sum over both; entries absent from either are 0."""
    return a.unionByName(b.select("i", "j", (F.col("v") * times).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


#: Items of the second vector of an outer product in one row.
OUTER_BLOCK = 1024


def outer(u: DataFrame, w: DataFrame) -> DataFrame:
    """(i, j, v) of two vectors (i, v); w meets the rows of u in blocks of bounded size."""
    blocks = w.groupBy(F.floor(F.col("i") / OUTER_BLOCK).alias("b")).agg(F.collect_list(F.struct("i", "v")).alias("w"))
    return u.crossJoin(blocks.select("w")).select("i", "v", F.explode("w").alias("x")).select("i", F.col("x.i").alias("j"), (F.col("v") * F.col("x.v")).alias("v"))


def add_to_diagonal(m: DataFrame, c: float) -> DataFrame:
    return m.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") + c).otherwise(F.col("v")))


def scale_rows(m: DataFrame, diagonal: DataFrame) -> DataFrame:
    """A diagonal matrix (i, v) times m."""
    return m.join(diagonal.select("i", F.col("v").alias("w")), "i").select("i", "j", (F.col("w") * F.col("v")).alias("v"))


def scale_columns(m: DataFrame, diagonal: DataFrame) -> DataFrame:
    """m times a diagonal matrix (i, v)."""
    return transpose(scale_rows(transpose(m), diagonal))


def matvec_add(m: DataFrame, x: DataFrame, y: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """(i, v) of alpha * m x + beta * y, as one sum over both."""
    both = matvec(m, x).select("i", (F.col("v") * alpha).alias("v")).unionByName(y.select("i", (F.col("v") * beta).alias("v")))
    return both.groupBy("i").agg(F.sum("v").alias("v"))


def sub_matrix(m: DataFrame, top: int, left: int, rows: int, columns: int) -> DataFrame:
    """The entries of a rectangle, counted from its own corner."""
    inside = (F.col("i") >= top) & (F.col("i") < top + rows) & (F.col("j") >= left) & (F.col("j") < left + columns)
    return m.where(inside).select((F.col("i") - top).alias("i"), (F.col("j") - left).alias("j"), "v")


def get_row(m: DataFrame, i: int) -> DataFrame:
    return m.where(F.col("i") == i).select(F.col("j").alias("i"), "v")


def get_column(m: DataFrame, j: int) -> DataFrame:
    return get_row(transpose(m), j)


def set_row(m: DataFrame, i: int, x: DataFrame) -> DataFrame:
    """m with the row i replaced by the vector (i, v)."""
    return m.where(F.col("i") != i).unionByName(x.select(F.lit(i).alias("i"), F.col("i").alias("j"), "v"))


def set_column(m: DataFrame, j: int, x: DataFrame) -> DataFrame:
    return transpose(set_row(transpose(m), j, x))


def append_columns(m: DataFrame, more: DataFrame, width: int) -> DataFrame:
    """m of the width given, with the columns of more behind it."""
    return m.unionByName(more.select("i", (F.col("j") + width).alias("j"), "v"))


def remove_columns(m: DataFrame, first: int, n: int) -> DataFrame:
    """m without n columns; those behind them move up."""
    left = m.where((F.col("j") < first) | (F.col("j") >= first + n))
    return left.withColumn("j", F.when(F.col("j") >= first + n, F.col("j") - n).otherwise(F.col("j")))


def swap_rows(m: DataFrame, p: int, q: int) -> DataFrame:
    return m.withColumn("i", F.when(F.col("i") == p, F.lit(q)).when(F.col("i") == q, F.lit(p)).otherwise(F.col("i")))


def scale_row(m: DataFrame, i: int, c: float) -> DataFrame:
    return m.withColumn("v", F.when(F.col("i") == i, F.col("v") * c).otherwise(F.col("v")))


def add_row(m: DataFrame, source: int, target: int, c: float) -> DataFrame:
    """m with c times the row `source` added to the row `target`."""
    extra = m.where(F.col("i") == source).select(F.lit(target).alias("i"), "j", (F.col("v") * c).alias("v"))
    return m.unionByName(extra).groupBy("i", "j").agg(F.sum("v").alias("v"))


def swap_columns(m: DataFrame, p: int, q: int) -> DataFrame:
    return transpose(swap_rows(transpose(m), p, q))


def scale_column(m: DataFrame, j: int, c: float) -> DataFrame:
    return transpose(scale_row(transpose(m), j, c))


def add_column(m: DataFrame, source: int, target: int, c: float) -> DataFrame:
    return transpose(add_row(transpose(m), source, target, c))


def dense(m: DataFrame, most: int = 4096):
    """m as a numpy array on the driver; a matrix with an index of `most` or more is refused."""
    import numpy as np

    top = m.agg(F.coalesce(F.max(F.greatest("i", "j")), F.lit(-1)), F.max("i"), F.max("j")).first()
    if top[0] >= most:
        raise ValueError(f"a matrix of more than {most} rows or columns does not go to the driver")
    out = np.zeros(((top[1] if top[1] is not None else -1) + 1, (top[2] if top[2] is not None else -1) + 1))
    for r in m.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def rank(m: DataFrame) -> DataFrame:
    """One row: the rank, by elimination on the driver."""
    from ..plans import solvers

    return m.sparkSession.createDataFrame([(solvers.rank(dense(m)),)], "rank int")


def solvable(m: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether m x = b has a solution, and the dimension of the solutions of m x = 0; b: (i, v).

    Whole numbers are judged without a tolerance, others by elimination in doubles: their sums are rounded, so a consistent system would hardly ever hold exactly."""
    import numpy as np

    from ..plans import solvers

    a, rhs = dense(m), dense(b.select("i", F.lit(0).alias("j"), "v"))
    right = np.zeros(len(a))
    right[: min(len(a), len(rhs))] = rhs[: len(a), 0]
    if solvers.whole(a, right):
        own, both = solvers.whole_ranks(a, right)
        found, free = own == both, a.shape[1] - own
    else:
        x, null = solvers.gauss(a, right)
        found, free = x is not None, null.shape[1]
    beyond = bool(np.any(rhs[len(a) :]))
    return m.sparkSession.createDataFrame([(found and not beyond, free)], "feasible boolean, null_dimension int")


def orthogonal(m: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row: whether the columns of m are orthonormal, entry by entry of its transpose times itself."""
    own = matmul(transpose(m), m)
    off = F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)) <= eps
    width = m.agg(F.count_distinct("j").alias("width"), F.max("i").alias("top"), F.max("j").alias("last"))
    found = own.agg(F.coalesce(F.every(off), F.lit(False)).alias("near"), F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(0)).alias("on_diagonal"))
    return found.join(width, F.lit(True)).select((F.col("near") & (F.col("on_diagonal") == F.col("last") + 1) & (F.col("top") == F.col("last"))).alias("is_orthogonal"))


def symmetrized(upper: DataFrame) -> DataFrame:
    return upper.unionByName(transpose(upper.where("i < j")))


def upper_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, -1.0).where("i <= j")


def power(m: DataFrame, n: int) -> DataFrame:
    out = m
    for _ in range(n - 1):
        out = matmul(out, m)
    return out


def predicates(m: DataFrame, eps: float = 0.0) -> DataFrame:
    """One row of shape and form predicates. Symmetry compares each entry with its mirror in one group."""
    v, i, j = F.col("v"), F.col("i"), F.col("j")
    zero = F.abs(v) <= eps
    mirrored = m.groupBy(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).agg(
        F.sum(F.when(i <= j, v).otherwise(0.0)).alias("up"), F.sum(F.when(i >= j, v).otherwise(0.0)).alias("low"))
    pair = mirrored.agg(F.every(F.abs(F.col("up") - F.col("low")) <= eps).alias("is_symmetric"), F.every(F.abs(F.col("up") + F.col("low")) <= eps).alias("is_skew"))
    form = m.agg(
        (F.max("i") == 0).alias("is_row"), (F.max("j") == 0).alias("is_column"), (F.max("i") == F.max("j")).alias("is_square"),
        F.every((i == j) | zero).alias("is_diagonal"), F.every((F.abs(i - j) <= 1) | zero).alias("is_tridiagonal"),
        F.every((i <= j) | zero).alias("is_upper"), F.every((i >= j) | zero).alias("is_lower"), F.every(zero).alias("is_zero"),
    )
    return form.join(pair, F.lit(True))


def diagonally_dominant(m: DataFrame) -> DataFrame:
    """One row: whether each diagonal entry outweighs the rest of its row."""
    rows = m.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.abs("v")).otherwise(0.0)).alias("own"), F.sum(F.when(F.col("i") != F.col("j"), F.abs("v")).otherwise(0.0)).alias("rest"))
    return rows.agg(F.every(F.col("own") >= F.col("rest")).alias("dominant"))


def trace(m: DataFrame) -> DataFrame:
    return m.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)).alias("trace"))


def frobenius(m: DataFrame) -> DataFrame:
    """The norm over all entries stored."""
    return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"))


def frobenius_upper(m: DataFrame) -> DataFrame:
    """The norm of a symmetric matrix from its upper triangle: off-diagonal entries count twice."""
    w = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return m.where("i <= j").agg(F.sqrt(F.sum(w * F.col("v") * F.col("v"))).alias("frobenius"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether a and b have the same entries."""
    return combine(a, b, -1.0).agg(F.every(F.col("v") == 0).alias("equal"))


def jacobi_sweep(m: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """(i, v): one Jacobi sweep for m x = b."""
    off = m.where("i <> j").join(x.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("off"))
    own = m.where("i = j").select("i", F.col("v").alias("own"))
    return b.select("i", F.col("v").alias("rhs")).join(own, "i").join(off, "i", "left").select("i", ((F.col("rhs") - F.coalesce("off", F.lit(0.0))) / F.col("own")).alias("v"))
