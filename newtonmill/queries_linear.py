"""Further queries: matrix edits, row operations, solvers, random streams, compressor kernels and first training rounds, each beside its SQL."""

import numpy as np
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import compress as C
from .operators import matrix as M
from .operators import strings as W
from .queries import CLIENTS, K, LAMBDA, N_ENTRIES, SQL_DEALT, SQL_ENTRIES, SQL_LOSS, SQL_MATRIX, SQL_V, dealt, entries, matrix, query, rounded, table, trained, vector, vectors

# --- matrix edits ---------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_MATRIX} SELECT CAST(i - 1 AS INT) AS i, CAST(j - 2 AS INT) AS j, v FROM M WHERE i BETWEEN 1 AND 3 AND j BETWEEN 2 AND 5")
def sub_matrix(spark, sf_dir):
    return M.sub_matrix(matrix(spark, sf_dir), 1, 2, 3, 4)


@query(f"WITH {SQL_MATRIX} SELECT M.i, M.j, M.v*X.v AS v FROM M JOIN X ON X.i = M.j")
def scale_columns(spark, sf_dir):
    return M.scale_columns(matrix(spark, sf_dir), vector(spark))


@query(f"WITH {SQL_MATRIX} SELECT X.i, 2*s + 3*X.v AS v FROM X JOIN (SELECT M.i, sum(M.v*X.v) AS s FROM M JOIN X ON X.i = M.j GROUP BY M.i) t ON t.i = X.i")
def matvec_add(spark, sf_dir):
    return M.matvec_add(matrix(spark, sf_dir), vector(spark), vector(spark), 2.0, 3.0)


@query(f"WITH {SQL_MATRIX} SELECT i, j, v FROM M WHERE i <> 2 UNION ALL SELECT CAST(2 AS INT), i, v FROM M WHERE j = 3")
def row_set(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return M.set_row(m, 2, M.get_column(m, 3))


@query(f"WITH {SQL_MATRIX} SELECT i, j, v FROM M WHERE j <> 4 UNION ALL SELECT j, CAST(4 AS INT), v FROM M WHERE i = 1")
def column_set(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return M.set_column(m, 4, M.get_row(m, 1))


@query(f"WITH {SQL_MATRIX}, A AS (SELECT i, j, v FROM M UNION ALL SELECT j, i + 6, v FROM M) SELECT i, CAST(CASE WHEN j >= 7 THEN j - 3 ELSE j END AS INT) AS j, v FROM A WHERE j < 4 OR j >= 7")
def column_append_remove(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return M.remove_columns(M.append_columns(m, M.transpose(m), 6), 4, 3)


@query(f"WITH {SQL_MATRIX}, A AS (SELECT CASE i WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE i END AS i, j, v FROM M), B AS (SELECT i, j, CASE WHEN i = 1 THEN 2*v ELSE v END AS v FROM A) SELECT CAST(i AS INT) AS i, j, sum(v) AS v FROM (SELECT i, j, v FROM B UNION ALL SELECT 3, j, -0.5::DOUBLE*v FROM B WHERE i = 1) GROUP BY ALL")
def row_operations(spark, sf_dir):
    return M.add_row(M.scale_row(M.swap_rows(matrix(spark, sf_dir), 0, 2), 1, 2.0), 1, 3, -0.5)


@query(f"WITH {SQL_MATRIX}, A AS (SELECT i, CASE j WHEN 1 THEN 5 WHEN 5 THEN 1 ELSE j END AS j, v FROM M), B AS (SELECT i, j, CASE WHEN j = 0 THEN -4*v ELSE v END AS v FROM A) SELECT i, CAST(j AS INT) AS j, sum(v) AS v FROM (SELECT i, j, v FROM B UNION ALL SELECT i, 2, 0.25::DOUBLE*v FROM B WHERE j = 0) GROUP BY ALL")
def column_operations(spark, sf_dir):
    return M.add_column(M.scale_column(M.swap_columns(matrix(spark, sf_dir), 1, 5), 0, -4.0), 0, 2, 0.25)


@query(f"WITH {SQL_MATRIX}, Q AS (SELECT a.i, b.j, sum(a.v*b.v) AS v FROM M a JOIN M b ON a.j = b.i GROUP BY a.i, b.j) SELECT a.i, b.j, sum(a.v*b.v) AS v FROM Q a JOIN M b ON a.j = b.i GROUP BY a.i, b.j")
def matrix_power(spark, sf_dir):
    return M.power(matrix(spark, sf_dir), 3)


@query(f"WITH {SQL_MATRIX} SELECT round(sqrt(sum(v*v)), 6) AS frobenius FROM M")
def frobenius(spark, sf_dir):
    return rounded(M.frobenius(matrix(spark, sf_dir)))


def reflection(spark):
    """I - 2 x x' / x'x, for x = (1, ..., 6)."""
    x = vector(spark)
    return M.add_to_diagonal(M.outer(x, x.withColumn("v", F.col("v") * (-2.0 / 91))), 1.0)


@query(f"WITH {SQL_MATRIX}, H AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1 ELSE 0 END - 2*a.v*b.v/91::DOUBLE AS v FROM X a, X b), A AS (SELECT 'data' AS name, i, j, v FROM M UNION ALL SELECT 'reflection', i, j, v FROM H), G AS (SELECT a.name, a.j AS p, b.j AS q, sum(a.v*b.v) AS s FROM A a JOIN A b ON a.i = b.i AND a.name = b.name GROUP BY ALL) SELECT name, bool_and(abs(s - CASE WHEN p = q THEN 1 ELSE 0 END) <= 1e-9::DOUBLE) AS is_orthogonal FROM G GROUP BY name")
def orthogonal(spark, sf_dir):
    found = {"data": matrix(spark, sf_dir), "reflection": reflection(spark)}
    one, two = (M.orthogonal(m).select(F.lit(name).alias("name"), "is_orthogonal") for name, m in found.items())
    return one.unionByName(two)


#: 3 x 3 sums, and a fourth row that is the sum of the first two.
SQL_TALL = "P AS (SELECT CAST(l_suppkey % 3 AS INT) AS i, CAST(l_partkey % 3 AS INT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), D AS (SELECT " + ", ".join(f"max(v) FILTER (i = {i} AND j = {j}) AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM P)"
SQL_DET = "(m00*(m11*m22 - m12*m21) - m01*(m10*m22 - m12*m20) + m02*(m10*m21 - m11*m20))"


def tall(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    m = t.groupBy(F.pmod("l_suppkey", F.lit(3)).cast("int").alias("i"), F.pmod("l_partkey", F.lit(3)).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))
    more = m.where("i < 2").groupBy("j").agg(F.sum("v").alias("v")).select(F.lit(3).alias("i"), "j", "v")
    return m.unionByName(more)


@query(f"WITH {SQL_TALL} SELECT CAST(CASE WHEN {SQL_DET} <> 0 THEN 3 WHEN " + " OR ".join(f"m{a}{c}*m{b}{d} <> m{a}{d}*m{b}{c}" for a, b in ((0, 1), (0, 2), (1, 2)) for c, d in ((0, 1), (0, 2), (1, 2))) + " THEN 2 ELSE 1 END AS INT) AS rank FROM D")
def matrix_rank(spark, sf_dir):
    return M.rank(tall(spark, sf_dir))


@query(f"WITH {SQL_TALL} SELECT CAST(s AS INT) AS shift, s = 0 AS feasible, CAST(CASE WHEN {SQL_DET} <> 0 THEN 0 END AS INT) AS null_dimension FROM D, (SELECT unnest([0, 1]) AS s)")
def system_feasibility(spark, sf_dir):
    """Right sides from a known solution, and one whose last item breaks the dependence between the rows."""
    m = tall(spark, sf_dir)
    b = M.matvec(m, vector(spark))
    checks = [M.solvable(m, b.withColumn("v", F.col("v") + F.when(F.col("i") == 3, shift).otherwise(0))).select(F.lit(shift).alias("shift"), "*") for shift in (0, 1)]
    return checks[0].unionByName(checks[1])


# --- small systems --------------------------------------------------------------------------------------------------

SQL_NORMAL = "P AS (SELECT l_returnflag, l_quantity/50 AS x, l_discount*10 AS y, l_tax*10 AS z FROM lineitem), E AS (SELECT l_returnflag, avg(x*x) AS a, avg(x*y) AS b, avg(y*y) AS c, avg(x*z) AS r, avg(y*z) AS s FROM P GROUP BY l_returnflag)"
METHODS = ("cholesky", "gauss", "jacobi", "gauss_seidel", "conjugate_gradient", "thomas", "qr", "project")


@query(f"WITH {SQL_NORMAL} SELECT l_returnflag, method, round((c*r - b*s)/(a*c - b*b), 6) AS x0, round((a*s - b*r)/(a*c - b*b), 6) AS x1 FROM E, (SELECT unnest({list(METHODS)}) AS method)")
def linear_systems(spark, sf_dir):
    """Normal equations of two regressors for each return flag, solved by each method."""
    x, y, z = F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.avg(v).alias(k) for k, v in {"a": x * x, "b": x * y, "c": y * y, "r": x * z, "s": y * z}.items()))

    def kernel(frames):
        import pandas as pd

        for frame in frames:
            rows = [(r.l_returnflag, m, *np.round(solved(m, np.array([[r.a, r.b], [r.b, r.c]]), np.array([r.r, r.s])), 6).tolist()) for r in frame.itertuples() for m in METHODS]
            yield pd.DataFrame(rows, columns=["l_returnflag", "method", "x0", "x1"])

    return sums.mapInPandas(kernel, "l_returnflag string, method string, x0 double, x1 double")


def solved(method: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b, a positive definite, by the method named."""
    from .plans import solvers

    if method == "cholesky":
        return solvers.solve(a, b)
    if method == "gauss":
        return solvers.gauss(a, b)[0]
    if method in ("jacobi", "gauss_seidel"):
        x = np.zeros(len(b))
        for _ in range(2000):
            x = getattr(solvers, method)(a, x, b)
        return x
    if method == "conjugate_gradient":
        return solvers.conjugate_gradient(a, b)
    if method == "thomas":
        return solvers.tridiagonal(np.append(0, np.diag(a, -1)), np.diag(a), np.append(np.diag(a, 1), 0), b)
    if method == "qr":
        basis, _, part = solvers.qr(a)
        return solvers.gauss(part, basis.T @ b)[0]
    return solvers.solve(solvers.project_above(a, 0.0), b)  # already above: the projection changes nothing


@query(f"WITH {SQL_NORMAL} SELECT l_returnflag, round(sqrt(a), 8) AS l00, round(b/sqrt(a), 8) AS l10, round(sqrt(c - b*b/a), 8) AS l11, round((a + c)/2 + sqrt((a - c)*(a - c)/4 + b*b), 8) AS top, round(2*a - b, 6) AS gradient FROM E")
def factorisations(spark, sf_dir):
    """The Cholesky factor, the greatest eigenvalue and a numeric derivative of a 2 x 2 matrix."""
    x, y = F.col("l_quantity") / 50, F.col("l_discount") * 10
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(x * x).alias("a"), F.avg(x * y).alias("b"), F.avg(y * y).alias("c"))

    def kernel(frames):
        import pandas as pd

        from .plans import solvers

        for frame in frames:
            rows = []
            for r in frame.itertuples():
                m = np.array([[r.a, r.b], [r.b, r.c]])
                low = solvers.cholesky(m)
                top = np.ones(2)
                for _ in range(500):
                    top = m @ top
                    top /= np.linalg.norm(top)
                slope = solvers.numeric_gradient(lambda v: v @ m @ v, np.array([1.0, -0.5]))[0]  # noqa: B023
                rows.append((r.l_returnflag, *np.round([low[0, 0], low[1, 0], low[1, 1], top @ m @ top], 8).tolist(), round(float(slope), 6)))
            yield pd.DataFrame(rows, columns=["l_returnflag", "l00", "l10", "l11", "top", "gradient"])

    return sums.mapInPandas(kernel, "l_returnflag string, l00 double, l10 double, l11 double, top double, gradient double")


# --- strings, lines and digests -------------------------------------------------------------------------------------


@query("SELECT k AS key, CASE WHEN p_size < 25 THEN 'new' ELSE 'old' END AS value, p_size < 25 AS found FROM (SELECT p_name AS k, max(p_size) AS p_size FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name)")
def string_map(spark, sf_dir):
    """Pairs put over others, some keys removed, every key looked up."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("key")).agg(F.max(F.when(F.pmod("p_partkey", F.lit(3)) != 0, F.col("p_size"))).alias("size")).where("size is not null")
    old = part.select("key", F.lit("old").alias("value"))
    small = part.where("size < 25").select("key")
    both = W.put(old, small.withColumn("value", F.lit("new")))
    without = W.remove(W.put(old, old), part.where("size >= 25").select("key"))
    return W.has(without, W.get(both, part.select("key"))).select("key", "value", "found")


@query("SELECT p_partkey, p_type, 'p' || w AS longest, CAST(2 AS BIGINT) AS copies FROM (SELECT p_partkey, p_type, w, row_number() OVER (PARTITION BY p_partkey ORDER BY length(w) DESC) AS r FROM part JOIN (SELECT DISTINCT substring(p_type, 1, k) AS w FROM part, (SELECT unnest([2, 4, 9]) AS k) WHERE p_size > 40) ON starts_with(p_type, w)) WHERE r = 1")
def prefix_repeats(spark, sf_dir):
    """Every row twice: both stay."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    words = part.where("p_size > 40").select(F.explode(F.array(*(F.substring("p_type", 1, k) for k in (2, 4, 9)))).alias("key")).distinct()
    rows = part.select("p_partkey", "p_type")
    found = W.longest_prefix(rows.unionAll(rows), "p_type", words)
    return found.groupBy("p_partkey", "p_type", F.concat(F.lit("p"), "key").alias("longest")).agg(F.count("*").alias("copies"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(replace(text, chr(13), ''), '\\n+')) AS INT) AS lines FROM documents")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.nonempty_lines(F.col("text")).alias("lines"))


# --- random streams -------------------------------------------------------------------------------------------------

SQL_STREAM = "WITH RECURSIVE G AS (SELECT s AS seed, 0 AS k, s AS v FROM (SELECT unnest([7, 8, 2147483648])::BIGINT AS s) UNION ALL SELECT seed, k + 1, (v*214013 + 2531011) % 4294967296 FROM G WHERE k < 6)"


def seeds(spark):
    return spark.createDataFrame([(7,), (8,), (1 << 31,)], "seed long")


@query(f"{SQL_STREAM} SELECT seed, CAST(k - 1 AS INT) AS pos, -1 + v/4294967295::DOUBLE*3 AS v FROM G WHERE k > 0")
def lcg_reals(spark, sf_dir):
    return seeds(spark).select("seed", F.posexplode(S.lcg_reals(F.col("seed"), 6, -1.0, 2.0)).alias("pos", "v"))


@query(f"{SQL_STREAM} SELECT seed, CAST(k - 1 AS INT) AS pos, (v >> 16) & 32767 AS v FROM G WHERE k > 0")
def c_runtime_stream(spark, sf_dir):
    return seeds(spark).select("seed", F.posexplode(S.c_runtime_stream(F.col("seed"), 6)).alias("pos", "v"))


@query("WITH RECURSIVE G AS (SELECT s AS seed, 0 AS k, s::UBIGINT AS x FROM (SELECT unnest([1, 7, 123456789]) AS s) UNION ALL SELECT seed, k + 1, xor(y, y >> 27) FROM (SELECT seed, k, xor(z, (z % 549755813888::UBIGINT)*33554432::UBIGINT) AS y FROM (SELECT seed, k, xor(x, x >> 12) AS z FROM G) a) b WHERE k < 6) SELECT CAST(seed AS BIGINT) AS seed, CAST(k - 1 AS INT) AS pos, CAST(((x::HUGEINT*2685821657736338717) % 18446744073709551616) // 2048 AS DOUBLE)/9007199254740992::DOUBLE AS v FROM G WHERE k > 0")
def xorshift_stream(spark, sf_dir):
    """The kernels' 64-bit stream, drawn in a task."""

    def kernel(frames):
        import pandas as pd

        from .functions.random import XorShift

        for frame in frames:
            yield pd.DataFrame([(s, k, v) for s in frame.seed for k, v in enumerate(XorShift(s).batch(6))], columns=["seed", "pos", "v"])

    return spark.createDataFrame([(1,), (7,), (123456789,)], "seed long").mapInPandas(kernel, "seed long, pos int, v double")


@query("WITH G AS (SELECT p_partkey, (p_partkey*214013 + 2531011) % 4294967296 AS s FROM part), H AS (SELECT p_partkey, s/4294967295::DOUBLE AS u, ((s*214013 + 2531011) % 4294967296)/4294967295::DOUBLE AS v FROM G) SELECT p_partkey, round(-ln(1 - u)/2, 8) AS exponential, round(3*sqrt(-2*ln(1 - u)), 8) AS rayleigh, round(1 + 2*sqrt(-2*ln(1 - u))*cos(2*pi()*v), 7) + 0.0::DOUBLE AS normal, round(-2*ln(1 - u)*cos(2*pi()*v)*cos(2*pi()*v) - 2*ln(1 - v)*cos(2*pi()*u)*cos(2*pi()*u), 7) + 0.0::DOUBLE AS chi_square FROM H")
def distributions(spark, sf_dir):
    draws = S.lcg_reals(F.col("p_partkey"), 2)
    t = table(spark, sf_dir, "part").select("p_partkey", draws[0].alias("u"), draws[1].alias("v"))
    u, v = F.col("u"), F.col("v")
    t = t.select("p_partkey", F.round(S.exponential(u, 2.0), 8).alias("exponential"), F.round(S.rayleigh(u, 3.0), 8).alias("rayleigh"), S.normal(u, v, 1.0, 2.0).alias("normal"), S.chi_square([S.normal(u, v), S.normal(v, u)]).alias("chi_square"))
    return rounded(t, 7, "exponential", "rayleigh")


@query(f"WITH {SQL_V}, E AS (SELECT vec_id, k - 1 AS k, a[k] AS x, CASE WHEN a[k] = 0 THEN NULL ELSE power(2::DOUBLE, floor(log2(abs(a[k])))) END AS p FROM V, (SELECT unnest(range(1, 65)) AS k)) SELECT vec_id, CAST(k AS INT) AS pos, CAST(floor(log2(abs(x))) AS INT) AS e, coalesce(abs(x)/p, 0) AS m FROM E")
def float_parts(spark, sf_dir):
    t = vectors(spark, sf_dir).select("vec_id", F.posexplode("a").alias("pos", "x"))
    return t.select("vec_id", "pos", S.exponent(F.col("x")).alias("e"), S.mantissa(F.col("x")).alias("m"))


# --- compressors ----------------------------------------------------------------------------------------------------

#: A number in [0, 1] for an entry, by one step of the 32-bit generator.
SQL_U = "(((pos*31 + client_id)*214013 + 2531011) % 4294967296)/4294967295::DOUBLE"


def chance():
    return S.lcg_reals(F.col("pos") * 31 + F.col("client_id"), 1)[0]


@query(f"WITH {SQL_ENTRIES} SELECT client_id, pos, v FROM E WHERE {SQL_U} < 0.25::DOUBLE")
def independent_k(spark, sf_dir):
    from .operators.series import independent_k

    return entries(spark, sf_dir).where(independent_k(chance(), 0.25)).select("client_id", "pos", "v")


@query(f"WITH {SQL_ENTRIES} SELECT client_id, pos, v/0.25::DOUBLE AS v FROM E WHERE {SQL_U} < 0.25::DOUBLE")
def bernoulli_sparse(spark, sf_dir):
    return C.bernoulli(entries(spark, sf_dir), chance(), 0.25).select("client_id", "pos", "v")


@query(f"WITH {SQL_ENTRIES}, Z AS (SELECT *, sqrt(sum(v*v) OVER (PARTITION BY client_id)) AS norm FROM E) SELECT client_id, pos, round(sign(v)*norm*floor(4*abs(v)/norm + {SQL_U})/4, 6) + 0.0::DOUBLE AS v FROM Z")
def dithering(spark, sf_dir):
    return rounded(C.dithering(entries(spark, sf_dir), 4, chance()).select("client_id", "pos", "v"))


@query(f"WITH {SQL_ENTRIES}, Z AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY abs(v) DESC, pos) AS r, CASE WHEN v = 0 THEN 0::DOUBLE ELSE power(2::DOUBLE, floor(log2(abs(v)))) END AS p FROM E) SELECT client_id, 'identical' AS method, pos, v FROM Z UNION ALL SELECT client_id, 'topk', pos, v FROM Z WHERE r <= {K} UNION ALL SELECT client_id, 'natural', pos, sign(v)*p FROM Z")
def compressor_kernels(spark, sf_dir):
    """The numpy kernels of the training rounds, on each client's whole triangle."""
    from .plans.compressors import Compressor, Lcg

    def kernel(frame):
        import pandas as pd

        v = np.zeros(N_ENTRIES)
        v[frame.pos] = frame.v
        out = []
        for name, k in (("identical", N_ENTRIES), ("topk", K), ("natural", N_ENTRIES)):
            at, value = Compressor(name, 8, k, 1.0).apply(v, Lcg(1))
            out.append(pd.DataFrame({"client_id": frame.client_id.iloc[0], "method": name, "pos": at, "v": value + 0.0}))
        return pd.concat(out)

    return entries(spark, sf_dir).groupBy("client_id").applyInPandas(kernel, "client_id int, method string, pos long, v double")


# --- first rounds of training, and smoothness, in closed form -------------------------------------------------------

SQL_FIRST = f"S AS (SELECT client_id, a0 AS p, a4 AS q FROM T WHERE client_id IS NOT NULL), C AS (SELECT client_id, avg(-0.5::DOUBLE*p) AS g0, avg(-0.5::DOUBLE*q) AS g1, avg(0.25::DOUBLE*p*p) + {LAMBDA}::DOUBLE AS h, avg(0.25::DOUBLE*p*q) AS j, avg(0.25::DOUBLE*q*q) + {LAMBDA}::DOUBLE AS k FROM S GROUP BY client_id), Y AS (SELECT avg(g0) AS g0, avg(g1) AS g1, avg(h) AS h, avg(j) AS j, avg(k) AS k FROM C)"
SQL_SECOND = f"Z AS (SELECT client_id, p, q, x0, x1, p*x0 + q*x1 AS m FROM S, X1), F1 AS (SELECT client_id, any_value(x0) AS x0, any_value(x1) AS x1, avg({SQL_LOSS}) AS f, avg(-(1 - 1/(1 + exp(-m)))*p) AS g0, avg(-(1 - 1/(1 + exp(-m)))*q) AS g1 FROM Z GROUP BY client_id), F2 AS (SELECT any_value(x0) AS x0, any_value(x1) AS x1, avg(f) AS f, avg(g0) AS g0, avg(g1) AS g1 FROM F1)"


def sql_rounds(step: str, bytes_: int) -> str:
    """Rows of rounds 0 and 1, the iterate of round 1 being given."""
    at = f"SELECT CAST(1 AS INT) AS round, round(sqrt((g0 + {LAMBDA}*x0)*(g0 + {LAMBDA}*x0) + (g1 + {LAMBDA}*x1)*(g1 + {LAMBDA}*x1)), 8) AS grad_norm, round(f + {LAMBDA / 2}::DOUBLE*(x0*x0 + x1*x1), 8) AS f, round(sqrt(x0*x0 + x1*x1), 8) AS x_norm, {bytes_}::DOUBLE AS bytes_scalars, 0::DOUBLE AS bytes_indices FROM F2"
    return f"WITH {SQL_DEALT}, {SQL_FIRST}, X1 AS (SELECT {step} FROM Y), {SQL_SECOND} SELECT CAST(0 AS INT) AS round, round(sqrt(g0*g0 + g1*g1), 8) AS grad_norm, round(ln(2::DOUBLE), 8) AS f, 0::DOUBLE AS x_norm, 0::DOUBLE AS bytes_scalars, 0::DOUBLE AS bytes_indices FROM Y UNION ALL {at}"


def two_features(spark, sf_dir):
    """(client_id, features) with the first and the last feature alone."""
    from .scratch import save

    return save(dealt(spark, sf_dir).where("client_id is not null").select("client_id", F.array("a0", "a4").alias("features")))


def first_rounds(spark, sf_dir, **config):
    return rounded(trained(two_features(spark, sf_dir), rounds=2, **config), 8)


@query(sql_rounds("-0.5::DOUBLE*g0 AS x0, -0.5::DOUBLE*g1 AS x1", 8 * 2 * CLIENTS))
def gd_first_rounds(spark, sf_dir):
    return first_rounds(spark, sf_dir, algorithm="gd", global_lr=0.5)


@query(sql_rounds("-(k*g0 - j*g1)/(h*k - j*j) AS x0, -(h*g1 - j*g0)/(h*k - j*j) AS x1", (8 * 3 + 8 * 4) * CLIENTS))
def newton_b_first_rounds(spark, sf_dir):
    return first_rounds(spark, sf_dir, option="b", compressor="identical")


@query(sql_rounds(f"-((k + {LAMBDA})*g0 - j*g1)/((h + {LAMBDA})*(k + {LAMBDA}) - j*j) AS x0, -((h + {LAMBDA})*g1 - j*g0)/((h + {LAMBDA})*(k + {LAMBDA}) - j*j) AS x1", (8 * 3 + 8 * 4) * CLIENTS))
def newton_a_first_rounds(spark, sf_dir):
    return first_rounds(spark, sf_dir, option="a", compressor="identical")


@query(f"WITH {SQL_DEALT}, S AS (SELECT avg(a0*a0)/4 AS a, avg(a0*a4)/4 AS b, avg(a4*a4)/4 AS c FROM T WHERE client_id IS NOT NULL) SELECT way, round((a + c)/2 + sqrt((a - c)*(a - c)/4 + b*b) + {LAMBDA}::DOUBLE, 7) AS l FROM S, (SELECT unnest(['gram', 'passes']) AS way)")
def smoothness_closed_form(spark, sf_dir):
    """The power iteration on the Gram matrix, and as passes over the samples."""
    from .plans.training import smoothness

    t = two_features(spark, sf_dir)
    rows = [("gram", smoothness(t, LAMBDA)), ("passes", smoothness(t, LAMBDA, eps=1e-8, gram_features=1))]
    return spark.createDataFrame([(way, round(value, 7)) for way, value in rows], "way string, l double")
