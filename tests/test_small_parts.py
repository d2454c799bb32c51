import numpy as np
import pytest
from pyspark.sql import functions as F

from newtonmill.functions import random as R
from newtonmill.functions import scalar as S
from newtonmill.functions import vector as V
from newtonmill.operators import compress as C
from newtonmill.operators import matrix as M
from newtonmill.operators.partition import union_padded
from newtonmill.sources.svm import read_fixed


def test_fixed_shape_reader(spark, tmp_path):
    (tmp_path / "f").write_text("".join(f"{1 if k % 2 else -1} 1:{k} 3:0.5\n" for k in range(11)))
    rows = read_fixed(spark, str(tmp_path / "f"), rows=9, clients=2, d=3).orderBy("client_id", F.col("features")[0]).collect()
    assert [r.client_id for r in rows] == [0] * 4 + [1] * 4
    assert [r.features for r in rows][:2] == [[0.0, 0.0, 0.5], [1.0, 0.0, 0.5]]


def test_streams_repeat_and_fill_the_unit_interval():
    a, b = R.XorShift(7), R.XorShift(7)
    x = a.batch(5000)
    assert np.array_equal(x, b.batch(5000)) and 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.02
    assert sorted(R.shuffled(50, 3)) == list(range(50)) and np.array_equal(R.shuffled(50, 3, 5), R.shuffled(50, 3)[:5])


def test_distributions(spark):
    u, v = S.uniform(F.col("id"), F.lit(1)), S.uniform(F.col("id"), F.lit(2))
    t = spark.range(40_000).select(S.exponential(u, 2.0).alias("e"), S.rayleigh(u, 1.0).alias("r"), S.normal(u, v, 1.0, 2.0).alias("n"), S.chi_square([S.normal(u, v), S.normal(v, u)]).alias("c"))
    r = t.agg(F.avg("e"), F.avg("r"), F.avg("n"), F.stddev("n"), F.avg("c")).first()
    assert np.allclose(r, [0.5, np.sqrt(np.pi / 2), 1.0, 2.0, 2.0], atol=0.05)


def test_vector_functions(spark):
    t = spark.createDataFrame([([1.0, -2.0, 0.0], [2.0, 4.0, -1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = t.select(V.divide(a, b).alias("q"), V.sign(a).alias("s"), V.norm(a, float("inf")).alias("m"), V.is_zero(a).alias("z"), V.clamp_each(a, F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.5)), b).alias("c"), V.difference_norm(a, b).alias("d"), V.each(a, "sigmoid_series").alias("y"), V.total(a).alias("t"), V.indices(a).alias("i")).first()
    assert r.q == [0.5, -0.5, 0.0] and r.s == [1, -1, -1] and r.m == 2 and not r.z and r.c == [1.0, -1.0, 0.5] and r.t == -1 and r.i == [0, 1, 2]
    assert np.isclose(r.d, np.sqrt(1 + 36 + 1)) and np.allclose(r.y, 1 / (1 + np.exp([-1.0, 2, 0])), atol=1e-3)


def test_matrix_relations(spark):
    a = np.arange(9.0).reshape(3, 3)
    rel = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m.T))], "i int, j int, v double")
    back = lambda df: {(r.i, r.j): r.v for r in df.collect()}
    dense = lambda m: {(i, j): m[i, j] for i in range(3) for j in range(3)}
    assert back(M.power(rel(a), 3)) == dense(a @ a @ a)
    assert back(M.symmetrized(rel(a).where("i <= j"))) == dense(np.triu(a) + np.triu(a, 1).T)
    assert {r.i: r.v for r in M.matvec(rel(a), spark.createDataFrame([(i, float(i)) for i in range(3)], "i int, v double"), turned=True).collect()} == dict(enumerate(a.T @ np.arange(3.0)))
    p = M.predicates(rel(a - a.T)).first()
    assert p.is_skew and not p.is_symmetric and p.is_square and not p.is_upper
    assert M.equal(rel(a), rel(a)).first().equal and not M.equal(rel(a), rel(a.T)).first().equal
    big = M.predicates(rel(np.diag([1.0, 2, 3]))).first()
    assert big.is_diagonal and big.is_tridiagonal and big.is_upper and big.is_lower and big.is_symmetric


def test_random_relations(spark):
    t = spark.range(400).select((F.col("id") % 2).cast("int").alias("client_id"), F.floor(F.col("id") / 2).alias("pos"), F.lit(1.0).alias("v"))
    u = S.uniform(F.col("pos"), F.col("client_id"), F.lit(3))
    kept = C.bernoulli(t, u, 0.25)
    assert 60 < kept.count() < 140 and kept.first().v == 4.0
    d = C.dithering(t, 4, u)
    assert abs(d.agg(F.avg("v")).first()[0] - 1) < 0.4
    assert C.top_k(t, 5).count() == 10 and C.rand_k(t, 7, 200, F.lit(1), F.col("client_id")).count() == 14


def test_padded_union(spark):
    a = spark.createDataFrame([([1.0],)], "features array<double>")
    b = spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>")
    assert sorted(r.features for r in union_padded(a, b, width=3).collect()) == [[1.0, 0.0, 0.0], [1.0, 2.0, 3.0]]


def test_entry_without_the_training_data_queries(monkeypatch):
    """Whether that subpackage is absent or broken, the other queries stay."""
    import sys

    import __spark_entry__ as entry
    from newtonmill.queries import ORACLE_SQL, QUERIES

    monkeypatch.setitem(sys.modules, "newtonmill.llm.queries", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)


def test_random_fill_and_string_maps(spark):
    from newtonmill.operators import strings

    t = spark.range(500).select(V.random_fill(F.col("id"), 4, 7, -1.0, 1.0).alias("a"))
    rows = np.array([r.a for r in t.collect()])
    assert rows.shape == (500, 4) and -1 <= rows.min() < -0.9 and 0.9 < rows.max() < 1 and abs(rows.mean()) < 0.1
    words = spark.createDataFrame([("wat", 1), ("we", 2), ("we1", 3), ("we12", 4)], "key string, value int")
    left = strings.remove(words, spark.createDataFrame([("we1",), ("none",)], "key string"))
    assert {r.key for r in left.collect()} == {"wat", "we", "we12"}
    texts = spark.createDataFrame([("we123",), ("we123",), ("x",), (None,)], "t string")
    assert [(r.t, r.key) for r in strings.longest_prefix(texts, "t", left).collect()] == [("we123", "we12")] * 2
    assert {r.key: r.value for r in strings.get(strings.put(left, spark.createDataFrame([("we", 9)], "key string, value int")), spark.createDataFrame([("we",), ("gone",)], "key string")).collect()} == {"we": 9, "gone": None}


def test_rank_and_feasible_systems(spark):
    rel = lambda m: spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i int, j int, v double")
    vec = lambda b: spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i int, v double")
    two = [[1, 2], [2, 4]]
    assert M.rank(rel(two)).first().rank == 1 and not M.solvable(rel(two), vec([5, 7])).first().feasible
    assert tuple(M.solvable(rel(two), vec([1, 2])).first()) == (True, 1)
    assert M.rank(rel([[1, 0], [0, 1], [1, 1]])).first().rank == 2 and M.orthogonal(rel([[0, 1], [1, 0]])).first()[0] and not M.orthogonal(rel(two)).first()[0]


def test_feasibility_of_great_whole_numbers(spark, tmp_path):
    """A right side off by 1 among numbers of 1e9 and more, in the query too; rounded numbers stay feasible."""
    import duckdb

    from newtonmill.queries import ORACLE_SQL, QUERIES

    rel = lambda m: spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i int, j int, v double")
    vec = lambda b: spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i int, v double")
    for size in (10**9, 2**50):
        rows = [[size, 1], [3, size + 7], [size + 3, size + 8]]
        b = [row[0] + row[1] for row in rows]
        assert tuple(M.solvable(rel(rows), vec(b)).first()) == (True, 0)
        assert tuple(M.solvable(rel(rows), vec([*b[:2], b[2] + 1])).first()) == (False, 0)
        assert tuple(M.solvable(rel([[size, size], [size, size], [-size, -size]]), vec([1, 1, -1])).first()) == (True, 1)
    tenths = [[0.1, 0.2], [0.7, 0.3], [0.1 + 0.7, 0.2 + 0.3]]
    assert M.solvable(rel(tenths), vec([x * 0.1 + y * 0.3 for x, y in tenths])).first().feasible
    assert not M.solvable(rel(tenths), vec([1, 1, 2.5])).first().feasible
    duck = duckdb.connect()
    for size in (1, 10**8, 10**12):
        duck.execute(f"create or replace table lineitem as select s as l_suppkey, p as l_partkey, CAST({size}*(1 + (s*s + 2*p) % 5) + s AS DOUBLE) as l_quantity from range(12) a(s), range(9) b(p)")
        (tmp_path / str(size)).mkdir()
        duck.execute(f"copy lineitem to '{tmp_path / str(size)}/lineitem.parquet' (format parquet)")
        found = QUERIES["system_feasibility"](spark, str(tmp_path / str(size)))
        assert sorted(map(tuple, found.select("shift", "feasible", "null_dimension").collect())) == sorted(duck.execute(ORACLE_SQL["system_feasibility"]).fetchall()) == [(0, True, 0), (1, False, 0)]


def test_ranks_of_whole_numbers_equal_those_of_fractions():
    from fractions import Fraction

    from newtonmill.plans import solvers

    def rank(m):
        m, r = [[Fraction(int(x)) for x in row] for row in m], 0
        for c in range(len(m[0]) if m else 0):
            at = next((k for k in range(r, len(m)) if m[k][c]), None)
            if at is not None:
                m[r], m[at] = m[at], m[r]
                m = m[: r + 1] + [[x - y * row[c] / m[r][c] for x, y in zip(row, m[r])] for row in m[r + 1 :]]
                r += 1
        return r

    rng = np.random.default_rng(5)
    cases = [np.diag(solvers.PRIMES[:4]).astype(float), np.zeros((3, 2)), np.zeros((0, 0)), np.diag([2.0**51 - 1] * 3)]
    for k in range(200):
        rows, n, inner = rng.integers(1, 7, 3)
        most = (2, 50, 2**22)[k % 3]
        cases.append(rng.integers(-most, most, (rows, inner)).astype(float) @ rng.integers(-most, most, (inner, n)))
    for a in cases:
        x = rng.integers(-3, 4, a.shape[1])
        for b in (a @ x, a @ x + rng.integers(0, 2, len(a))):
            assert solvers.whole(a, b) and solvers.whole_ranks(a, b) == (rank(a), rank(np.column_stack([a, b])))
    assert not solvers.whole(np.array([0.5])) and not solvers.whole(np.array([np.nan])) and not solvers.whole(np.array([1.0]), np.array([-(2.0**53)]))


@pytest.mark.parametrize("tasks", [1, 7])
def test_interpolation_in_a_group_split_over_tasks(spark, tasks):
    from newtonmill.operators.series import interpolate

    rng = np.random.default_rng(2)
    xs = np.unique(rng.integers(0, 10_000, 300)).astype(float)
    ys = rng.normal(size=len(xs))
    ask = np.concatenate([xs[:20], rng.random(400) * 12_000 - 1000])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        points = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(xs, ys)] + [(2, 5.0, 1.0), (None, 3.0, 4.0)], "k int, x double, y double")
        asked = spark.createDataFrame([(1, float(x)) for x in ask] + [(2, 9.0), (None, 1.0), (3, 1.0)], "k int, x double")
        found = {(r.k, r.x): r.y for r in interpolate(points, asked, "k").collect()}
        steps = {(r.k, r.x): r.y for r in interpolate(points, asked, "k", linear=False).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose([found[1, x] for x in ask.tolist()], np.interp(ask, xs, ys)) and (found[2, 9.0], found[None, 1.0], found[3, 1.0]) == (1.0, 4.0, None)
    at = np.maximum(0, np.searchsorted(xs, ask, "right") - 1)
    assert [steps[1, x] for x in ask.tolist()] == ys[at].tolist()
